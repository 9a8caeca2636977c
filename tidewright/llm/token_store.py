"""Token-ID output in patched frame-of-reference blocks.

An encoded segment (bytes) is: a header; the offset of each block; the documents' ids and lengths; then the blocks.
A block holds BLOCK ids less their minimum, packed at the width that fits PERCENTILE of them; the others keep their
low bits in place and stand whole in the block's exception list. Segments are rows of a Parquet table, so that
Spark's committer makes them appear once each however often a task is tried again.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import rows_of, shared_dir, text_column
from tidewright.llm.tokens import END_ID, encoder

MAGIC, BLOCK, PERCENTILE = b"PFR1", 128, 90
SEGMENT_IDS = 1 << 20
HEAD = struct.Struct("<4sIIII")
SEGMENT = "shard int, segment int, n_docs long, n_ids long, first_doc long, last_doc long, image binary"


def bit_width(x: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(x.astype(np.float64) + 1)).astype(np.int64)


def pack_segment(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The segment's bytes. ids: unsigned 32-bit, the documents' one after another; doc_ids: nulls as the least long."""
    n_blocks = -(-len(ids) // BLOCK)
    v = np.zeros(n_blocks * BLOCK, np.uint32)
    v[: len(ids)] = ids
    if len(ids):
        v[len(ids) :] = ids[-1]
    v = v.reshape(n_blocks, BLOCK)
    low = v.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    v = v - low[:, None]
    rank = BLOCK * PERCENTILE // 100
    width = bit_width(np.partition(v, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, np.int64)
    odd = v >> np.minimum(width, 31).astype(np.uint32)[:, None] > 0
    odd[width >= 32] = False
    n_odd = odd.sum(axis=1)
    size = 6 + 16 * width + 5 * n_odd
    start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    out = np.zeros(start[-1], np.uint8)
    out[start[:-1, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[start[:-1] + 4], out[start[:-1] + 5] = width, n_odd
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        bits = (v[which][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).reshape(len(which), -1), axis=1, bitorder="little")
        out[start[which][:, None] + 6 + np.arange(16 * w)] = packed
    block, place = np.nonzero(odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    at = start[block] + 6 + 16 * width[block]
    out[at + nth] = place
    out[(at + n_odd[block] + 4 * nth)[:, None] + np.arange(4)] = v[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    head = HEAD.pack(MAGIC, len(ids), BLOCK, n_blocks, len(doc_ids))
    return head + start.astype("<u8").tobytes() + np.asarray(doc_ids, "<i8").tobytes() + np.asarray(lengths, "<u8").tobytes() + out.tobytes()


def unpack_segment(image: bytes, first_block: int = 0, last_block: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, doc_ids, lengths) of a segment; ids only of blocks first_block to before last_block, found by the index."""
    magic, n_ids, block, n_blocks, n_docs = HEAD.unpack_from(image)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a patched frame-of-reference segment")
    raw, at = np.frombuffer(image, np.uint8), HEAD.size
    start = raw[at : at + 8 * (n_blocks + 1)].view("<u8").astype(np.int64)
    at += 8 * (n_blocks + 1)
    doc_ids = np.frombuffer(image, "<i8", n_docs, at)
    lengths = np.frombuffer(image, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    raw = raw[at + 16 * n_docs :]
    last_block = n_blocks if last_block is None else min(last_block, n_blocks)
    start = start[first_block : last_block + 1]
    start, n = start[:-1], len(start) - 1
    low = raw[start[:, None] + np.arange(4)].copy().view("<u4")[:, 0] if n else np.zeros(0, np.uint32)
    width, n_odd = raw[start + 4].astype(np.int64), raw[start + 5].astype(np.int64)
    v = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        packed = raw[start[which][:, None] + 6 + np.arange(16 * w)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), BLOCK, w)
        v[which] = (bits.astype(np.uint32) << np.arange(w, dtype=np.uint32)).sum(axis=2, dtype=np.uint32)
    of = np.repeat(np.arange(n), n_odd)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    at = start[of] + 6 + 16 * width[of]
    if len(of):
        v[of, raw[at + nth]] = raw[(at + n_odd[of] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4")[:, 0]
    ids = (v + low[:, None]).reshape(-1)
    return ids[: max(0, n_ids - first_block * BLOCK)], doc_ids, lengths


def write_token_store(docs: DataFrame, path: str, tokenizer: str, units: str = "words", end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text) whole, appends end_id to each, and writes segments in ascending doc_id order.

    Rows are dealt by ranges of doc_id (and of the text's hash, so that a repeated id doesn't make a hot range) and
    sorted in each. Null texts count as empty, null ids come first; repeated ids are ordered by text. A segment
    ends with the document that fills it. An empty table gives a table without segments.
    """
    import pyarrow as pa

    least = -(1 << 63)

    def encode(batches):
        from pyspark import TaskContext

        code, shard, segment, end = encoder(tokenizer, units).ids, TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        ids, docs_in, lengths, held = [], [], [], 0

        def image():
            flat = np.frombuffer(b"".join(ids), "<u4")
            row = [shard, segment, len(docs_in), len(flat), docs_in[0], docs_in[-1], pack_segment(flat, np.array([least if d is None else d for d in docs_in], np.int64), np.array(lengths, np.int64))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types, strict=True)], schema=schema)

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids.append(code(text) + end)
            docs_in.append(doc_id)
            lengths.append(len(ids[-1]) // 4)
            held += lengths[-1]
            if held >= SEGMENT_IDS:
                yield image()
                ids, docs_in, lengths, held, segment = [], [], [], 0, segment + 1
        if ids:
            yield image()

    schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("image", pa.binary())])
    rows = docs.select("doc_id", text_column(docs).alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SEGMENT).write.parquet(path)


def read_token_store(spark, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, shard, segment."""
    import pyarrow as pa

    least = -(1 << 63)

    def decode(batches):
        for batch in batches:
            for shard, segment, image in zip(*(batch.column(c) for c in ("shard", "segment", "image")), strict=True):
                ids, doc_ids, lengths = unpack_segment(image.as_py())
                ends = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if d == least else d for d in doc_ids.tolist()], pa.int64()), "local": pa.array(ends - lengths), "n_tokens": pa.array(lengths), "ids_crc32": pa.array(crcs, pa.int64()),
                    "shard": pa.array([shard.as_py()] * len(crcs), pa.int32()), "segment": pa.array([segment.as_py()] * len(crcs), pa.int32()),
                })

    segments = spark.read.schema(SEGMENT).parquet(path)
    per_shard = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    # one row per shard here, one per segment below: small beside the documents
    before = per_shard.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("shards_before"))
    w = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, 0)
    bases = segments.select("shard", "segment", (F.sum("n_ids").over(w) - F.col("n_ids")).alias("segments_before")).join(before, "shard")
    bases = bases.select("shard", "segment", (F.col("shards_before") + F.col("segments_before")).alias("base"))
    found = segments.select("shard", "segment", "image").mapInArrow(decode, "doc_id long, local long, n_tokens long, ids_crc32 long, shard int, segment int")
    return found.join(bases, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", "shard", "segment")


def token_store(docs: DataFrame, tokenizer: str, units: str = "words") -> DataFrame:
    """Writes a token store in the shared folder and returns what read_token_store finds in it."""
    path = f"{shared_dir(docs.sparkSession)}/tidewright-{uuid.uuid4().hex}/tokens"
    write_token_store(docs, path, tokenizer, units)
    return read_token_store(docs.sparkSession, path)
