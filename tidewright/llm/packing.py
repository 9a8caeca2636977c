"""Best-fit packing of documents into token sequences by hierarchical residual packing.

Documents are encoded where they are read; from then on only rows of (row, length) move. Pieces that fill a sequence
have it to themselves. The others are dealt by hash to leaves and packed there, largest first, each into the fullest
sequence that has room. Nearly full sequences are final. What a leaf has left over goes up a tree as items, eight
nodes to one, and is packed by the same rule again.

What goes up is bounded. After best fit at most one sequence of a node is up to half full, so the whole tree has at
most one such sequence for each leaf, and two sequences over half full never fit together. So no node needs to pass
on more hosts than there are leaves; the least filled are passed on, into which every smaller one fits.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import lean, rows_of, text_column, written
from tidewright.llm.tokens import END_ID, encoder

CAPACITY = 1024
LEAF_ITEMS = 20_000
FAN_IN = 8
SLACK = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "item long, bin long, shift long, node long, fill long, open boolean"


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the bins' fills: largest item first, each into the fullest bin with room for it."""
    by_room, rooms = [[] for _ in range(capacity + 1)], 0  # bit r of rooms: a bin has room for exactly r
    bins, offsets, fills = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    plain = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = plain[i]
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, capacity - room
        room -= size
        fills[b] = capacity - room
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins, offsets, np.array(fills, np.int64)


def pieces(docs: DataFrame, tokenizer: str, units: str = "spaced", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, encoded whole with end_id after it; of a longer one the first piece may be shorter."""
    import pyarrow as pa

    def encode(batches):
        known, end = encoder(tokenizer, units), np.array([end_id], "<u4").tobytes()
        code, out = known.ids, []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            raw = code(text) + end
            n = len(raw) // 4
            at, to = 0, n % capacity or capacity
            piece = 0
            while at < n:
                out.append((doc_id, piece, at, to - at, zlib.crc32(raw[4 * at : 4 * to])))
                at, to, piece = to, to + capacity, piece + 1
            if len(out) >= 20_000:
                yield batch()
                out = []
        if out:
            yield batch()
        known.forget()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text")).mapInArrow(lean(encode), PIECES)


def pack_items(items: DataFrame, n_items: int, capacity: int = CAPACITY, leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """items (item, length < capacity) -> (item, bin, offset), bins of at most capacity, by the tree described above."""
    import pandas as pd

    leaves = max(1, -(-n_items // leaf_items))

    def packer(level: int):
        def pack(key, pdf):
            node, sizes = int(key[0]), pdf["length"].to_numpy(np.int64)
            bins, offsets, fills = best_fit(sizes, capacity)
            ids = (level << 58) | (node << 28) | np.arange(len(fills))
            out = pd.DataFrame({"item": pdf["item"].to_numpy(np.int64), "bin": ids[bins], "shift": offsets, "node": node, "fill": 0, "open": False})
            left = np.flatnonzero(fills <= capacity - SLACK)
            left = left[np.argsort(fills[left], kind="stable")[: leaves + 1]]
            rest = pd.DataFrame({"item": ids[left], "bin": ids[left], "shift": 0, "node": node, "fill": fills[left], "open": True})
            return pd.concat([out, rest], ignore_index=True)

        return pack

    at = items.withColumn("node", F.pmod(F.xxhash64("item"), F.lit(leaves)))
    first = written(at.groupBy("node").applyInPandas(packer(0), PLACED), "level0")
    placed, maps, nodes, level = first, [], leaves, 0
    while nodes > 1:
        level, nodes = level + 1, -(-nodes // FAN_IN)
        left = placed.where("open").select("item", F.col("fill").alias("length"), F.expr(f"node div {FAN_IN}").alias("node"))
        placed = written(left.groupBy("node").applyInPandas(packer(level), PLACED), f"level{level}")
        maps.append(placed.where("not open").select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("shift").alias("by")))
    out = first.where("not open").select("item", "bin", F.col("shift").alias("offset"))
    if not maps:
        return out
    top = maps.pop()
    while maps:  # where the bins of one level end up, from the root down
        low, high = maps.pop(), top.select(F.col("bin").alias("to"), F.col("to").alias("up"), F.col("by").alias("up_by"))
        top = low.join(high, "to", "left").select("bin", F.coalesce("up", "to").alias("to"), (F.col("by") + F.coalesce("up_by", F.lit(0))).alias("by"))
    return out.join(top, "bin", "left").select("item", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("by", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, units: str = "spaced", capacity: int = CAPACITY, leaf_items: int = LEAF_ITEMS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and, like empty ones, give one piece: the end id. Null and repeated doc_ids are packed
    row by row. Other columns of docs are not read. An empty table gives no rows.
    """
    cut = written(pieces(docs, tokenizer, units, capacity).withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = cut.where(F.col("length") < capacity).select("item", "length")
    packed = pack_items(items, items.count(), capacity, leaf_items)
    full = cut.where(F.col("length") == capacity).withColumn("bin", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("long"))
    both = cut.where(F.col("length") < capacity).join(packed, "item").unionByName(full)
    return both.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")
