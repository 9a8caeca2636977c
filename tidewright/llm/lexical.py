"""Ranked lexical search over document-sharded postings with integer impacts.

A shard is a row of a table: its documents, its vocabulary, and for each term the documents that hold it with the
impact of its frequency there, in compressed sparse rows. Impacts are whole numbers made when the index is built; only
the weight of a term, which depends on all shards, is applied in a search. Queries go to the index in blocks of
bounded size. A task takes its shards one after another, adds up a query's terms in a dense array over the shard's
documents, keeps the best with all ties at the border, and hands on at most k rows a query; those are merged in a tree.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import rows_of, text_column, written
from tidewright.llm.licenses import TO_WORDS

K = 10
#: A shard is closed at so many documents, or pairs of term and document (12 bytes each).
SHARD_DOCS = 1 << 14
SHARD_PAIRS = 1 << 20
#: Bytes of query texts that one pass over the index takes.
QUERY_BYTES = 1 << 23
FAN_IN = 64
INDEX = "ids array<bigint>, vocabulary binary, starts binary, places binary, impacts binary"
TOPS = "part long, q long, top array<struct<lost:bigint,unnamed:boolean,doc_id:bigint>>"


def terms(text: str) -> list[bytes]:
    """Maximal runs of letters, digits and whatever is outside ASCII; only A-Z are made small."""
    return text.encode("utf-8", "surrogatepass").translate(TO_WORDS).split()


def corpus_size(texts: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms in all) of texts (doc_id, text)."""
    import pyarrow as pa

    def run(batches):
        n_docs = n_terms = 0
        for (text,) in rows_of(batches, "text"):
            n = len(terms(text))
            n_docs, n_terms = n_docs + (n > 0), n_terms + n
        yield pa.RecordBatch.from_pydict({"docs": [n_docs], "terms": [n_terms]})

    counts = texts.select("text").mapInArrow(run, "docs long, terms long")
    return tuple(counts.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first())


def build_index(docs: DataFrame) -> tuple[DataFrame, int]:
    """(a row for each shard of the documents with a term, the number of those documents)."""
    import pyarrow as pa

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_column(docs).alias("text"))
    n_docs, n_terms = corpus_size(texts)

    def shard(ids, lengths, vocabulary, term_ids, times):
        m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths], np.int64)
        held = np.repeat(np.arange(len(ids), dtype=np.int64), [len(t) for t in term_ids])
        which, tf = np.concatenate(term_ids).astype(np.int64), np.concatenate(times).astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[held])
        order = np.argsort(which, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(vocabulary)))])
        row = (ids, b" ".join(vocabulary), starts.astype("<i8").tobytes(), held[order].astype("<u4").tobytes(), impact[order].astype("<u4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.list_(pa.int64()), *[pa.binary()] * 4), strict=True)], names=["ids", "vocabulary", "starts", "places", "impacts"])

    def run(batches):
        ids, lengths, vocabulary, term_ids, times, pairs = [], [], {}, [], [], 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            found = terms(text)
            if not found:
                continue
            counts = Counter(found)
            ids.append(doc_id)
            lengths.append(len(found))
            term_ids.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in counts), np.uint32, len(counts)))
            times.append(np.fromiter(counts.values(), np.uint32, len(counts)))
            pairs += len(counts)
            if len(ids) >= SHARD_DOCS or pairs >= SHARD_PAIRS:
                yield shard(ids, lengths, vocabulary, term_ids, times)
                ids, lengths, vocabulary, term_ids, times, pairs = [], [], {}, [], [], 0
        if ids:
            yield shard(ids, lengths, vocabulary, term_ids, times)

    return written(texts.mapInArrow(run, INDEX), "index"), n_docs


def document_frequencies(index: DataFrame, wanted: list[bytes]) -> np.ndarray:
    """The number of documents that hold each wanted term, over all shards."""
    import pyarrow as pa

    spark = index.sparkSession
    shared = spark.sparkContext.broadcast({t: i for i, t in enumerate(wanted)})

    def run(batches):
        numbers, total = shared.value, np.zeros(len(shared.value), np.int64)
        for vocabulary, starts in rows_of(batches, "vocabulary", "starts", step=1):
            held = np.diff(np.frombuffer(starts, "<i8"))
            at = [(numbers[t], i) for i, t in enumerate(vocabulary.split(b" ")) if t in numbers]
            if at:
                term, place = np.array(at).T
                total[term] += held[place]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "df"])

    out = np.zeros(len(wanted), np.int64)
    for r in index.select("vocabulary", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df
    return out


def best(scores: np.ndarray, unnamed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of the highest scores above 0, in order: equal scores by id, null ids last. Ties at the border all compete."""
    keep = np.flatnonzero(scores > 0)
    if len(keep) > k:
        top = keep[np.argpartition(scores[keep], len(keep) - k)[len(keep) - k :]]
        keep = np.flatnonzero(scores >= scores[top].min())
    order = keep[np.lexsort((ids[keep], unnamed[keep], -scores[keep]))][:k]
    return scores[order], unnamed[order], ids[order]


def search_block(index: DataFrame, n_docs: int, queries: list[tuple[int, list[bytes]]], k: int) -> DataFrame:
    """queries (q, terms) -> (q, top): at most k (lost: minus the score, unnamed, doc_id) for each query that finds any."""
    import pyarrow as pa

    wanted = sorted({t for _, ts in queries for t in ts})
    df = document_frequencies(index, wanted)
    weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) if x else 0 for x in df]
    number = {t: i for i, t in enumerate(wanted)}
    asked = [(q, [(number[t], times * weight[number[t]]) for t, times in Counter(ts).items() if weight[number[t]]]) for q, ts in queries]
    shared = index.sparkSession.sparkContext.broadcast((number, asked))

    def run(batches):
        from pyspark import TaskContext

        number, asked = shared.value
        tops: dict[int, tuple] = {}
        for ids, vocabulary, starts, places, impacts in rows_of(batches, "ids", "vocabulary", "starts", "places", "impacts", step=1):
            here = {number[t]: i for i, t in enumerate(vocabulary.split(b" ")) if t in number}
            starts, places, impacts = np.frombuffer(starts, "<i8"), np.frombuffer(places, "<u4"), np.frombuffer(impacts, "<u4").astype(np.int64)
            unnamed = np.array([x is None for x in ids])
            names = np.array([0 if x is None else x for x in ids], np.int64)
            for q, weights in asked:
                scores = np.zeros(len(ids), np.int64)
                for term, w in weights:
                    at = here.get(term)
                    if at is not None:
                        a, b = starts[at], starts[at + 1]
                        scores[places[a:b]] += w * impacts[a:b]  # a document stands once in a term's row
                found = best(scores, unnamed, names, k)
                if len(found[0]):
                    tops[q] = best(*(np.concatenate(x) for x in zip(tops[q], found, strict=True)), k) if q in tops else found
        part = TaskContext.get().partitionId()
        rows = [{"part": part, "q": q, "top": [{"lost": -s, "unnamed": u, "doc_id": None if u else i} for s, u, i in zip(*(x.tolist() for x in top), strict=True)]} for q, top in tops.items()]
        top_type = pa.list_(pa.struct([("lost", pa.int64()), ("unnamed", pa.bool_()), ("doc_id", pa.int64())]))
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64()), ("q", pa.int64()), ("top", top_type)]))

    tops, parts = index.mapInArrow(run, TOPS), max(1, index.rdd.getNumPartitions())
    while parts > 1:
        lists = F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, k)
        tops = tops.groupBy("q", F.expr(f"part div {FAN_IN}").alias("part")).agg(lists.alias("top"))
        parts = -(-parts // FAN_IN)
    return tops.select("q", "top")


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The k best documents (doc_id, text) for each row of items (item_id, text): item_id, rank, doc_id, score.

    Only scores above 0 count; equal scores are ranked by id, null ids last. Null texts have no terms, and items
    without terms find nothing. Rows that repeat an id, or id and text, are documents of their own, as are repeated
    items queries of their own. An empty table on either side gives no rows. Other columns are not read.
    """
    index, n_docs = build_index(docs)
    asked = items.select(items["item_id"].alias("item_id"), text_column(items).alias("text")).withColumn("q", F.monotonically_increasing_id())
    asked = written(asked, "queries")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "text").collect()  # about QUERY_BYTES
        tops = search_block(index, n_docs, [(r.q, terms(r.text)) for r in mine], k)
        found = tops if found is None else found.unionByName(tops)
    ranked = found.join(asked.select("q", "item_id"), "q").select("item_id", F.posexplode("top").alias("at", "hit"))
    return ranked.select("item_id", (F.col("at") + 1).alias("rank"), "hit.doc_id", (-F.col("hit.lost")).alias("score"))
