"""Exact dedup by heavy-hitter split.

Misra-Gries counters find the digests that may be frequent; one exact aggregate verifies them and finds the row that
stays for each; those winners, at most `counters` rows, are broadcast, so that copies of frequent texts are settled
where they are read. Every other digest has at most rows / counters copies and goes through an ordinary shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import id_key, keep_rows, text_column, written

COUNTERS = 1024


def misra_gries(keys: DataFrame, column: str, counters: int = COUNTERS) -> DataFrame:
    """Candidates (column) that hold every key of more than rows / (counters + 1) rows; at most `counters` of them.

    Each partition runs the counters over its batches; partial tables are merged by the same rule in a tree of
    groups of 64 partitions, so no task sees more than 64 tables.
    """
    import pyarrow as pa

    def shrink(values, counts):
        values, inverse = np.unique(values, return_inverse=True)
        counts = np.bincount(inverse, counts).astype(np.int64)
        if len(counts) > counters:
            counts = counts - np.partition(counts, -counters - 1)[-counters - 1]
        keep = counts > 0
        return values[keep], counts[keep]

    def local(batches):
        from pyspark import TaskContext

        values, counts = np.array([], object), np.array([], np.int64)
        for b in batches:
            new = np.array(b.column(0).to_pylist(), object)
            values, counts = shrink(np.concatenate([values, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(values), pa.int64()), column: pa.array(list(values), pa.string()), "n": pa.array(counts)})

    def merge(pdf):
        values, counts = shrink(pdf[column].to_numpy(object), pdf["n"].to_numpy())
        import pandas as pd

        return pd.DataFrame({"part": int(pdf["part"].iloc[0]) if len(pdf) else 0, column: values, "n": counts})

    schema = f"part long, {column} string, n long"
    tables = keys.select(column).where(F.col(column).isNotNull()).mapInArrow(local, schema)
    parts = max(1, keys.rdd.getNumPartitions())
    while parts > 1:
        tables = tables.withColumn("part", F.expr("part div 64")).groupBy("part").applyInPandas(merge, schema)
        parts = -(-parts // 64)
    return tables.select(column)


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty. Of equal texts the row with the largest id stays, null ids being smallest; of rows
    that repeat id and text, exactly one stays. An empty table gives no rows. Other columns of docs are not read.
    """
    both = settle(docs.select(docs[id_column].alias("id"), F.sha2(text_column(docs, text), 256).alias("digest")), counters)
    return both.select(
        F.col("id").alias(id_column),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("best.back")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def kept_rows(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) that stay: of equal texts, the one with the largest id.

    Null texts count as empty, null ids are smallest; of rows that repeat id and text one stays. An empty table gives
    no rows.
    """
    body = text_column(docs)
    key = id_key(docs["doc_id"], body)
    both = settle(docs.select(docs["doc_id"].alias("id"), F.sha2(body, 256).alias("digest"), *key), counters)
    winners = both.groupBy("id_key", "text_key").agg(F.max(F.col("row") == -F.col("best.back")).alias("kept"), (F.count("*") > 1).alias("repeats"))
    return keep_rows(docs, written(winners.where("kept").select("id_key", "text_key", "repeats"), "winners"))


def settle(digests: DataFrame, counters: int) -> DataFrame:
    """digests (id, digest and others) -> also row, best (id, back: the row that stays, negative) and group_size."""
    others = [c for c in digests.columns if c not in ("id", "digest")]
    digests = written(digests.withColumn("row", F.monotonically_increasing_id()), "digests")
    best, size = F.max(F.struct("id", (-F.col("row")).alias("back"))), F.count("*")
    candidates = misra_gries(digests, "digest", counters)  # at most `counters` rows
    heavy = digests.join(F.broadcast(candidates), "digest", "left_semi").groupBy("digest").agg(best.alias("best"), size.alias("group_size"))
    heavy = F.broadcast(written(heavy, "heavy"))
    found = ["digest", "id", "row", *others, "best", "group_size"]
    settled, rest = digests.join(heavy, "digest").select(found), digests.join(heavy, "digest", "left_anti")
    each = rest.groupBy("digest").agg(best.alias("best"), size.alias("group_size"))
    return settled.unionByName(rest.join(each, "digest").select(found))
