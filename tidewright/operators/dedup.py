"""Which of several rows stays: latest, first, last version, and rows merged into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import keep_first


def latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return keep_first(rows, keys, order)


def latest_n(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def by_url_or_hash(rows: DataFrame, order: list) -> DataFrame:
    """Keeps the first row of each URL, or of each content hash where there is no URL."""
    key = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.col("content_hash"))
    return keep_first(rows.withColumn("_key", key), ["_key"], order).drop("_key")


def select_versions(versions: DataFrame, order: list[str]) -> DataFrame:
    """The version of each (story, sector, symbol, session) that holds in the end.

    versions: story, sector, symbol, session, withdrawn, and what orders them. A withdrawal without a symbol counts
    for every (sector, symbol) its story has had; it erases the session's choice, which a later version may set again.
    """
    known = versions.where("symbol is not null").select("story", "sector", "symbol").distinct()
    broad = versions.where("withdrawn and symbol is null").drop("sector", "symbol").join(known, "story")
    every = versions.where("symbol is not null").unionByName(broad)
    last = keep_first(every, ["story", "sector", "symbol", "session"], [F.desc(c) for c in order])
    return last.where("not withdrawn")


def merge_tags(rows: DataFrame, key: str, tags: str, order: str) -> DataFrame:
    """One row for each key: the first row's other columns, and all rows' tags, each once, in order of the alphabet."""
    rest = [c for c in rows.columns if c not in (key, tags)]
    out = rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_first"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(tags)))).alias(tags))
    return out.select(key, "_first.*", tags)


def sample_strata(rows: DataFrame, strata: list, order: str, cap: int) -> DataFrame:
    """The first cap rows of each stratum: a sampling operator."""
    w = Window.partitionBy(*strata).orderBy(order)
    return rows.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= cap).drop("_nth")


def count_by_reason(tagged: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """Rows, kept rows and rows for each reason: a manifest's counters."""
    return tagged.groupBy(F.coalesce(F.col(reason), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def duplicate_counts(rows: DataFrame, key: str, valid: Column) -> DataFrame:
    """One row: valid distinct, duplicate and invalid rows."""
    good = rows.where(valid).groupBy(key).agg(F.count("*").alias("k"))
    counts = good.agg(F.count("*").alias("kept"), F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicates"))
    return counts.crossJoin(rows.agg(F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid")))
