"""Cross-sectional functions: over the symbols of one date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank01(v: str, keys: tuple = ("date",)) -> Column:
    """Average-tie rank scaled to 0..1; 0.5 where there is one symbol only."""
    w = Window.partitionBy(*keys)
    n, ties = F.count(v).over(w), F.count(v).over(Window.partitionBy(*keys, v))
    low = F.rank().over(w.orderBy(F.col(v).asc_nulls_last())) - 1
    return F.when(F.col(v).isNotNull(), F.when(n > 1, (low + (low + ties - 1)) / 2 / (n - 1)).otherwise(0.5))


def spread_of(rows: DataFrame, v: str) -> DataFrame:
    """Per date: mean, sample deviation and share above zero of v."""
    return rows.where(F.col(v).isNotNull()).groupBy("date").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("dispersion"), F.avg((F.col(v) > 0).cast("double")).alias("breadth"))


def against(v: str, bench: str, beta: str | None = None) -> Column:
    return F.col(v) - F.col(bench) * (F.col(beta) if beta else 1.0)


def extreme_label(v: str, high: bool) -> Column:
    """1 where the rank of v is at least 0.7, or at most 0.3."""
    r = rank01(v)
    return F.when(r.isNotNull(), ((r >= 0.7) if high else (r <= 0.3)).cast("int"))


def complete_sessions(rows: DataFrame, n: int, session: str = "date") -> DataFrame:
    """Sessions with exactly n rows of n symbols."""
    return rows.groupBy(session).agg(F.count("*").alias("n"), F.count_distinct("symbol").alias("k")).where((F.col("n") == n) & (F.col("k") == n)).select(session)


def top_hit_rate(rows: DataFrame, score: str, label: str, session: str, tie: str) -> DataFrame:
    """Share of sessions that have a positive whose best-scored row is one; the first best wins ties."""
    per = rows.groupBy(session).agg(F.max_by(label, F.struct(score, -F.col(tie))).alias("hit"), F.max(label).alias("any"))
    return per.where("any = 1").agg(F.count("*").alias("sessions"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def symbol_ids(universe: DataFrame) -> DataFrame:
    """symbol -> its place, from 0, in alphabetical order."""
    return universe.select("symbol").distinct().withColumn("symbol_id", F.row_number().over(Window.orderBy("symbol")) - 1)


def full_universe(rows: DataFrame, n: int) -> DataFrame:
    """Dates on which all n symbols have a row."""
    return rows.groupBy("date").agg(F.count_distinct("symbol").alias("k")).where(F.col("k") == n).select("date")
