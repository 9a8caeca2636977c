"""The served queries, as functions that return DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.bars import merge_live
from tidewright.session import keep_first

INTERVALS = ("1m", "5m")


def checked(interval: str = "1m", limit: int = 120, date: str | None = None) -> None:
    """Raises ValueError with a code for a request that can't be served."""
    if interval not in INTERVALS:
        raise ValueError("INVALID_INTERVAL")
    if not 1 <= limit <= 2000:
        raise ValueError("INVALID_LIMIT")
    if date is not None and not re.fullmatch(r"\d{4}-\d{2}-\d{2}", date):
        raise ValueError("INVALID_DATE")


def request_fault(interval: Column, limit: Column, date: Column) -> Column:
    """The code with which `checked` refuses a request, as a column; null if it can be served."""
    known = interval.isin(*INTERVALS)
    return F.when(interval.isNull() | ~known, "INVALID_INTERVAL").when(limit.isNull() | ~limit.between(1, 2000), "INVALID_LIMIT").when(date.isNotNull() & ~date.rlike(r"^\d{4}-\d{2}-\d{2}$"), "INVALID_DATE")


def extrapolated(rows: DataFrame, snapshots: DataFrame, date: str, member: str) -> DataFrame:
    """Adds extrapolated: the row's date is past the last snapshot, and that snapshot has the row's member."""
    last = snapshots.agg(F.max("snapshot").alias("_last"))
    held = snapshots.join(F.broadcast(last), F.col("snapshot") == F.col("_last"), "left_semi").select(F.col("symbol").alias(member)).distinct().withColumn("_held", F.lit(True))
    joined = rows.join(held, member, "left").join(F.broadcast(last), F.lit(True))
    return joined.withColumn("extrapolated", (F.col(date) > F.col("_last")) & F.col("_held").isNotNull()).select(*rows.columns, "extrapolated")


def chart_rows(bars: DataFrame, start_ms: str = "bar_start_ms") -> DataFrame:
    """Bars as the chart export has them: an ISO instant with milliseconds, prices, volume."""
    at = F.date_format(F.timestamp_millis(start_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return bars.select(at.alias("timestamp"), "open", "high", "low", "close", "volume")


def prediction_rows(scored: DataFrame, subset: str) -> DataFrame:
    """Predictions out of sample in the order of the export's columns. scored: date, label, p, calibrated."""
    return scored.select(F.lit(subset).alias("feature_subset"), "date", "label", F.col("p").alias("probability_positive_label"), F.col("calibrated").alias("calibrated_probability_positive_label"))


def universe(spark: SparkSession, d: str) -> DataFrame:
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    return n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("category"), F.col("n_name").alias("symbol")).orderBy("category", "symbol")


def latest_bar(found: DataFrame) -> DataFrame:
    return keep_first(found, ["symbol"], [F.desc("bar_end_ms")])


def latest_bars(found: DataFrame, symbol: str, limit: int = 120) -> DataFrame:
    """A symbol's newest bars, in order of time."""
    checked(limit=limit)
    return found.where(F.col("symbol") == symbol).orderBy(F.desc("bar_start_ms")).limit(limit).orderBy("bar_start_ms")


def bars_between(found: DataFrame, symbol: str, from_ms: int, to_ms: int, limit: int = 120, source: str = "stored") -> DataFrame:
    """Bars of a span: stored ones lie in it whole; live ones need only touch it."""
    inside = (F.col("bar_start_ms") >= from_ms) & (F.col("bar_end_ms") <= to_ms) if source == "stored" else (F.col("bar_end_ms") >= from_ms) & (F.col("bar_start_ms") < to_ms)
    return latest_bars(found.where(inside), symbol, limit)


def snapshot(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Each symbol's newest bar, from either, and where it is from."""
    return latest_bar(merge_live(stored, live)).select("symbol", "bar_start_ms", "close", "origin")


def news_snapshot(articles: DataFrame, key: str, value: str, cutoff_ms: int, limit: int = 20) -> DataFrame:
    """Newest articles of a symbol up to a cutoff."""
    return articles.where((F.col(key) == value) & (F.col("published_ms") <= cutoff_ms)).orderBy(F.desc("published_ms")).limit(limit)


def prediction(features: DataFrame, expected_hash: int, names: list[str], p: str = "p") -> DataFrame:
    """Probabilities and their sign; refuses features whose names aren't those the model knows."""
    from tidewright.functions.clean import schema_hash

    if schema_hash(names) != expected_hash:
        raise ValueError("FEATURE_SCHEMA_MISMATCH")
    q = F.greatest(F.least(F.col(p), F.lit(1.0)), F.lit(0.0))
    return features.select("symbol", "date", q.alias("probability"), F.when(q >= 0.5, "Bullish").otherwise("Bearish").alias("signal"))


def gated(events: DataFrame, target: str, version: str, expected_hash: str, names: list[str]) -> DataFrame:
    """events (target_symbol, feature_version, schema_hash, names, values) with reject_reason: null if a model of that
    target, version and schema may score them, else what doesn't fit, the first of schema, order, count and finite."""
    schema = (F.col("target_symbol") == target) & (F.col("feature_version") == version) & (F.col("schema_hash") == expected_hash)
    finite = F.forall("values", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    reason = (
        F.when(~F.coalesce(schema, F.lit(False)), "schema").when(~F.coalesce(F.col("names") == F.array(*map(F.lit, names)), F.lit(False)), "order")
        .when(F.coalesce(F.size("values"), F.lit(-1)) != len(names), "count").when(~finite, "finite")
    )
    return events.withColumn("reject_reason", reason)


def status(found: DataFrame, now_ms: int) -> DataFrame:
    return found.agg(F.count_distinct("symbol").alias("symbols"), F.max("bar_end_ms").alias("newest_ms"), (F.lit(now_ms) - F.max("bar_end_ms")).alias("age_ms"), F.count("*").alias("n_bars"))


def latest_signals(signals: DataFrame) -> DataFrame:
    """The newest run of each (symbol, date)."""
    return keep_first(signals, ["symbol", "date"], [F.desc("generated_at")])


def bars_up_to(daily: DataFrame, cutoff_ms: int, lookback: int) -> DataFrame:
    """Daily bars whose close is at or before the cutoff, each symbol's newest `lookback`: no look ahead."""
    from tidewright.functions.clean import close_ms
    from tidewright.operators.dedup import latest_n

    return latest_n(daily.where(close_ms(F.col("date")) <= cutoff_ms), ["symbol"], [F.desc("date")], lookback)
