"""Event-time bars from trades. Trades have symbol, price, volume, ts_ms, seq (order of arrival) and event_id; those of
one seq arrive in the order of event_id."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import keep_first, running_max

MINUTE_MS = 60_000
LATENESS_MS = 5_000
HORIZON_MS = 15 * MINUTE_MS
SPAN = 1_000_000
#: The live store's intervals.
LIVE = {"1m": MINUTE_MS, "5m": 5 * MINUTE_MS}


def bars(trades: DataFrame, width_ms: int = MINUTE_MS, tie: str = "first") -> DataFrame:
    """Open, high, low, close, volume and count of each symbol and span of time.

    Of trades at one instant, the first to arrive opens the bar; it closes it too (tie="first", as the aggregator
    does), or the last to arrive does (tie="last", as the live store does). A trade without a price neither opens nor
    closes, and one without seq stands after all of its instant, as in SQL.
    """
    start = F.floor(F.col("ts_ms") / width_ms) * width_ms
    seq = F.col("seq")
    at = lambda place: F.when(F.col("price").isNotNull(), F.struct("ts_ms", place.isNull(), place))
    out = trades.groupBy("symbol", start.cast("long").alias("bar_start_ms")).agg(
        F.min_by("price", at(seq)).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at(-seq if tie == "first" else seq)).alias("close"),
        F.sum("volume").alias("volume"),
        F.count("*").alias("trade_count"),
        F.min("ts_ms").alias("first_trade_ms"),
        F.max("ts_ms").alias("last_trade_ms"),
    )
    return out.withColumn("bar_end_ms", F.col("bar_start_ms") + width_ms)


def first_seen(trades: DataFrame, horizon_ms: int = HORIZON_MS) -> DataFrame:
    """Drops a trade whose event_id came before, at most horizon_ms of event time earlier."""
    from pyspark.sql import Window

    w = Window.partitionBy("event_id").orderBy("seq")
    gap = F.col("ts_ms") - F.lag("ts_ms").over(w)
    return trades.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > horizon_ms)).drop("_gap")


def mark_late(trades: DataFrame, width_ms: int = MINUTE_MS, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Adds late: the symbol's watermark, its latest earlier arrival less the lateness, has passed the trade's bar."""
    seen = running_max(trades, "symbol", "seq", "ts_ms", "_seen", SPAN, tie="event_id")
    end = F.floor(F.col("ts_ms") / width_ms) * width_ms + width_ms
    return seen.withColumn("late", F.coalesce(F.col("_seen") - lateness_ms >= end, F.lit(False))).drop("_seen")


def late_trades(trades: DataFrame, width_ms: int = MINUTE_MS) -> DataFrame:
    """The late trades with a reason: their bar was final, or it never had one and lateness is over the limit."""
    marked = mark_late(trades, width_ms)
    start = (F.floor(F.col("ts_ms") / width_ms) * width_ms).cast("long")
    marked = marked.withColumn("bar_start_ms", start)
    final = marked.where("not late").groupBy("symbol", "bar_start_ms").agg(F.min("seq").alias("_first"))
    found = marked.where("late").join(final, ["symbol", "bar_start_ms"], "left")
    reason = F.when(F.col("_first") < F.col("seq"), "bar already finalized").otherwise("lateness exceeded configured threshold")
    return found.select("event_id", "symbol", "ts_ms", "seq", "bar_start_ms", reason.alias("reason"))


def finalised(found: DataFrame, trades: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Bars that end at or before their own symbol's watermark at the end of the input."""
    marks = trades.groupBy("symbol").agg((F.max("ts_ms") - lateness_ms).alias("watermark_ms"))
    return found.join(marks, "symbol").where("bar_end_ms <= watermark_ms").drop("watermark_ms")


def roll_up(minutes: DataFrame, width_ms: int = 5 * MINUTE_MS) -> DataFrame:
    """Wider bars from minute bars, never from trades."""
    start = (F.floor(F.col("bar_start_ms") / width_ms) * width_ms).cast("long")
    out = minutes.groupBy("symbol", start.alias("start")).agg(
        F.min_by("open", "bar_start_ms").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "bar_start_ms").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("trade_count").alias("trade_count"),
        F.min("first_trade_ms").alias("first_trade_ms"),
        F.max("last_trade_ms").alias("last_trade_ms"),
    )
    return out.withColumnRenamed("start", "bar_start_ms").withColumn("bar_end_ms", F.col("bar_start_ms") + width_ms)


def live_bars(trades: DataFrame, width_ms: int = MINUTE_MS) -> DataFrame:
    """The live store's bars: a trade of an earlier bar than the symbol's newest is ignored; the last arrival closes."""
    seen = running_max(trades, "symbol", "seq", "ts_ms", "_seen", SPAN, tie="event_id")  # whatever the width, so that widths share its shuffle
    of = lambda c: F.floor(F.col(c) / width_ms)
    return bars(seen.where(F.col("_seen").isNull() | (of("ts_ms") >= of("_seen"))), width_ms, "last")


def live_store(trades: DataFrame) -> DataFrame:
    """The live store's bars of both intervals, each built from the trades: one too old for its minute may count in the five."""
    return functools.reduce(DataFrame.unionByName, (live_bars(trades, width).withColumn("interval", F.lit(name)) for name, width in LIVE.items()))


def aligned(found: DataFrame, symbols: list[str]) -> DataFrame:
    """For each bar end: whether every required symbol has a bar, and which are missing, sorted and joined by commas."""
    have = found.where(F.col("symbol").isin(symbols)).groupBy("bar_end_ms").agg(F.array_sort(F.collect_set("symbol")).alias("have"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, symbols)), "have"))
    return have.select("bar_end_ms", (F.size(missing) == 0).alias("complete"), F.array_join(missing, ",").alias("missing"), F.size("have").cast("long").alias("n_symbols"))


def bar_faults(found: DataFrame) -> DataFrame:
    """Adds reject_code, null for a valid bar: the first rule that it breaks."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    code = F.when(F.col("symbol").isNull() | (F.trim("symbol") == ""), "EMPTY_SYMBOL")
    code = code.when(F.col("bar_start_ms") <= 0, "INVALID_START").when(F.col("bar_end_ms") <= F.col("bar_start_ms"), "INVALID_END")
    for c in ("open", "high", "low", "close"):
        code = code.when(bad(c) | (F.col(c) <= 0), "INVALID_" + c.upper())
    code = code.when(bad("volume") | (F.col("volume") < 0), "INVALID_VOLUME")
    code = code.when((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close", "high")), "INVALID_RANGE")
    return found.withColumn("reject_code", code.when(F.col("trade_count") <= 0, "EMPTY_BAR"))


def merge_live(stored: DataFrame, live: DataFrame, limit: int | None = None) -> DataFrame:
    """Stored and live bars in one, live ones winning; with a limit, each symbol's latest."""
    from pyspark.sql import Window

    both = stored.withColumn("_from", F.lit(1)).unionByName(live.withColumn("_from", F.lit(0)))
    one = keep_first(both, ["symbol", "bar_start_ms"], ["_from"]).withColumn("origin", F.when(F.col("_from") == 0, "live").otherwise("stored")).drop("_from")
    if limit is None:
        return one
    w = Window.partitionBy("symbol").orderBy(F.desc("bar_start_ms"))
    return one.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= limit).drop("_nth")


def daily_from_bars(found: DataFrame, zone: str = "America/New_York") -> DataFrame:
    """Each symbol's last close, by time, and volume of the exchange's calendar days."""
    day = F.to_date(F.from_utc_timestamp(F.timestamp_millis("bar_start_ms"), zone))
    return found.groupBy("symbol", day.alias("date")).agg(F.min_by("open", "bar_end_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar_end_ms").alias("close"), F.sum("volume").alias("volume"))


def completed_and_today(completed: DataFrame, today: DataFrame) -> DataFrame:
    """Completed days, and those of today that aren't completed."""
    return completed.unionByName(today.join(completed.select("symbol", "date"), ["symbol", "date"], "left_anti"))


#: The symbols that made-up trades take in turn.
IN_TURN = "XLC XLY XLP XLE XLF XLV XLI XLB XLRE XLK XLU SPY QQQ IWM TLT HYG GLD USO".split()


def synthetic_trades(rows: DataFrame, seq: str, ts_ms: str, symbols: list[str] = IN_TURN) -> DataFrame:
    """A made-up trade for each row, by its number `seq`: symbols in turn, prices and volumes that come again."""
    i = F.col(seq)
    symbol = F.element_at(F.array(*map(F.lit, symbols)), (F.pmod(i, F.lit(len(symbols))) + 1).cast("int"))
    name = F.concat(F.lit("benchmark-"), symbol, F.lit("-"), i.cast("string"))
    return rows.select(name.alias("event_id"), symbol.alias("symbol"), (630 + F.pmod(i, F.lit(100)) / 100).alias("price"), (100 + F.pmod(i, F.lit(900))).cast("double").alias("volume"), F.col(ts_ms).alias("ts_ms"), i.alias("seq"))
