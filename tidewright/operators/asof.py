"""As-of and interval joins, which Spark has no public form of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordering import same, saved


def asof(left: DataFrame, right: DataFrame, on: str, right_on: str, by: list[str], values: list[str], strict: bool = False, forward: bool = False, spread: bool = False) -> DataFrame:
    """Adds the values of right's last row at or before left's `on` (before, if strict), or its first at or after.

    One union and one window by key: no pair of rows is made but the one returned. right has one row for each key
    and time; an order of kinds puts its rows before left's at the same time, or behind them if strict.

    With spread, rows are dealt by ranges of key and time, and what a range starts with is the last value of the ranges
    before it: for keys that hold so many rows that one task would be long at them.
    """
    keys = by or ["_one"]
    payload = F.struct(F.col(right_on).alias("_at"), *values)
    rest = [c for c in left.columns if c not in keys]
    a = left.withColumn("_one", F.lit(1)).select(*keys, F.col(on).alias("_t"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"))
    a = a.withColumn("_value", F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType))
    b = right.withColumn("_one", F.lit(1)).select(*keys, F.col(right_on).alias("_t"), F.lit(2 if strict else 0).alias("_kind"), payload.alias("_value"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = [F.desc("_t") if forward else F.asc("_t"), F.asc("_kind")]
    if spread:
        found = carried(both, keys, order).where("_kind = 1")
    else:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(w)).where("_kind = 1")
    return found.select(*([] if keys == ["_one"] else keys), "_row.*", F.col("_found._at").alias(right_on), *(F.col(f"_found.{v}").alias(v) for v in values))


def carried(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Adds _found, the last _value up to each row by keys in the order given, over ranges of rows."""
    by = [*map(F.col, keys), *order]
    placed = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    placed = saved(placed, "carried").withColumn("_part", F.shiftright("_place", 33))
    last = placed.groupBy(*keys, "_part").agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_place"))).alias("_last"))  # a row for each range that a key has rows in
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = [*keys, "_part"]
    parts = last.select(*(F.col(n).alias(f"_of_{n}") for n in names), F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = Window.partitionBy(*keys, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumn("_here", F.last("_value", ignorenulls=True).over(inside))
    here = here.join(parts, same(here, parts, names))
    return here.withColumn("_found", F.coalesce("_here", "_carried"))


def snapshot_members(rows: DataFrame, holdings: DataFrame, on: str, strict: bool = True) -> DataFrame:
    """Rows whose symbol is in the whole latest snapshot before (or at) their date; never by symbol alone.

    holdings: snapshot, symbol, weight. A symbol that the latest snapshot lacks has left.
    """
    days = rows.select(on).distinct()
    dated = asof(days, holdings.select("snapshot").distinct(), on, "snapshot", [], [], strict)
    return rows.join(dated.where("snapshot is not null"), on).join(holdings, ["snapshot", "symbol"])


def interval_members(rows: DataFrame, spells: DataFrame, on: str) -> DataFrame:
    """Rows whose symbol has a spell with available_from before the date and the date within it; the newest spell wins.

    Equal rows stay as many as they are: (symbol, date) pairs are settled once each, and rows are joined to them. A
    pair meets all spells of its symbol, of which there are as many as the symbol has been listed.
    """
    days = rows.select("symbol", on).distinct()
    found = days.join(spells, "symbol").where((F.col("available_from") < F.col(on)) & (F.col("effective_from") <= F.col(on)) & (F.col("effective_to") >= F.col(on)))
    values = [c for c in spells.columns if c != "symbol"]
    newest = found.groupBy("symbol", on).agg(F.max_by(F.struct(*values), F.struct("available_from", "effective_from")).alias("_spell"))
    return rows.join(newest, ["symbol", on]).select(*rows.columns, "_spell.*")


def session_table(sessions: DataFrame) -> DataFrame:
    """session, previous and next session of a calendar. A calendar is one row a day: small."""
    w = Window.orderBy("session")
    return sessions.select("session").distinct().select("session", F.lag("session").over(w).alias("previous"), F.lead("session").over(w).alias("next"))


def next_session(rows: DataFrame, sessions: DataFrame, day: Column, inclusive: bool = True) -> DataFrame:
    """Adds session, the first on or after the day (after it, if not inclusive), and the session before that one.

    Every calendar day is spelt out with its session, so this is an equi-join with a broadcast of one row a day.
    """
    table = session_table(sessions).select("session", "previous")
    first = table.agg(F.min("session")).first()[0]
    days = table.select("session", F.col("previous").alias("previous_session"), F.explode(F.sequence(F.coalesce(F.date_add("previous", 1), F.col("session")), F.col("session"))).alias("_day"))
    wanted = day if inclusive else F.date_add(day, 1)
    wanted = F.greatest(wanted, F.lit(first)) if first is not None else wanted
    return rows.withColumn("_day", wanted).join(F.broadcast(days), "_day", "left").drop("_day")


def cutoff_session(rows: DataFrame, sessions: DataFrame, instant_ms: Column, local_day: Column, cutoff_ms) -> DataFrame:
    """Adds session, the first whose cutoff is at or after the instant. local_day: the instant's day at the exchange."""
    return next_session(rows, sessions, F.when(instant_ms <= cutoff_ms(local_day), local_day).otherwise(F.date_add(local_day, 1)))


def preopen_session(rows: DataFrame, sessions: DataFrame, instant_ms: Column, local_day: Column, close_ms, cutoff_ms) -> DataFrame:
    """Rows after a session's close and up to the next one's cutoff, with that session; the rest, of the day itself, go."""
    found = cutoff_session(rows, sessions, instant_ms, local_day, cutoff_ms)
    return found.where(F.col("previous_session").isNotNull() & (instant_ms > close_ms(F.col("previous_session"))))
