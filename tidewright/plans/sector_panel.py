"""The pooled sector panel in ten modes, and the live feature rows: a row for each sector and complete session.

Bars are symbol, date, open, high, low, close, volume. Shuffles: by symbol for everything rolling, by date for everything
across symbols; what context symbols add is read inside the date's partition, so no context table is joined.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.clean import LIVE_START, infinite
from tidewright.operators import cross
from tidewright.operators import rolling as r
from tidewright.operators.asof import asof

# The universe, the names and order of columns, and the least history of a row.
SECTORS = ["XLB", "XLC", "XLE", "XLF", "XLI", "XLK", "XLP", "XLRE", "XLU", "XLV", "XLY"]
CONTEXT = ["SPY", "QQQ", "IWM", "TLT", "HYG", "GLD", "USO"]
LIVE = (
    "return_1 return_3 return_6 return_12 rolling_mean_return_6 rolling_mean_return_12 rolling_volatility_6 rolling_volatility_12 rolling_volatility_24 relative_volume_20 "
    "close_to_sma_12 close_to_sma_24 high_low_range_1 rolling_high_low_range_12 SPY_return_1 SPY_return_3 SPY_return_6 QQQ_return_1 QQQ_return_3 QQQ_return_6 "
    "IWM_return_1 IWM_return_3 IWM_return_6 TLT_return_1 TLT_return_6 HYG_return_1 HYG_return_6 GLD_return_1 GLD_return_6 USO_return_1 USO_return_6 "
    "sector_minus_SPY_return_1 sector_minus_SPY_return_3 sector_minus_SPY_return_6 sector_minus_QQQ_return_1 sector_minus_QQQ_return_6 "
    "sector_return_rank_1 sector_return_rank_3 sector_return_rank_6 sector_volatility_rank_12 rolling_correlation_SPY_24 rolling_beta_SPY_24 rolling_correlation_QQQ_24"
).split()
BASE = [*LIVE, "sector_id"]
RICH = ["sector_intraday_return_1", "sector_overnight_gap_1", *(f"cross_sectional_{f}_{n}" for n in (1, 3, 6) for f in ("mean_return", "dispersion_return", "breadth_up")), "SPY_intraday_return_1", "SPY_overnight_gap_1", "QQQ_intraday_return_1", "QQQ_overnight_gap_1"]
GAP = ["sector_overnight_gap_1", "sector_minus_SPY_overnight_gap_1", "sector_minus_beta_SPY_overnight_gap_1", "SPY_overnight_gap_1", "QQQ_overnight_gap_1"]
LONG = "return_24 return_60 return_120 return_252 rolling_mean_return_24 rolling_volatility_60 close_to_sma_60 close_to_sma_120 close_to_sma_252 SPY_return_24 SPY_return_60 QQQ_return_24 QQQ_return_60 sector_minus_SPY_return_24 sector_minus_SPY_return_60".split()
VIX = ["vix_level", "vix_change_1", "vix_return_5", "vix_return_20"]
HISTORY, LONG_HISTORY = 60, 252
TARGET = "target_next_close_up"


@dataclass(frozen=True)
class Mode:
    """label: which of the labels is the target; extra: columns behind the base; opening: features are the session
    before's, but for the opening gaps."""

    label: str
    extra: tuple = ()
    opening: bool = False

    @property
    def columns(self) -> list[str]:
        return [*BASE, *self.extra]

    @property
    def history(self) -> int:
        return LONG_HISTORY if self.extra == tuple(LONG) else HISTORY


MODES = {
    "excess": Mode("excess_up"), "top": Mode("top"), "bottom": Mode("bottom"), "close-direction": Mode("close_up"), "rich-direction": Mode("close_up", tuple(RICH)),
    "open-gap-direction": Mode("day_up", tuple(GAP), True), "intraday-direction": Mode("intraday_up", tuple(GAP), True), "long-direction": Mode("close_up", tuple(LONG)),
    "context-direction": Mode("close_up", tuple(VIX)), "open-next-close-direction": Mode("open_to_close_up", tuple(GAP), True),
}


def squares(x: str, y: str, k: int) -> Column:
    return F.covar_samp(x, y).over(r.over(k)) * (k - 1)


def correlation(bench: str, k: int, live: bool) -> Column:
    """Live: null where a side hardly varies; in panels the product of the squares has a floor instead."""
    x, y = squares("r1", "r1", k), squares(bench, bench, k)
    if live:
        return F.when((x > 1e-14) & (y > 1e-14), squares("r1", bench, k) / F.sqrt(x * y))
    return squares("r1", bench, k) / F.sqrt(F.greatest(x * y, F.lit(1e-20)))


def beta(bench: str, k: int, live: bool) -> Column:
    y = squares(bench, bench, k)
    return F.when(y > 1e-14, squares("r1", bench, k) / y) if live else squares("r1", bench, k) / F.greatest(y, F.lit(1e-20))


def at(symbol: str, c: str) -> Column:
    """A symbol's value on the row's date."""
    return F.max(F.when(F.col("symbol") == symbol, F.col(c))).over(Window.partitionBy("date"))


def complete(bars: DataFrame) -> DataFrame:
    """The universe's bars on sessions that all its symbols have."""
    known = bars.where(F.col("symbol").isin(SECTORS + CONTEXT))
    symbols = F.size(F.collect_set("symbol").over(Window.partitionBy("date")))
    return known.withColumn("_symbols", symbols).where(F.col("_symbols") == len(SECTORS + CONTEXT)).drop("_symbols")


def by_symbol(bars: DataFrame, live: bool, long: bool, horizon: int = 1) -> DataFrame:
    """Everything that needs a symbol's own rows and the benchmarks' returns: one window order, so one sort.

    A window that lacks rows gives null. _ahead is the close of `horizon` sessions later, _move from the next open to it.
    """
    rows = r.with_returns(complete(bars))
    rows = rows.withColumns({f"{b}_r1": at(b, "r1") for b in ("SPY", "QQQ")})
    ahead = F.lead("close", horizon).over(r.order())
    k24 = F.count("r1").over(r.over(24)) == 24
    out = {
        "position": F.row_number().over(r.order()) - 1,
        **{f"return_{n}": r.log_return(n) for n in (1, 3, 6, 12)},
        **{f"rolling_mean_return_{k}": r.mean_return(k) for k in (6, 12)},
        **{f"rolling_volatility_{k}": r.volatility(k) for k in (6, 12, 24)},
        "relative_volume_20": r.relative_volume("before" if live else "floored"),
        **{f"close_to_sma_{k}": r.over_average(k) for k in (12, 24)},
        "high_low_range_1": r.day_range(), "rolling_high_low_range_12": r.mean_range(12),
        "rolling_correlation_SPY_24": F.when(k24, correlation("SPY_r1", 24, live)), "rolling_beta_SPY_24": F.when(k24, beta("SPY_r1", 24, live)),
        "rolling_correlation_QQQ_24": F.when(k24, correlation("QQQ_r1", 24, live)),
        "intraday": r.intraday(), "gap": r.log_gap(),
        "_ahead": ahead, "_before": r.lag("close"), "_move": F.ln(F.try_divide(ahead, F.lead("open", 1).over(r.order()))),
    }
    if long:
        out |= {f"return_{n}": r.log_return(n) for n in (24, 60, 120, 252)} | {f"close_to_sma_{k}": r.over_average(k) for k in (60, 120, 252)}
        out |= {"rolling_mean_return_24": r.mean_return(24), "rolling_volatility_60": r.volatility(60)}
    return rows.select("symbol", "date", "open", "close", *(c.alias(n) for n, c in out.items()))


def across(rows: DataFrame, rich: bool, long: bool) -> DataFrame:
    """Adds the context symbols' values and the ranks among sectors, and keeps the sectors."""
    w = Window.partitionBy("date")
    spans = (1, 3, 6, *((24, 60) if long else ()))
    context = {f"{b}_return_{n}": at(b, f"return_{n}") for b in ("SPY", "QQQ") for n in spans}
    context |= {f"IWM_return_{n}": at("IWM", f"return_{n}") for n in (1, 3, 6)} | {f"{b}_return_{n}": at(b, f"return_{n}") for b in ("TLT", "HYG", "GLD", "USO") for n in (1, 6)}
    context |= {f"{b}_{n}_1": at(b, c) for b in ("SPY", "QQQ") for n, c in (("intraday_return", "intraday"), ("overnight_gap", "gap"))}
    context["_spy"] = at("SPY", "_move")
    rows = rows.withColumns(context).where(F.col("symbol").isin(SECTORS))
    minus = {f"sector_minus_{b}_return_{n}": F.col(f"return_{n}") - F.col(f"{b}_return_{n}") for b, ns in (("SPY", spans), ("QQQ", (1, 6))) for n in ns}
    ranks = {f"sector_return_rank_{n}": cross.rank01(f"return_{n}") for n in (1, 3, 6)} | {"sector_volatility_rank_12": cross.rank01("rolling_volatility_12")}
    number = F.array_position(F.array(*map(F.lit, SECTORS)), F.col("symbol")) - 1
    more = {"sector_id": number.cast("double"), "sector_intraday_return_1": F.col("intraday"), "sector_overnight_gap_1": F.col("gap")}
    if rich:
        for n in (1, 3, 6):
            v = F.col(f"return_{n}")
            more |= {f"cross_sectional_mean_return_{n}": F.avg(v).over(w), f"cross_sectional_dispersion_return_{n}": F.stddev_samp(v).over(w), f"cross_sectional_breadth_up_{n}": F.avg((v > 0).cast("double")).over(w)}
    return rows.withColumns(minus | ranks | more)


def opening(rows: DataFrame) -> DataFrame:
    """Features of the session before beside this session's opening gaps: what is known at 09:30."""
    before = {c: F.lag(c).over(r.order()) for c in BASE}
    gaps = {
        "sector_minus_SPY_overnight_gap_1": F.col("gap") - F.col("SPY_overnight_gap_1"),
        "sector_minus_beta_SPY_overnight_gap_1": F.col("gap") - F.lag("rolling_beta_SPY_24").over(r.order()) * F.col("SPY_overnight_gap_1"),
    }
    return rows.select("symbol", "date", "position", *(c for c in rows.columns if c.endswith("overnight_gap_1")), *(c.alias(n) for n, c in (before | gaps).items()), *LABELS)


LABELS = ["excess_up", "top", "bottom", "close_up", "day_up", "intraday_up", "open_to_close_up"]


def labelled(rows: DataFrame) -> DataFrame:
    """Adds every label; rows without a future go. excess: from the next open to the later close, over the same of SPY."""
    rows = rows.where("_ahead is not null").withColumn("_excess", F.col("_move") - F.col("_spy")).withColumn("_rank", cross.rank01("_excess"))
    above = lambda a, b: (F.col(a) > F.col(b)).cast("int")
    found = {
        "excess_up": (F.col("_excess") > 0).cast("int"), "top": (F.col("_rank") >= 0.7).cast("int"), "bottom": (F.col("_rank") <= 0.3).cast("int"), "close_up": above("_ahead", "close"),
        "day_up": above("close", "_before"), "intraday_up": above("close", "open"), "open_to_close_up": above("_ahead", "open"),
    }
    return rows.withColumns(found)


def with_vix(rows: DataFrame, vix: DataFrame) -> DataFrame:
    """The index's level on or before each date, and its changes along its own dates. vix: date, close, a row a day."""
    w = Window.orderBy("date")
    over = lambda n: F.try_divide(F.col("close"), F.lag("close", n).over(w))
    own = vix.select(F.col("date").alias("_vix"), F.col("close").alias("vix_level"), (over(1) - 1).alias("vix_change_1"), F.ln(over(5)).alias("vix_return_5"), F.ln(over(20)).alias("vix_return_20"))
    days = asof(rows.select("date").distinct(), own, "date", "_vix", [], VIX).drop("_vix")
    return rows.join(days, "date")


def panel(bars: DataFrame, mode: str = "excess", horizon: int = 1, from_year: int = 0, vix: DataFrame | None = None) -> DataFrame:
    """The panel of a mode: date (session and sector, as `2024-01-31|XLK`), the mode's columns, and the target, 0 or 1.

    Sessions that lack a symbol aren't any; the first sessions are history. A value that isn't finite raises.
    """
    m = MODES[mode]
    long, rich = m.extra == tuple(LONG), m.extra == tuple(RICH)
    rows = labelled(across(by_symbol(bars, False, long, horizon), rich, long))
    if m.opening:
        rows = opening(rows)
    if m.extra == tuple(VIX):
        rows = with_vix(rows, vix)
    rows = rows.where((F.col("position") >= m.history) & (F.year("date") >= from_year))
    bad = F.lit(False)
    for c in m.columns:
        bad = bad | infinite(F.col(c))
    target = F.when(bad, F.raise_error(F.lit("a feature of the panel isn't finite")).cast("int")).otherwise(F.col(m.label))
    return rows.select(F.concat_ws("|", F.col("date").cast("string"), "symbol").alias("date"), *m.columns, target.alias(TARGET))


def live_rows(bars: DataFrame) -> DataFrame:
    """(symbol, date) and the 43 live features; a row that lacks any, or has one that isn't finite, is none."""
    rows = across(by_symbol(bars, True, False), False, False)
    bad = F.lit(False)
    for c in LIVE:
        bad = bad | infinite(F.col(c))
    return rows.where(~bad).select("symbol", "date", *LIVE)


def live_events(bars: DataFrame, version: str) -> DataFrame:
    """Feature events: the 43 values of a sector at the end of a bar, with the version and hash of their schema."""
    rows = live_rows(bars)
    return rows.select(
        F.col("symbol").alias("target_symbol"), F.col("date").alias("event_time"), F.lit(version).alias("feature_version"), F.lit(live_schema_hash()).alias("schema_hash"),
        F.array(*map(F.lit, LIVE)).alias("names"), F.array(*LIVE).alias("values"), F.array(*map(F.lit, SECTORS + CONTEXT)).alias("source_symbols"),
    )


def live_schema_hash() -> str:
    """FNV-1a of 64 bits over the names, each with a bar behind it, from the live engine's own starting value."""
    h = LIVE_START
    for b in "".join(n + "|" for n in LIVE).encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"
