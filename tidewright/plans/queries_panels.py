"""The sector panel in its ten modes and the live feature rows, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.plans import sector_panel as p
from tidewright.plans import stand_ins as s

O = "PARTITION BY symbol ORDER BY date"  # noqa: E741
UNIVERSE = """, u AS (SELECT * FROM sector_bars WHERE date IN (SELECT date FROM sector_bars GROUP BY date HAVING count(DISTINCT symbol) = 18)),
    r AS (SELECT *, row_number() OVER o - 1 AS position, ln(close / lag(close) OVER o) AS r1 FROM u WINDOW o AS (PARTITION BY symbol ORDER BY date)),
    c AS (SELECT r.*, a.r1 AS spy, b.r1 AS qqq FROM r JOIN r a ON a.date = r.date AND a.symbol = 'SPY' JOIN r b ON b.date = r.date AND b.symbol = 'QQQ')"""


def rolled(live: bool) -> str:
    """CTE f: what a symbol's own rows give; v<k> is a frame of k rows."""
    frames = "".join(f", v{k} AS ({O} ROWS {k - 1} PRECEDING)" for k in (6, 12, 24, 60, 120, 252))
    full = lambda x, k, of="r1": f"CASE WHEN count({of}) OVER v{k} = {k} THEN {x} END"
    ss = lambda a, b: f"(covar_pop({a}, {b}) OVER v24 * 24)"
    if live:
        volume = "CASE WHEN avg(volume) OVER before > 0 THEN volume / avg(volume) OVER before END"
        both = lambda b: f"CASE WHEN {ss('r1', 'r1')} > 1e-14 AND {ss(b, b)} > 1e-14 THEN {ss('r1', b)} / sqrt({ss('r1', 'r1')} * {ss(b, b)}) END"
        slope = f"CASE WHEN {ss('spy', 'spy')} > 1e-14 THEN {ss('r1', 'spy')} / {ss('spy', 'spy')} END"
    else:
        volume = "volume / greatest(avg(volume) OVER before, 1e-8)"
        both = lambda b: f"{ss('r1', b)} / sqrt(greatest({ss('r1', 'r1')} * {ss(b, b)}, 1e-20))"
        slope = f"{ss('r1', 'spy')} / greatest({ss('spy', 'spy')}, 1e-20)"
    out = [
        *(f"ln(close / lag(close, {n}) OVER o) AS return_{n}" for n in (1, 3, 6, 12, 24, 60, 120, 252)),
        *(f"{full(f'avg(r1) OVER v{k}', k)} AS rolling_mean_return_{k}" for k in (6, 12, 24)),
        *(f"{full(f'stddev_samp(r1) OVER v{k}', k)} AS rolling_volatility_{k}" for k in (6, 12, 24, 60)),
        f"CASE WHEN count(*) OVER before = 20 THEN {volume} END AS relative_volume_20",
        *(f"{full(f'close / avg(close) OVER v{k} - 1', k, '*')} AS close_to_sma_{k}" for k in (12, 24, 60, 120, 252)),
        "(high - low) / close AS high_low_range_1", f"{full('avg((high - low) / close) OVER v12', 12, '*')} AS rolling_high_low_range_12",
        f"{full(both('spy'), 24)} AS rolling_correlation_SPY_24", f"{full(slope, 24)} AS rolling_beta_SPY_24", f"{full(both('qqq'), 24)} AS rolling_correlation_QQQ_24",
        "ln(close / open) AS intraday", "ln(open / lag(close) OVER o) AS gap",
    ]
    return f", f AS (SELECT symbol, date, position, open, close, {', '.join(out)} FROM c WINDOW o AS ({O}), before AS ({O} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING){frames})"


def crossed() -> str:
    """CTE x: the context of each date by joins, and ranks by counting the sectors below."""
    pick = lambda b, c, n: f"max(CASE WHEN symbol = '{b}' THEN {c} END) AS {n}"
    context = [pick(b, f"return_{n}", f"{b}_return_{n}") for b in ("SPY", "QQQ") for n in (1, 3, 6, 24, 60)] + [pick("IWM", f"return_{n}", f"IWM_return_{n}") for n in (1, 3, 6)]
    context += [pick(b, f"return_{n}", f"{b}_return_{n}") for b in ("TLT", "HYG", "GLD", "USO") for n in (1, 6)]
    context += [pick(b, c, f"{b}_{n}_1") for b in ("SPY", "QQQ") for c, n in (("intraday", "intraday_return"), ("gap", "overnight_gap"))]
    sectors = ", ".join(f"'{x}'" for x in p.SECTORS)
    ranked = {**{f"return_{n}": f"sector_return_rank_{n}" for n in (1, 3, 6)}, "rolling_volatility_12": "sector_volatility_rank_12"}
    rank = lambda v, n: f"(SELECT (count(*) FILTER (WHERE g.{v} < f.{v}) + count(*) FILTER (WHERE g.{v} <= f.{v}) - 1) / 2 / 10 FROM f g WHERE g.date = f.date AND g.symbol IN ({sectors})) AS {n}"
    level = [x for n in (1, 3, 6) for x in (f"avg(return_{n}) AS cross_sectional_mean_return_{n}", f"stddev_samp(return_{n}) AS cross_sectional_dispersion_return_{n}", f"avg(CASE WHEN return_{n} > 0 THEN 1.0 ELSE 0 END) AS cross_sectional_breadth_up_{n}")]
    minus = [f"return_{n} - SPY_return_{n} AS sector_minus_SPY_return_{n}" for n in (1, 3, 6, 24, 60)] + [f"return_{n} - QQQ_return_{n} AS sector_minus_QQQ_return_{n}" for n in (1, 6)]
    number = f"CAST(list_position([{sectors}], symbol) - 1 AS DOUBLE) AS sector_id"
    return f""", k AS (SELECT date, {', '.join(context)} FROM f GROUP BY date), b AS (SELECT date, {', '.join(level)} FROM f WHERE symbol IN ({sectors}) GROUP BY date),
    x AS (SELECT f.*, k.* EXCLUDE (date), b.* EXCLUDE (date), {', '.join(minus)}, {', '.join(rank(v, n) for v, n in ranked.items())}, {number}, intraday AS sector_intraday_return_1, gap AS sector_overnight_gap_1 FROM f JOIN k USING (date) JOIN b USING (date) WHERE symbol IN ({sectors}))"""


LABELS = f""", n AS (SELECT symbol, date, open, close, lead(open) OVER o AS next_open, lead(close) OVER o AS ahead, lag(close) OVER o AS before FROM u WINDOW o AS ({O})),
    e AS (SELECT a.*, ln(a.ahead / a.next_open) - ln(b.ahead / b.next_open) AS excess FROM n a JOIN n b ON b.date = a.date AND b.symbol = 'SPY' WHERE a.ahead IS NOT NULL AND a.symbol LIKE 'XL%'),
    l AS (SELECT symbol, date, excess > 0 AS excess_up, rank >= 0.7 AS top, rank <= 0.3 AS bottom, ahead > close AS close_up, close > before AS day_up, close > open AS intraday_up, ahead > open AS open_to_close_up
        FROM (SELECT e.*, (SELECT (count(*) FILTER (WHERE g.excess < e.excess) + count(*) FILTER (WHERE g.excess <= e.excess) - 1) / 2 / 10 FROM e g WHERE g.date = e.date) AS rank FROM e))"""
INDEX = """, vi AS (SELECT date AS vix_date, close AS vix_level, close / lag(close) OVER o - 1 AS vix_change_1, ln(close / lag(close, 5) OVER o) AS vix_return_5, ln(close / lag(close, 20) OVER o) AS vix_return_20
    FROM daily WHERE symbol = '1-URGENT' AND dayofmonth(date) % 3 <> 0 WINDOW o AS (ORDER BY date))"""


def twin(mode: str) -> str:
    m = p.MODES[mode]
    key, target = "CAST(x.date AS VARCHAR) || '|' || x.symbol AS date", f"CAST(l.{m.label} AS BIGINT) AS {p.TARGET}"
    if m.opening:
        gaps = "x.gap AS sector_overnight_gap_1, x.gap - x.SPY_overnight_gap_1 AS sector_minus_SPY_overnight_gap_1, x.gap - y.rolling_beta_SPY_24 * x.SPY_overnight_gap_1 AS sector_minus_beta_SPY_overnight_gap_1, x.SPY_overnight_gap_1, x.QQQ_overnight_gap_1"
        body = f"SELECT {key}, {', '.join('y.' + c for c in p.BASE)}, {gaps}, {target} FROM x JOIN l USING (symbol, date) JOIN x y ON y.symbol = x.symbol AND y.position = x.position - 1"
    else:
        index = " ASOF JOIN vi ON x.date >= vi.vix_date" if m.extra == tuple(p.VIX) else ""
        body = f"SELECT {key}, {', '.join(m.columns)}, {target} FROM x JOIN l USING (symbol, date){index}"
    return s.sql("sector_bars daily", f"{UNIVERSE}{rolled(False)}{crossed()}{LABELS}{INDEX} {body} WHERE x.position >= {m.history}")


def fill(add) -> None:
    names = {"excess": "D4", "top": "D4_top", "bottom": "D4_bottom", "close-direction": "D4_close", "rich-direction": "D4_rich", "open-gap-direction": "D4_open_gap", "intraday-direction": "D4_intraday", "long-direction": "D4_long", "context-direction": "D4_context", "open-next-close-direction": "D4_open_next_close"}
    for mode, name in names.items():
        add(name, lambda x, d, mode=mode: p.panel(s.sector_bars(x, d), mode, vix=s.vix(x, d)), twin(mode), " ".join(p.MODES[mode].columns))
    bars = s.sector_bars
    ready = " AND ".join(f"isfinite({c})" for c in p.LIVE)
    live = s.sql("sector_bars", f"{UNIVERSE}{rolled(True)}{crossed()} SELECT symbol, date, {', '.join(p.LIVE)} FROM x WHERE {ready}")
    add("X7", lambda x, d: p.live_rows(bars(x, d)), live, " ".join(p.LIVE), "date")
    add("X8", lambda x, d: whole_rows(bars(x, d)), s.sql("sector_bars", f"{UNIVERSE}{rolled(False)}{crossed()} SELECT symbol, date, {', '.join(WHOLE)} FROM x WHERE position >= {p.LONG_HISTORY}"), " ".join(WHOLE), "date")
    add("D15", lambda x, d: events(bars(x, d)), s.sql("sector_bars", f"{UNIVERSE}{rolled(True)}{crossed()} SELECT symbol AS target_symbol, date AS event_time, 'v1' AS feature_version, '{p.live_schema_hash()}' AS schema_hash, 43::BIGINT AS n_names, 43::BIGINT AS n_values, 18::BIGINT AS n_sources, {' + '.join(p.LIVE)} AS total FROM x WHERE {ready}"), "total", "event_time")


WHOLE = [*p.BASE, *p.RICH, *p.LONG]


def whole_rows(bars):
    """The columns of the base, rich and long profiles side by side."""
    rows = p.across(p.by_symbol(bars, False, True), True, True)
    return rows.where(F.col("position") >= p.LONG_HISTORY).select("symbol", "date", *WHOLE)


def events(bars):
    """Live events with their arrays told by sizes and a sum, as plain columns."""
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return p.live_events(bars, "v1").select("target_symbol", "event_time", "feature_version", "schema_hash", F.size("names").alias("n_names"), F.size("values").alias("n_values"), F.size("source_symbols").alias("n_sources"), total.alias("total"))
