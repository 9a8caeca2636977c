"""Rolling, cross-sectional and chart functions over daily bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import cross, indicators, labels
from tidewright.operators import rolling as r
from tidewright.plans import stand_ins as s

OVER = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND {})"


def frame(k: int, end: int = 0) -> str:
    return OVER.format(k - 1 - end, "CURRENT ROW" if not end else f"{-end} PRECEDING")


def whole(x: str, k: int, f: str, end: int = 0) -> str:
    return f"CASE WHEN count({x}) {frame(k, end)} = k{k} THEN {f}({x}) {frame(k, end)} END".replace(f"k{k}", str(k))


LAG = "lag(close) OVER (PARTITION BY symbol ORDER BY date)"
BENCH = f"bench AS (SELECT a.*, b.close AS bench_close, b.r1 AS bench_r1 FROM r1 a JOIN r1 b ON a.date = b.date AND b.symbol = '{s.BENCH}')"


def returns(x, d):
    return r.with_returns(s.daily(x, d))


def benched(x, d):
    return r.with_benchmark(returns(x, d), s.BENCH)


def returns5(x, d):
    """Rows with the symbol's three-day return."""
    return returns(x, d).withColumn("v", F.round(r.log_return(3), 9))


V = "v AS (SELECT symbol, date, round(CASE WHEN lag(close, 3) OVER o > 0 THEN ln(close / lag(close, 3) OVER o) END, 9) AS v FROM r1 WINDOW o AS (PARTITION BY symbol ORDER BY date))"
RANK = "CASE WHEN v IS NOT NULL THEN CASE WHEN count(v) OVER (PARTITION BY date) > 1 THEN (2 * (rank() OVER (PARTITION BY date ORDER BY v NULLS LAST) - 1) + count(v) OVER (PARTITION BY date, v) - 1) / 2 / (count(v) OVER (PARTITION BY date) - 1) ELSE 0.5 END END"


def fill(add) -> None:
    q = s.sql

    def column(name, make, expression, source="r1", base=returns):
        add(name, lambda x, d: base(x, d).select("symbol", "date", make().alias("value")), q("r1", (f", {BENCH} " if source == "bench" else "") + f"SELECT symbol, date, {expression} AS value FROM {source}"), "" if name == "W28" else "value", "date")

    column("W1", lambda: r.log_return(5), "ln(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY date))")
    column("W2", lambda: r.simple_return(3), "close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY date) - 1")
    column("W3", lambda: r.mean_return(6), whole("r1", 6, "avg"))
    column("W4", lambda: r.volatility(6), whole("r1", 6, "stddev_samp"))
    column("W5", lambda: r.realised_volatility(20), whole("r1", 20, "stddev_pop"))
    before = whole("volume", 20, "avg", -1)
    column("W6a", lambda: r.relative_volume("before"), f"CASE WHEN {before} > 0 THEN volume / ({before}) END")
    column("W6b", lambda: r.relative_volume("floored"), f"volume / CASE WHEN {before} < 1e-8 THEN 1e-8 ELSE ({before}) END")
    now = whole("volume", 6, "avg")
    column("W6c", lambda: r.relative_volume("with_current"), f"volume / CASE WHEN {now} < 1 THEN 1 ELSE ({now}) END")
    column("W6d", lambda: r.relative_volume("with_current_floored"), f"volume / CASE WHEN {now} < 1e-8 THEN 1e-8 ELSE ({now}) END")
    column("W7", lambda: r.over_average(20), f"close / ({whole('close', 20, 'avg')}) - 1")
    column("W8", lambda: r.mean_range(5), whole("((high - low) / close)", 5, "avg"))
    pair = f"count(r1 + bench_r1) {frame(24)} = 24"
    column("W9", lambda: r.correlation(24), f"CASE WHEN {pair} THEN CASE WHEN stddev_samp(r1) {frame(24)} < 1e-12 OR stddev_samp(bench_r1) {frame(24)} < 1e-12 THEN 0 ELSE corr(r1, bench_r1) {frame(24)} END END", "bench", benched)
    column("W10", lambda: r.beta(24), f"CASE WHEN {pair} THEN CASE WHEN var_samp(bench_r1) {frame(24)} > 1e-20 THEN covar_samp(r1, bench_r1) {frame(24)} / var_samp(bench_r1) {frame(24)} ELSE 0 END END", "bench", benched)
    gain, loss = f"avg(greatest(d1, 0)) {frame(14)}", f"avg(greatest(-d1, 0)) {frame(14)}"
    column("W11", lambda: r.rsi(14), f"CASE WHEN count(d1) {frame(14)} = 14 THEN CASE WHEN {loss} > 0 THEN 100 - 100 / (1 + {gain} / ({loss})) WHEN {gain} > 0 THEN 100 ELSE 50 END END")
    column("W13", lambda: r.volume_z(20), f"CASE WHEN {whole('volume', 20, 'stddev_pop')} <= 1e-12 THEN 0 ELSE (volume - ({whole('volume', 20, 'avg')})) / ({whole('volume', 20, 'stddev_pop')}) END")
    column("W14_gap", r.gap, f"open / {LAG} - 1")
    column("W14_log_gap", r.log_gap, f"ln(open / {LAG})")
    column("W14_intraday", r.intraday, "ln(close / open)")
    column("W14_absolute", r.open_to_close, "abs(close / open - 1)")
    column("W15", lambda: r.trailing_median(20), f"CASE WHEN count(*) {frame(20)} = 20 THEN median(abs(close / open - 1)) {frame(20)} END")
    column("W17", lambda: r.mean_square(20), whole("(ln(close / open) * ln(close / open))", 20, "avg"))
    for k in (20, 50, 200):
        column(f"W19_{k}", lambda k=k: r.average(k), whole("close", k, "avg"))
    for i, (name, sign) in enumerate((("low", "- 2"), ("mid", "+ 0"), ("high", "+ 2"))):
        column(f"W21_{name}", lambda i=i: r.bollinger()[i], f"({whole('close', 20, 'avg')}) {sign} * ({whole('close', 20, 'stddev_pop')})")
    column("W23", r.drawdown, "close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1")
    column("W25", r.rebased, "100 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)")
    column("W26", lambda: r.shifted_forward("volume", ["symbol"], "date"), "lead(volume, 1, 0) OVER (PARTITION BY symbol ORDER BY date)")
    column("W24", lambda: F.aggregate(r.sequence_of(["close", "volume"], 10), F.lit(0.0), lambda a, b: a + b["close"] / 977 + b["volume"]), f"CASE WHEN count(*) {frame(10)} = 10 THEN sum(close / 977 + volume) {frame(10)} END")
    column("W28", lambda: r.buckets("close", ["date"], "symbol"), "CAST(floor((row_number() OVER (PARTITION BY date ORDER BY close, symbol) * 5 - 1) / count(*) OVER (PARTITION BY date)) AS BIGINT)", base=lambda x, d: returns(x, d))
    add("W27", lambda x, d: tail(returns(x, d)), q("r1", "SELECT symbol, date, close FROM r1 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) <= 120"), "close", "date")
    vix = "v AS (SELECT date, close, close / lag(close) OVER (ORDER BY date) - 1 AS change_1, ln(close / lag(close, 5) OVER (ORDER BY date)) AS log_5 FROM daily WHERE symbol = '1-URGENT' AND dayofmonth(date) % 3 <> 0)"
    add("W18", lambda x, d: with_vix(x, d), q("daily", f", {vix} SELECT d.date, v.close AS level, v.change_1, v.log_5 FROM (SELECT DISTINCT date FROM daily) d ASOF LEFT JOIN v ON d.date >= v.date"), "level change_1 log_5", "date")
    # recursive ones
    nth = "n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM daily)"
    ema = """, {n}, e AS (SELECT symbol, i, date, close AS sum, CAST(NULL AS DOUBLE) AS value FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.date, CASE WHEN n.i <= {k} THEN sum + close ELSE sum END,
        CASE WHEN n.i < {k} THEN NULL WHEN n.i = {k} THEN (sum + close) / {k} ELSE value + 2.0 / ({k} + 1) * (close - value) END FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1) SELECT symbol, date, value FROM e"""
    add("W20", lambda x, d: indicators.ema(s.daily(x, d), 20, "value").select("symbol", "date", "value"), q("daily", ema.format(n=nth, k=20)), "value", "date")
    squares = "n AS (SELECT symbol, date, ln(close / open) AS x, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM daily)"
    add("W16", lambda x, d: indicators.ewma_variance(s.daily(x, d).withColumn("x", r.intraday()), "value", "x").select("symbol", "date", "value"), q("daily", f", {squares}, e AS (SELECT symbol, i, date, 0.0::DOUBLE AS value FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.date, 2.0 / 21 * x * x + (1 - 2.0 / 21) * value FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1) SELECT symbol, date, value FROM e"), "value", "date")
    wilder = f""", {nth}, c AS (SELECT n.*, greatest(close - lag(close, 1, close) OVER (PARTITION BY symbol ORDER BY date), 0) AS up, greatest(lag(close, 1, close) OVER (PARTITION BY symbol ORDER BY date) - close, 0) AS down FROM n),
        e AS (SELECT symbol, i, date, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l FROM c WHERE i = 1 UNION ALL SELECT c.symbol, c.i, c.date, CASE WHEN c.i <= 15 THEN g + up / 14 ELSE (g * 13 + up) / 14 END, CASE WHEN c.i <= 15 THEN l + down / 14 ELSE (l * 13 + down) / 14 END FROM e JOIN c ON c.symbol = e.symbol AND c.i = e.i + 1)
        SELECT symbol, date, CASE WHEN i > 14 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS value FROM e"""
    add("W12", lambda x, d: indicators.wilder_rsi(s.daily(x, d), "value").select("symbol", "date", "value"), q("daily", wilder), "value", "date")
    line = """SELECT symbol, i, date, close, close AS sum, CAST(NULL AS DOUBLE) AS value FROM {of} WHERE i = 1 UNION ALL SELECT n.symbol, n.i, n.date, n.close, CASE WHEN n.i <= {k} THEN sum + n.close ELSE sum END,
        CASE WHEN n.i < {k} THEN NULL WHEN n.i = {k} THEN (sum + n.close) / {k} ELSE value + 2.0 / ({k} + 1) * (n.close - value) END FROM {me} e JOIN {of} n ON n.symbol = e.symbol AND n.i = e.i + 1"""
    macd = f""", {nth}, e12 AS ({line.format(k=12, of="n", me="e12")}), e26 AS ({line.format(k=26, of="n", me="e26")}),
        m AS (SELECT symbol, date, e12.value - e26.value AS close, i - 25 AS i FROM e12 JOIN e26 USING (symbol, date, i) WHERE e26.value IS NOT NULL),
        e9 AS ({line.format(k=9, of="m", me="e9")}) SELECT symbol, date, close AS macd, value AS signal, close - value AS histogram FROM e9 WHERE value IS NOT NULL"""
    add("W22", lambda x, d: indicators.macd(s.daily(x, d)).select("symbol", "date", "macd", "signal", "histogram"), q("daily", macd), "macd signal histogram", "date")
    add("A12", lambda x, d: indicators.statistics(s.daily(x, d)), q("daily", """SELECT symbol, (arg_max(close, date) / arg_min(close, date) - 1) * 100 AS return_pct, stddev_samp(r) * sqrt(252) * 100 AS volatility_pct, min(dd) * 100 AS max_drawdown_pct, max(high) AS high, min(low) AS low, avg(volume) AS mean_volume, avg(CASE WHEN r IS NOT NULL THEN CASE WHEN r > 0 THEN 1.0 ELSE 0 END END) * 100 AS positive_pct
        FROM (SELECT *, close / lag(close) OVER o - 1 AS r, close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM daily WINDOW o AS (PARTITION BY symbol ORDER BY date)) GROUP BY 1"""), "return_pct volatility_pct max_drawdown_pct high low mean_volume positive_pct")
    # cross-sections
    add("X1", lambda x, d: returns5(x, d).select("symbol", "date", cross.rank01("v").alias("value")), q("r1", f", {V} SELECT symbol, date, {RANK} AS value FROM v"), "value", "date")
    add("X2", lambda x, d: cross.spread_of(returns(x, d).withColumn("v", r.log_return(3)), "v"), q("r1", "SELECT date, avg(v) AS mean, stddev_samp(v) AS dispersion, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS breadth FROM (SELECT date, ln(close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY date)) AS v FROM r1) WHERE v IS NOT NULL GROUP BY date"), "mean dispersion breadth", "date")
    column("X3", lambda: cross.against("r1", "bench_r1"), "r1 - bench_r1", "bench", benched)
    add("X3_beta", lambda x, d: benched(x, d).withColumn("b", r.beta(24)).select("symbol", "date", cross.against("r1", "bench_r1", "b").alias("value")), q("r1", f", {BENCH} SELECT symbol, date, r1 - bench_r1 * (CASE WHEN {pair} THEN CASE WHEN var_samp(bench_r1) {frame(24)} > 1e-20 THEN covar_samp(r1, bench_r1) {frame(24)} / var_samp(bench_r1) {frame(24)} ELSE 0 END END) AS value FROM bench"), "value", "date")
    add("X4", lambda x, d: returns5(x, d).select("symbol", "date", cross.extreme_label("v", True).alias("top"), cross.extreme_label("v", False).alias("bottom")), q("r1", f", {V} SELECT symbol, date, CASE WHEN v IS NOT NULL THEN CASE WHEN {RANK} >= 0.7 THEN 1 ELSE 0 END END AS top, CASE WHEN v IS NOT NULL THEN CASE WHEN {RANK} <= 0.3 THEN 1 ELSE 0 END END AS bottom FROM v"), "", "date", "top bottom")
    add("X5", lambda x, d: cross.complete_sessions(s.daily(x, d), 5), q("daily", "SELECT date FROM daily GROUP BY date HAVING count(*) = 5 AND count(DISTINCT symbol) = 5"), "", "date")
    add("S8", lambda x, d: cross.full_universe(s.daily(x, d), 5), q("daily", "SELECT date FROM daily GROUP BY date HAVING count(DISTINCT symbol) = 5"), "", "date")
    hit = lambda x, d: s.daily(x, d).withColumn("label", labels.close_up(1)).withColumn("tie", F.ascii(F.substring("symbol", 1, 1))).where("label is not null")
    add("X6", lambda x, d: cross.top_hit_rate(hit(x, d), "volume", "label", "date", "tie"), q("daily", "SELECT count(*) AS sessions, avg(CAST(hit AS DOUBLE)) AS hit_rate FROM (SELECT date, arg_max(label, (volume, -ascii(symbol))) AS hit, max(label) AS any_up FROM (SELECT symbol, date, volume, CASE WHEN lead(close) OVER (PARTITION BY symbol ORDER BY date) / close - 1 > 0 THEN 1 ELSE 0 END AS label, lead(close) OVER (PARTITION BY symbol ORDER BY date) AS nc FROM daily) WHERE nc IS NOT NULL GROUP BY date) WHERE any_up = 1"), "hit_rate")
    add("X9", lambda x, d: cross.symbol_ids(s.daily(x, d)), q("daily", "SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS symbol_id FROM (SELECT DISTINCT symbol FROM daily)"))


def tail(daily):
    from tidewright.operators.dedup import latest_n

    return latest_n(daily, ["symbol"], [F.desc("date")], 120).select("symbol", "date", "close")


def with_vix(x, d):
    """A volatility index with gaps: its changes are its own, then looked up on or before each date."""
    from pyspark.sql import Window

    from tidewright.operators.asof import asof

    w = Window.orderBy("date")
    v = s.daily(x, d).where((F.col("symbol") == "1-URGENT") & (F.dayofmonth("date") % 3 != 0))
    v = v.select(F.col("date").alias("vix_date"), F.col("close").alias("level"), (F.col("close") / F.lag("close").over(w) - 1).alias("change_1"), F.ln(F.col("close") / F.lag("close", 5).over(w)).alias("log_5"))
    days = s.daily(x, d).select("date").distinct()
    return asof(days, v, "date", "vix_date", [], ["level", "change_1", "log_5"]).drop("vix_date")
