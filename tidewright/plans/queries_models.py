"""Labels, splits, metrics, backtests and the panels and reports built of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import labels, metrics, models
from tidewright.operators import rolling as r
from tidewright.plans import panels
from tidewright.plans import stand_ins as s

NEXT = "lead(close) OVER (PARTITION BY symbol ORDER BY date)"
UP = "CASE WHEN {0} IS NOT NULL THEN CASE WHEN {0} > 0 THEN 1 ELSE 0 END END"


def moves(x, d):
    """Exposures and returns of one symbol: e from the day's volume, r from open to close."""
    return s.daily(x, d).select("symbol", "date", F.least(F.col("volume") / 4, F.lit(1.0)).alias("e"), ((F.col("close") / F.col("open") - 1) / 500).alias("r"))


def volatilities(x, d):
    return s.daily(x, d).select("symbol", "date", F.pow(r.intraday(), 2).alias("actual"), (F.pow(F.ln(F.col("high") / F.col("low")), 2) * 0.3 + 0.01).alias("forecast"), F.when(F.year("date") < 1999, "train").when(F.year("date") == 1999, "validate").otherwise("test").alias("part"))


VOL = "v AS (SELECT symbol, date, ln(close / open) * ln(close / open) AS actual, pow(ln(high / low), 2) * 0.3 + 0.01 AS forecast, CASE WHEN year(date) < 1999 THEN 'train' WHEN year(date) = 1999 THEN 'validate' ELSE 'test' END AS part FROM daily)"
AUC = "(SELECT CASE WHEN count(*) > 0 THEN avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) END FROM predictions a, predictions b WHERE a.label = 1 AND b.label = 0{})"
BINARY = "count(*) AS n, avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0 END) AS accuracy, avg(-CASE WHEN label = 1 THEN ln(least(greatest(p, 1e-7), 1 - 1e-7)) ELSE ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)) END) AS log_loss, avg(CAST(label AS DOUBLE)) AS positive_rate, avg(p) AS mean_p"


def fit_sql(rounds: int) -> str:
    """From rows v (fold, x, y): intercept b and slope m of each fold that has both outcomes, a Newton step a turn."""
    return f""", fit AS (
        SELECT fold, 0 AS step, CAST(0 AS DOUBLE) AS b, CAST(1 AS DOUBLE) AS m FROM v GROUP BY fold HAVING count(DISTINCT y) > 1
        UNION ALL
        SELECT fold, step + 1, greatest(-20, least(20, b + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01))), greatest(-20, least(20, m + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)))
        FROM (
            SELECT fold, step, any_value(b) AS b, any_value(m) AS m, sum(y - q) AS g0, sum((y - q) * x) AS g1, sum(q * (1 - q)) + 1e-6 AS h00, sum(q * (1 - q) * x) AS h01, sum(q * (1 - q) * x * x) + 1e-6 AS h11
            FROM (SELECT fit.*, x, y, 1 / (1 + exp(-greatest(-20, least(20, b + m * x)))) AS q FROM fit JOIN v USING (fold) WHERE step < {rounds}) GROUP BY fold, step
        )
    ),
    fitted AS (SELECT fold, arg_max(b, step) AS b, arg_max(m, step) AS m FROM fit GROUP BY fold)"""


PLATT = f""", v AS (SELECT fold, ln(q / (1 - q)) AS x, CAST(label AS DOUBLE) AS y FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, p)) AS q FROM predictions WHERE part = 'validate') WHERE p IS NOT NULL AND label IS NOT NULL){fit_sql(30)}
    SELECT fold, greatest(-2.0, least(2.0, coalesce(b, 0))) AS intercept, greatest(0.75, least(1.25, coalesce(m, 1))) AS slope FROM (SELECT DISTINCT fold FROM predictions) LEFT JOIN fitted USING (fold)"""
MAPPED = f""", scale AS (SELECT fold, avg(n_chars) AS mean, CASE WHEN stddev_pop(n_chars) > 1e-12 THEN stddev_pop(n_chars) ELSE 1 END AS sd FROM predictions WHERE part = 'train' GROUP BY fold),
    v AS (SELECT fold, (n_chars - mean) / sd AS x, CAST(label AS DOUBLE) AS y FROM predictions JOIN scale USING (fold) WHERE part = 'train' AND n_chars IS NOT NULL AND label IS NOT NULL){fit_sql(25)}
    SELECT doc_id, fold, 1 / (1 + exp(-greatest(-20, least(20, coalesce(b, 0) + coalesce(m, 0) * (n_chars - mean) / sd)))) AS p FROM predictions LEFT JOIN scale USING (fold) LEFT JOIN fitted USING (fold)"""
LEGACY = f""", f AS (
        SELECT symbol, date, close / lag(close) OVER o - 1 AS ret_1, close / lag(close, 3) OVER o - 1 AS ret_3, close / lag(close, 6) OVER o - 1 AS ret_6, avg(volume) OVER six AS volume_mean_6, volume,
               ln(lead(close, 6) OVER o / close) AS label, row_number() OVER o AS i
        FROM daily WINDOW o AS (PARTITION BY symbol ORDER BY date), six AS (PARTITION BY symbol ORDER BY date ROWS 5 PRECEDING)
    ),
    g AS (SELECT date, coalesce(close / lag(close) OVER (ORDER BY date) - 1, 0) AS spy_ret_1 FROM daily WHERE symbol = '{s.BENCH}')
    SELECT symbol, date, ret_1, ret_3, ret_6, sqrt(greatest(1e-8, abs(ret_6) + 1e-8)) AS volatility_6, volume_mean_6, volume / greatest(1e-8, volume_mean_6) AS rel_volume,
           greatest(0, least(100, 50 + 10 * ret_1)) AS rsi_14, spy_ret_1, ret_1 - spy_ret_1 AS sector_spy_diff, label
    FROM f JOIN g USING (date) WHERE i > 19 AND label IS NOT NULL"""


def fill(add) -> None:
    q = s.sql
    p = s.predictions
    for k in (1, 3, 5):
        add(f"M1_close_{k}", lambda x, d, k=k: s.daily(x, d).select("symbol", "date", labels.close_up(k).alias("label")), q("daily", f"SELECT symbol, date, {UP.format(f'(lead(close, {k}) OVER (PARTITION BY symbol ORDER BY date) / close - 1)')} AS label FROM daily"), "", "date", "label")
    add("M1", lambda x, d: s.daily(x, d).select("symbol", "date", labels.open_to_close_up(5).alias("label")), q("daily", f"SELECT symbol, date, {UP.format('(lead(close, 5) OVER (PARTITION BY symbol ORDER BY date) / lead(open, 1) OVER (PARTITION BY symbol ORDER BY date) - 1)')} AS label FROM daily"), "", "date", "label")
    add("M1_volatility", lambda x, d: s.daily(x, d).withColumn("m", r.trailing_median(20)).select("symbol", "date", labels.high_volatility_next("m").alias("label")), q("daily", ", m AS (SELECT *, CASE WHEN count(*) OVER w = 20 THEN median(abs(close / open - 1)) OVER w END AS m, abs(lead(close) OVER o / lead(open) OVER o - 1) AS nm FROM daily WINDOW o AS (PARTITION BY symbol ORDER BY date), w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) SELECT symbol, date, CASE WHEN nm IS NOT NULL AND m IS NOT NULL THEN CASE WHEN nm > m THEN 1 ELSE 0 END END AS label FROM m"), "", "date", "label")
    add("M2", lambda x, d: panels.pooled_labels(s.daily(x, d), s.BENCH), q("daily", f"""SELECT a.symbol, a.date, CASE WHEN a.no / a.close - 1 > 0 THEN 1 ELSE 0 END AS gap_up, CASE WHEN a.nc / a.no - 1 > 0 THEN 1 ELSE 0 END AS intraday_up, CASE WHEN a.nc / a.close - 1 > 0 THEN 1 ELSE 0 END AS close_up, CASE WHEN a.nc / a.no > b.nc / b.no THEN 1 ELSE 0 END AS excess_up
        FROM (SELECT *, lead(open) OVER o AS no, lead(close) OVER o AS nc FROM daily WINDOW o AS (PARTITION BY symbol ORDER BY date)) a JOIN (SELECT *, lead(open) OVER o AS no, lead(close) OVER o AS nc FROM daily WINDOW o AS (PARTITION BY symbol ORDER BY date)) b ON b.date = a.date AND b.symbol = '{s.BENCH}' WHERE a.nc IS NOT NULL AND b.nc IS NOT NULL"""), "", "date", "gap_up intraday_up close_up excess_up")
    add("M26", lambda x, d: s.daily(x, d).select("symbol", "date", labels.log_variance_next().alias("value")), q("daily", f"SELECT symbol, date, ln(pow(ln({NEXT} / lead(open) OVER (PARTITION BY symbol ORDER BY date)), 2) + 1e-8) AS value FROM daily"), "value", "date")
    add("M3", lambda x, d: labels.chronological(s.daily(x, d).select("date", "symbol"), "date", 0.2), q("daily", "SELECT date, symbol, CASE WHEN row_number() OVER (ORDER BY date, symbol) > count(*) OVER () - ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS part FROM daily"), "", "date")
    add("M4", lambda x, d: labels.three_way(s.daily(x, d).select("date", "symbol"), "date", "1998-12-31", "1999-12-31", "2000-12-31"), q("daily", "SELECT date, symbol, CASE WHEN date <= DATE '1998-12-31' THEN 'train' WHEN date <= DATE '1999-12-31' THEN 'validate' WHEN date <= DATE '2000-12-31' THEN 'test' ELSE 'beyond' END AS part FROM daily"), "", "date")
    add("M5", lambda x, d: labels.yearly_folds(s.sessions(x, d).withColumnRenamed("session", "date"), 1998, 2001), q("sessions", "SELECT CAST(f AS BIGINT) AS fold, session AS date, CASE WHEN year(session) <= f - 2 THEN 'train' WHEN year(session) = f - 1 THEN 'validate' ELSE 'test' END AS part FROM sessions, generate_series(1998, 2001) t(f) WHERE year(session) <= f"), "", "date", "fold")
    monthly = """, d AS (SELECT session, row_number() OVER (ORDER BY session) AS n, year(session) * 12 + month(session) - 1 AS m FROM sessions), m AS (SELECT m, min(n) AS a, max(n) AS b FROM d GROUP BY 1), f AS (SELECT t.m AS fold, t.a AS ta, t.b AS tb, v.a AS va FROM m t JOIN m v ON v.m = t.m - 6 WHERE t.m >= 1997 * 12)
        SELECT CAST(fold AS BIGINT) AS fold, date, part FROM (SELECT fold, session AS date, CASE WHEN n >= ta THEN 'test' WHEN n >= va AND n < ta - 5 THEN 'validate' WHEN n < va - 5 THEN 'train' END AS part FROM d JOIN f ON n <= tb) WHERE part IS NOT NULL"""
    add("M6", lambda x, d: labels.monthly_folds(s.sessions(x, d).withColumnRenamed("session", "date"), 1995), q("sessions", monthly), "", "date")
    add("M7", lambda x, d: labels.monthly_folds(s.sessions(x, d).withColumnRenamed("session", "date"), 1995, purge=1, train_months=12), q("sessions", monthly.replace("ta - 5", "ta - 1").replace("va - 5", "va - 1").replace("ON n <= tb", "ON n <= tb AND d.m >= fold - 18")), "", "date")
    add("M8", lambda x, d: metrics.class_prior(p(x, d), ["fold"]), q("predictions", "SELECT fold, avg(CAST(label AS DOUBLE)) AS prior FROM predictions WHERE part = 'train' GROUP BY 1"), "prior")
    add("M9", lambda x, d: metrics.binary(p(x, d), []), q("predictions", f"SELECT {BINARY}, {AUC.format('')} AS auc FROM predictions"), "accuracy log_loss positive_rate mean_p auc")
    add("M10", lambda x, d: metrics.calibration(p(x, d), []), q("predictions", "SELECT avg(pow(p - label, 2)) AS brier, (count(*) FILTER (WHERE p >= 0.5 AND label = 1) / count(*) FILTER (WHERE label = 1) + count(*) FILTER (WHERE p < 0.5 AND label = 0) / count(*) FILTER (WHERE label = 0)) / 2 AS balanced_accuracy, count(*) AS n, (SELECT sum(k * abs(mp - ml)) / sum(k) FROM (SELECT count(*) AS k, avg(p) AS mp, avg(CAST(label AS DOUBLE)) AS ml FROM predictions GROUP BY least(floor(p * 10), 9))) AS ece FROM predictions"), "brier balanced_accuracy ece")
    add("M11", lambda x, d: metrics.binary(p(x, d), ["fold"]), q("predictions", f"SELECT o.fold, {BINARY}, any_value(auc) AS auc FROM predictions o JOIN (SELECT f.fold, {AUC.format(' AND a.fold = f.fold AND b.fold = f.fold')} AS auc FROM (SELECT DISTINCT fold FROM predictions) f) g ON g.fold = o.fold GROUP BY 1"), "accuracy log_loss positive_rate mean_p auc")
    add("A14", lambda x, d: metrics.empirical_quantile(p(x, d), "n_chars", 0.75), q("predictions", "SELECT n_chars AS quantile FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars) AS i, count(*) OVER () AS n FROM predictions) WHERE i - 1 = floor(0.75 * (n - 1))"))
    add("A15", lambda x, d: metrics.histogram(p(x, d)), q("predictions", "SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM predictions GROUP BY 1"))
    add("A15_confusion", lambda x, d: metrics.confusion(p(x, d)), q("predictions", "SELECT count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn, greatest(avg(label), 1 - avg(label)) AS majority FROM predictions"), "majority")
    add("M15", lambda x, d: p(x, d).withColumn("sigma", F.col("n_chars") / 1e6).select("doc_id", *(c.alias(n) for n, c in metrics.overlays().items())), q("predictions", "SELECT doc_id, least(greatest(1 - p, 0.25), 1) AS probability, least(greatest(0.15 / (greatest(n_chars / 1e6, 1e-6) * sqrt(252)), 0.25), 1) AS volatility FROM predictions"), "probability volatility")
    add("M16", lambda x, d: metrics.backtest(moves(x, d), ["symbol"], [0, 5, 10, 20]), q("daily", """, m AS (SELECT symbol, date, least(volume / 4, 1) AS e, (close / open - 1) / 500 AS r FROM daily), t AS (SELECT *, abs(e - lag(e, 1, 0) OVER (PARTITION BY symbol ORDER BY date)) AS turn FROM m), n AS (SELECT *, e * r - c / 10000 * turn AS net FROM t, (SELECT unnest([0, 5, 10, 20]) AS c)),
        q AS (SELECT *, exp(sum(ln(1 + net)) OVER w) AS eq FROM n WINDOW w AS (PARTITION BY symbol, c ORDER BY date ROWS UNBOUNDED PRECEDING)), k AS (SELECT *, greatest(1, max(eq) OVER (PARTITION BY symbol, c ORDER BY date ROWS UNBOUNDED PRECEDING)) AS peak FROM q)
        SELECT symbol, CAST(c AS BIGINT) AS cost_bps, arg_max(eq, date) AS equity, min(eq / peak - 1) AS max_drawdown, avg(turn) AS turnover, avg(net) / stddev_samp(net) * sqrt(252) AS sharpe, pow(arg_max(eq, date), 252 / count(*)) - 1 AS cagr FROM k GROUP BY 1, 2"""), "equity max_drawdown turnover sharpe cagr")
    add("M17", lambda x, d: metrics.variance_errors(volatilities(x, d)), q("daily", f", {VOL} SELECT avg(a / f - ln(a / f) - 1) AS qlike, avg(abs(ln(f) - ln(a))) AS mae_log, sqrt(avg(pow(ln(f) - ln(a), 2))) AS rmse_log, avg(f) / avg(a) AS ratio, corr(ra, rf) AS spearman FROM (SELECT greatest(actual, 1e-10) AS a, greatest(forecast, 1e-10) AS f, rank() OVER (ORDER BY actual) + (count(*) OVER (PARTITION BY actual) - 1) / 2 AS ra, rank() OVER (ORDER BY forecast) + (count(*) OVER (PARTITION BY forecast) - 1) / 2 AS rf FROM v)"), "qlike mae_log rmse_log ratio spearman")
    add("M18", lambda x, d: metrics.scale_ratio(volatilities(x, d), ["symbol"]), q("daily", f", {VOL} SELECT symbol, avg(actual / forecast) AS scale FROM v WHERE part = 'validate' GROUP BY 1"), "scale")
    add("M19", lambda x, d: metrics.promotion(windows(x, d)), q("predictions", f"SELECT count(*) AS windows, bool_and(v > 0.55 AND t > 0.55) AND count(*) >= 2 AS promoted FROM (SELECT f.fold, {AUC.format(chr(32) + 'AND a.fold = f.fold AND b.fold = f.fold AND a.part = b.part AND a.part = ' + chr(39) + 'validate' + chr(39))} AS v, {AUC.format(chr(32) + 'AND a.fold = f.fold AND b.fold = f.fold AND a.part = b.part AND a.part = ' + chr(39) + 'test' + chr(39))} AS t FROM (SELECT DISTINCT fold FROM predictions) f)"))
    add("M20", lambda x, d: metrics.best_threshold(p(x, d)), q("predictions", "SELECT t / 100 AS threshold, accuracy FROM (SELECT t, avg(CASE WHEN (floor(round(p * 100, 9)) >= t) = (label = 1) THEN 1.0 ELSE 0 END) AS accuracy FROM predictions, generate_series(5, 95) g(t) GROUP BY t) ORDER BY accuracy DESC, abs(t - 50), t LIMIT 1"), "threshold accuracy")
    add("M21", lambda x, d: metrics.standardised(p(x, d), ["n_chars", "p"]).select("doc_id", "z_n_chars", "z_p"), q("predictions", "SELECT doc_id, (n_chars - m1) / s1 AS z_n_chars, (p - m2) / s2 AS z_p FROM predictions, (SELECT avg(n_chars) AS m1, stddev_pop(n_chars) AS s1, avg(p) AS m2, stddev_pop(p) AS s2 FROM predictions WHERE part = 'train')"), "z_n_chars z_p")
    add("M27", lambda x, d: labels.three_folds(s.sessions(x, d).withColumnRenamed("session", "date"), "date"), q("sessions", "SELECT * FROM (SELECT session AS date, CAST(f AS BIGINT) AS fold, CASE WHEN i < f * w - 1 THEN 'train' WHEN i >= f * w AND i < (f + 1) * w - 1 THEN 'validate' WHEN i >= (f + 1) * w AND i < (f + 2) * w THEN 'test' END AS part FROM (SELECT session, row_number() OVER (ORDER BY session) - 1 AS i, count(*) OVER () // 5 AS w FROM sessions), generate_series(1, 3) g(f)) WHERE part IS NOT NULL"), "", "date")
    add("M12", lambda x, d: models.platt(p(x, d), "fold"), q("predictions", PLATT), "intercept slope")
    add("M13_folds", lambda x, d: models.logistic_map(p(x, d).drop("p"), "fold", "n_chars").select("doc_id", "fold", "p"), q("predictions", MAPPED), "p")
    # panels
    add("D1", lambda x, d: panels.market_dataset(s.daily(x, d), "1-URGENT", s.BENCH), q("r1", f""", f AS (SELECT a.date, a.symbol, a.close / lag(a.close, 1) OVER o - 1 AS return_1, a.close / lag(a.close, 3) OVER o - 1 AS return_3, CASE WHEN count(a.r1) OVER w6 = 6 THEN stddev_samp(a.r1) OVER w6 END AS volatility_6, a.volume / CASE WHEN count(*) OVER w6 = 6 THEN greatest(1, avg(a.volume) OVER w6) END AS relative_volume,
        lead(a.close) OVER o / a.close - 1 AS ahead, row_number() OVER o AS i FROM r1 a WHERE symbol = '1-URGENT' WINDOW o AS (ORDER BY a.date), w6 AS (ORDER BY a.date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)), g AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS b FROM daily WHERE symbol = '{s.BENCH}')
        SELECT f.date, return_1, return_3, volatility_6, relative_volume, return_1 - b AS spread, CASE WHEN ahead > 0 THEN 1 ELSE 0 END AS label FROM f JOIN g USING (date) WHERE i > 14 AND ahead IS NOT NULL AND b IS NOT NULL"""), "return_1 return_3 volatility_6 relative_volume spread", "date", "label")
    add("D13", lambda x, d: panels.legacy_features(s.daily(x, d), s.BENCH), q("daily", LEGACY), "ret_1 ret_3 ret_6 volatility_6 volume_mean_6 rel_volume rsi_14 spy_ret_1 sector_spy_diff label", "date")


def windows(x, d):
    p = s.predictions(x, d)
    v, t = (metrics.auc(p.where(F.col("part") == part), ["fold"]).withColumnRenamed("auc", f"{part}_auc") for part in ("validate", "test"))
    return v.join(t, "fold")
