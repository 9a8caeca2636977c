"""Inserts under several unique keys, bootstrap bounds, monthly refits and the volatility report."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import arrivals, boosted, bootstrap, cross, labels, models, ordering, temporal
from tidewright.operators import rolling as r
from tidewright.plans import panels
from tidewright.plans import queries_sets as sets
from tidewright.plans import stand_ins as s
from tidewright.plans import volatility

SYMBOL = "1-URGENT"
REPLICATES = 200


# K3: articles arrive by id; the same address or the same content, once stored, refuses what comes later


def addressed(x, d):
    """Articles with an address: a third share fifty of them, the others' are blank."""
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string"))).otherwise("")
    return s.articles(x, d).withColumn("url", url).withColumn("id", F.col("doc_id").cast("string"))


def stored(x, d, blanks=False):
    return arrivals.first_of_any(addressed(x, d), ["id", "url", "content_hash"], ["doc_id"], blanks).select("doc_id")


ARRIVALS = """, a AS MATERIALIZED (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'u' || (doc_id % 50) ELSE {blank} END AS url, min(doc_id) OVER (PARTITION BY content_hash) AS content_hash, row_number() OVER (ORDER BY doc_id) AS i FROM articles),
    walk AS (
        SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS urls, CAST([] AS BIGINT[]) AS hashes, CAST([] AS BIGINT[]) AS kept
        UNION ALL
        SELECT i, CASE WHEN free AND url IS NOT NULL THEN list_append(urls, url) ELSE urls END, CASE WHEN free AND content_hash IS NOT NULL THEN list_append(hashes, content_hash) ELSE hashes END,
               CASE WHEN free THEN list_append(kept, doc_id) ELSE kept END
        FROM (
            SELECT a.*, urls, hashes, kept, NOT coalesce(list_contains(urls, url), false) AND NOT coalesce(list_contains(hashes, content_hash), false) AND NOT list_contains(kept, doc_id) AS free
            FROM walk JOIN a ON a.i = walk.i + 1
        )
    )
    SELECT unnest(kept) AS doc_id FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)"""


# Bounds of an area and of a mean, with draws that SQL makes as well


def bounds(x, d):
    """The area under labelled documents' scores, and the mean of how far scores are from labels."""
    p = s.predictions(x, d).withColumn("error", F.abs(F.col("p") - F.col("label")))
    area = bootstrap.auc_lower_bound(p, "doc_id", "p", "label", replicates=REPLICATES)
    mean = bootstrap.mean_lower_bound(p, "doc_id", "error", replicates=REPLICATES)
    return area.withColumn("bound", F.lit("auc")).unionByName(mean.withColumn("bound", F.lit("mean"))).select("bound", "lower", "replicates")


BOUNDS = f""", o AS (SELECT p, label, abs(p - label) AS error, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM predictions WHERE p IS NOT NULL AND label IS NOT NULL), c AS (SELECT count(*) AS n FROM o),
    d0 AS (SELECT r, b, n, ((r + 1) * 1000003 + (b + 1) * 7919 + 7 * 104729) % 2147483647 AS x FROM (SELECT range AS r FROM range({REPLICATES})), c, unnest(range(CAST(ceil(n / 20) AS BIGINT))) t(b)),
    d1 AS (SELECT *, x * 48271 % 2147483647 AS h FROM d0), d2 AS (SELECT * REPLACE ((h * h + x) % 2147483647 AS h) FROM d1), d3 AS (SELECT * REPLACE ((h * 69621 + r) % 2147483647 AS h) FROM d2),
    d4 AS (SELECT * REPLACE ((h * h + b) % 2147483647 AS h) FROM d3), d5 AS (SELECT *, (h * 40692 + 1) % 2147483647 AS g FROM d4), draw AS (SELECT r, b, n, (h * 2147483647 + (g * g + h) % 2147483647) % n AS start FROM d5),
    picked AS (SELECT r, p, label, error FROM (SELECT r, (start + j) % n AS i FROM draw, unnest(range(20)) t(j) WHERE b * 20 + j < n) JOIN o USING (i)),
    scores AS (SELECT r, p, sum(label) AS pos, sum(1 - label) AS neg FROM picked GROUP BY r, p),
    pairs AS (SELECT *, sum(neg) OVER (PARTITION BY r ORDER BY p) - neg AS below FROM scores),
    areas AS (SELECT r, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS v FROM pairs GROUP BY r HAVING sum(pos) > 0 AND sum(neg) > 0),
    means AS (SELECT r, avg(error) AS v FROM picked GROUP BY r),
    listed AS (SELECT 'auc' AS bound, list(v ORDER BY v) AS v FROM areas UNION ALL SELECT 'mean', list(v ORDER BY v) FROM means)
    SELECT bound, v[CAST(floor(0.025 * (len(v) - 1)) AS BIGINT) + 1] AS lower, CAST(len(v) AS BIGINT) AS replicates FROM listed"""


# One symbol's sessions, each month predicted by maps refitted on what came before

SAMPLES = f""", n AS (
        SELECT date, open, close, row_number() OVER (ORDER BY date) - 1 AS pos, ln(close / lag(close) OVER (ORDER BY date)) AS r1, ln(close / open) AS x, abs(close / open - 1) AS move,
               (high - low) / close AS spread, lead(close) OVER (ORDER BY date) / lead(open) OVER (ORDER BY date) - 1 AS next_return
        FROM daily WHERE symbol = '{SYMBOL}'
    ),
    e AS (SELECT pos, CAST(0 AS DOUBLE) AS v FROM n WHERE pos = 0 UNION ALL SELECT n.pos, 2.0 / 21 * x * x + (1 - 2.0 / 21) * v FROM e JOIN n ON n.pos = e.pos + 1),
    w AS (
        SELECT n.*, v, median(move) OVER w AS usual, stddev_pop(r1) OVER w AS rolling, avg(spread) OVER w AS spreads
        FROM n JOIN e USING (pos) WINDOW w AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)
    ),
    s AS (SELECT *, row_number() OVER (ORDER BY date) - 1 AS nth, strftime(date, '%Y-%m') AS month, CASE WHEN abs(next_return) > usual THEN 1 ELSE 0 END AS label FROM w WHERE pos >= 60 AND next_return IS NOT NULL),
    each AS (
        SELECT 0 AS series, nth, date, month, label, spreads AS score FROM s UNION ALL SELECT 2, nth, date, month, label, rolling FROM s
        UNION ALL SELECT 3, nth, date, month, label, sqrt(v) FROM s UNION ALL SELECT 4, nth, date, month, label, move FROM s
    )"""
FITS = """,
    calendar AS (SELECT *, lag(test_from, 6) OVER (PARTITION BY series ORDER BY month) AS validate_from FROM (SELECT series, month, min(nth) AS test_from FROM each GROUP BY series, month)),
    folds AS (SELECT *, CASE WHEN validate_from > 1 THEN validate_from - 1 ELSE 1 END AS upto FROM calendar WHERE validate_from IS NOT NULL),
    stats AS (
        SELECT f.series, f.month, any_value(upto) AS upto, (sum(label) + 0.5) / (count(*) + 1) AS prior, avg(score) AS mean, stddev_pop(score) AS sd, sum(label) BETWEEN 1 AND count(*) - 1 AS mixed
        FROM folds f JOIN each e ON e.series = f.series AND e.nth < f.upto GROUP BY f.series, f.month
    ),
    scaled AS (SELECT series, month, upto, mean, ln(prior / (1 - prior)) AS b0, CASE WHEN sd > 1e-12 THEN sd ELSE 1 END AS sd, CASE WHEN sd > 1e-12 AND mixed THEN 1 ELSE 0 END AS going FROM stats),
    fit AS (
        SELECT series, month, 0 AS step, CAST(b0 AS DOUBLE) AS b, CAST(going AS DOUBLE) AS m FROM scaled
        UNION ALL
        SELECT series, month, step + 1, greatest(-20, least(20, b - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01))), greatest(-20, least(20, m - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)))
        FROM (
            SELECT series, month, step, any_value(b) AS b, any_value(m) AS m, sum(q - label) AS g0, sum((q - label) * z) AS g1,
                   sum(greatest(q * (1 - q), 1e-8)) + 1e-6 AS h00, sum(greatest(q * (1 - q), 1e-8) * z) AS h01, sum(greatest(q * (1 - q), 1e-8) * z * z) + 1e-6 AS h11
            FROM (
                SELECT f.*, label, (score - mean) / sd AS z, 1 / (1 + exp(-greatest(-30, least(30, b + m * (score - mean) / sd)))) AS q
                FROM fit f JOIN scaled c USING (series, month) JOIN each e ON e.series = f.series AND e.nth < c.upto WHERE step < 30 AND going = 1
            ) GROUP BY series, month, step
        )
    ),
    fitted AS (SELECT series, month, any_value(mean) AS mean, any_value(sd) AS sd, arg_max(b, step) AS b, arg_max(m, step) AS m FROM fit JOIN scaled USING (series, month) GROUP BY series, month)"""
REFITS = SAMPLES + FITS + " SELECT CAST(series AS BIGINT) AS series, date, CAST(label AS BIGINT) AS label, 1 / (1 + exp(-greatest(-30, least(30, b + m * (score - mean) / sd)))) AS p FROM each JOIN fitted USING (series, month)"


def predicted(x, d):
    return volatility.predictions(volatility.samples(s.daily(x, d), SYMBOL))


# Trees with penalties on the market dataset, a ranker of symbols inside a session, and a network over sessions

MARKET = ["return_1", "return_3", "volatility_6", "relative_volume", "spread"]
ROUNDS, PATIENCE, NETWORK_EPOCHS = 20, 5, 15


def market_rows(x, d):
    rows = panels.market_dataset(s.daily(x, d), SYMBOL, s.BENCH)
    return labels.chronological(rows, "date", 0.2).replace("test", "validate", "part")


def classified(x, d):
    """The last fifth of the market dataset with its probabilities."""
    rows = market_rows(x, d)
    model = boosted.train(rows, MARKET, [boosted.Setting(rate=0.1)], ["date"], 20, 5)
    return boosted.scored(rows.where("part = 'validate'"), model).select("date", "label", "p")


def ranked(x, d):
    """Symbols by week: the label is a next return among the upper three tenths; the last fifth of weeks with their scores."""
    bars = r.with_returns(s.sector_bars(x, d)).withColumn("ahead", labels.lead("close", 1) / labels.lead("open", 1) - 1)
    names = ["return_1", "return_3", "volatility_6", "relative_volume", "range"]
    values = [r.simple_return(1), r.simple_return(3), r.volatility(6), r.relative_volume("with_current"), r.day_range()]
    rows = bars.select("symbol", "date", "ahead", *(v.alias(n) for v, n in zip(values, names, strict=True))).where("ahead is not null")
    rows = rows.withColumn("label", cross.extreme_label("ahead", True))
    weeks = labels.chronological(rows.select("date").distinct(), "date", 0.2).replace("test", "validate", "part")
    rows = rows.join(weeks, "date")
    model = boosted.train(rows, names, [boosted.RANKER], ["date", "symbol"], 20, 5, "pairwise", "date")
    return boosted.scored(rows.where("part = 'validate'"), model, out="score").select("date", "symbol", "label", "score")


def networked(x, d):
    """The combined panel's sessions with the probabilities of a network over their last thirty, as they are and calibrated.

    The first three fifths of sessions are learnt, the next is checked and calibrated on.
    """
    placed = ordering.numbered(sets.combined(x, d).withColumnRenamed("target_next_close_up", "label"), [], ["date"])
    share = F.col("nth") / F.col("size")
    rows = placed.withColumn("part", F.when(share < 0.6, "train").when(share < 0.8, "validate").otherwise("test")).drop("nth", "size")
    model = temporal.train(rows, sets.COLUMNS, [], "date", temporal.Course(NETWORK_EPOCHS, PATIENCE, 0.01, decay=0.01, clip=1.0, warm_up=2))
    found = temporal.scored(rows, model, [], "date").where("p is not null").select("date", "part", "label", "p", F.lit(1).alias("one"))
    fits = models.platt(found, "one")
    logit = F.log(F.col("p") / (1 - F.col("p")))
    return found.join(F.broadcast(fits), "one").select("date", "part", "label", "p", (1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * logit)))).alias("calibrated"))


def fill(add) -> None:
    q = s.sql
    add("M22", lambda x, d: boosted.search(market_rows(x, d), MARKET, ["date"], rounds=ROUNDS, patience=PATIENCE))
    add("M23", classified)
    add("M23_network", networked)
    add("M23_ranker", ranked)
    add("K3", lambda x, d: stored(x, d), q("articles", ARRIVALS.format(blank="NULL")))
    add("K3_strict", lambda x, d: stored(x, d, blanks=True), q("articles", ARRIVALS.format(blank="''")))
    add("M14", bounds, q("predictions", BOUNDS), "lower")
    add("M13", lambda x, d: predicted(x, d).where("series <> 1").select("series", "date", "label", "p"), q("daily", REFITS), "p", "date")
    add("D14", lambda x, d: volatility.report(predicted(x, d), replicates=REPLICATES))
