"""The combined panel, its repair and checks, the control panels of every kind, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators import asof, news
from tidewright.plans import panels
from tidewright.plans import queries_joins as joins
from tidewright.plans import queries_news as qn
from tidewright.plans import stand_ins as s

SYMBOL, START, END = "1-URGENT", "1995-02-01", "2000-12-31"
COLUMNS = [*panels.MARKET, *panels.NEWS, *panels.EMBEDDED]
WHOLE_NEWS = ("article_count", "abnormal_news_volume", "macro_news_count")
DOUBLES = " ".join(c for c in COLUMNS if c not in WHOLE_NEWS)


def known(x, d):
    """Articles with the session before whose cutoff they are known, and eight numbers as an embedding."""
    at = asof.cutoff_session(joins.stamped(x, d), s.sessions(x, d), F.col("published_ms"), F.col("local"), clean.cutoff_ms).select("doc_id", "session").where("session is not null")
    a = s.articles(x, d).join(at, "doc_id").withColumn("embedding", F.array(*((F.col("doc_id") % (11 + i)).cast("double") for i in range(8))))
    return a.withColumn("seq", F.col("doc_id"))


def combined(x, d):
    return panels.combined(s.daily(x, d), SYMBOL, s.BENCH, known(x, d), START, END)


def market_sql(name: str) -> str:
    return f""", a AS (SELECT date, symbol, close, volume, ln(close / lag(close) OVER o) AS r1, close - lag(close) OVER o AS d1 FROM daily WHERE symbol = '{SYMBOL}' WINDOW o AS (ORDER BY date)), ab AS (SELECT a.*, b.close AS b FROM a LEFT JOIN daily b ON b.date = a.date AND b.symbol = '{s.BENCH}'),
    {name} AS (SELECT * EXCLUDE (i) FROM (SELECT date, close / lag(close) OVER o - 1 AS ret_1, close / lag(close, 3) OVER o - 1 AS ret_3, close / lag(close, 6) OVER o - 1 AS ret_6, stddev_samp(r1) OVER six AS volatility_6, avg(volume) OVER six AS volume_mean_6, volume / greatest(1, avg(volume) OVER six) AS rel_volume,
        CASE WHEN avg(greatest(-d1, 0)) OVER f > 0 THEN 100 - 100 / (1 + avg(greatest(d1, 0)) OVER f / (avg(greatest(-d1, 0)) OVER f)) WHEN avg(greatest(d1, 0)) OVER f > 0 THEN 100 ELSE 50 END AS rsi_14, b / lag(b) OVER o - 1 AS spy_ret_1, close / lag(close) OVER o - 1 - (b / lag(b) OVER o - 1) AS sector_spy_diff, row_number() OVER o AS i
        FROM ab WINDOW o AS (ORDER BY date), six AS (ORDER BY date ROWS 5 PRECEDING), f AS (ORDER BY date ROWS 13 PRECEDING)) WHERE i > 14 AND spy_ret_1 IS NOT NULL)"""


def combined_sql(body: str) -> str:
    vector = ", ".join(f"coalesce({a}, 0) AS {b}" for a, b in zip(qn.VECTOR_SQL_NAMES, panels.NEWS, strict=True))
    dims = ", ".join(f"avg(doc_id % {11 + i}) AS embedding_{i}" for i in range(8))
    return s.sql("daily articles sessions", f""", {joins.CUTS}{market_sql('mv')}, pr AS (SELECT date AS session, lag(date) OVER (ORDER BY date) AS date FROM a),
    kn AS (SELECT n.*, pr.date FROM (SELECT articles.*, cuts.session FROM articles ASOF JOIN cuts ON published_ms <= cutoff) n JOIN pr USING (session) WHERE session BETWEEN DATE '{START}' AND DATE '{END}' AND pr.date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) = 1),
    ve AS (SELECT date, {qn.VECTOR_SQL}, {dims} FROM kn GROUP BY date), la AS (SELECT date, CAST(lead(close) OVER (ORDER BY date) > close AS BIGINT) AS target_next_close_up FROM a WHERE date BETWEEN DATE '{START}' AND DATE '{END}'),
    cb AS (SELECT date, {', '.join('mv.' + c for c in panels.MARKET)}, {vector}, {', '.join(f'coalesce({c}, 0) AS {c}' for c in panels.EMBEDDED)}, target_next_close_up FROM mv JOIN la USING (date) LEFT JOIN ve USING (date) WHERE target_next_close_up IS NOT NULL) {body}""")


def damaged(x, d):
    """The combined panel with its market columns spoilt, and a date that has no history."""
    spoilt = combined(x, d).withColumns({c: F.lit(0.0) for c in panels.MARKET})
    return spoilt.unionByName(spoilt.limit(1).withColumn("date", F.lit("1990-01-01").cast("date")))


def by_profile(x, d):
    """For each profile, how many columns it has and their sum by date."""
    rows = combined(x, d)
    found = panels.ablation_profiles(COLUMNS)
    total = lambda cs: sum((F.col(c).cast("double") for c in cs), F.lit(0.0))
    return rows.select("date", F.explode(F.array(*(F.struct(F.lit(n).alias("profile"), F.lit(len(cs)).alias("columns"), total(cs).alias("total")) for n, cs in found.items()))).alias("p")).select("date", "p.*")


def control(panel, found, keys):
    """A panel's rows with the aggregates of their keys, 0 where there are none."""
    return news.zero_filled(panel, found, keys)


def fill(add) -> None:
    q = s.sql
    add("D2", combined, combined_sql("SELECT * FROM cb"), DOUBLES, "date", " ".join(WHOLE_NEWS))
    add("D3", lambda x, d: panels.repaired(damaged(x, d), s.daily(x, d), SYMBOL, s.BENCH), combined_sql("SELECT * FROM cb"), DOUBLES, "date", " ".join(WHOLE_NEWS))
    totals = {n: " + ".join(f"CAST({c} AS DOUBLE)" for c in cs) or "0" for n, cs in panels.ablation_profiles(COLUMNS).items()}
    add("M25", by_profile, combined_sql(" UNION ALL ".join(f"SELECT date, '{n}' AS profile, {len(cs)}::BIGINT AS columns, {totals[n]} AS total FROM cb" for n, cs in panels.ablation_profiles(COLUMNS).items())), "total", "date")
    spoilt = lambda x, d: s.predictions(x, d).withColumn("label", F.when(F.col("doc_id") % 10 == 0, 2).otherwise(F.col("label"))).withColumn("key", F.floor(F.col("doc_id") / 2)).select("doc_id", "key", "p", "label")
    add("S21", lambda x, d: panels.dataset_faults(spoilt(x, d), "key", "label", "doc_id"), q("predictions", "SELECT count(*) AS rows, count(*) FILTER (WHERE key <= before) AS bad_keys, count(*) FILTER (WHERE doc_id % 10 = 0) AS bad_targets, 0::BIGINT AS not_finite, false AS usable FROM (SELECT doc_id, doc_id // 2 AS key, max(doc_id // 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM predictions)"))
    # control panels
    grid = lambda x, d: s.sessions(x, d).select(F.col("session").alias("date")).join(s.table(x, d, "documents").select(F.col("lang").alias("sector")).distinct(), F.lit(True))
    a3 = "SELECT day AS date, sector, count(*) AS news_rows, 1::BIGINT AS has_news, count(DISTINCT content_hash) / count(*) AS distinct_share, count(DISTINCT CASE WHEN trim(publisher) <> '' THEN publisher END) AS publishers FROM articles GROUP BY 1, 2"
    zero = lambda cs, has: ", ".join(f"coalesce({c}, 0) AS {c}" for c in cs) + f", CASE WHEN {has} IS NULL THEN 'empty' ELSE 'ok' END AS coverage_status"
    add("D5_news", lambda x, d: control(grid(x, d), news.control_counts(s.articles(x, d).withColumnRenamed("day", "date"), ["date", "sector"]), ["date", "sector"]), q("sessions articles", f"SELECT g.date, g.sector, {zero(('news_rows', 'has_news', 'distinct_share', 'publishers'), 'news_rows')} FROM (SELECT session AS date, lang AS sector FROM sessions, (SELECT DISTINCT lang FROM documents)) g LEFT JOIN ({a3}) f ON f.date = g.date AND f.sector = g.sector"), "distinct_share", "date")
    kinds = ("filings", "issuers", "n_8k", "n_10q", "n_10k", "n_other")
    a4 = "SELECT accepted AS date, sector AS symbol, count(*) AS filings, count(DISTINCT issuer) AS issuers, count(*) FILTER (WHERE form LIKE '8-K%') AS n_8k, count(*) FILTER (WHERE form LIKE '10-Q%') AS n_10q, count(*) FILTER (WHERE form LIKE '10-K%') AS n_10k, count(*) FILTER (WHERE NOT (form LIKE '8-K%' OR form LIKE '10-Q%' OR form LIKE '10-K%')) AS n_other FROM filings GROUP BY 1, 2"
    filed = lambda x, d: s.filings(x, d).withColumnsRenamed({"sector": "symbol", "accepted": "date"})
    bars = lambda x, d: s.daily(x, d).select("symbol", "date")
    add("D5_sec", lambda x, d: control(bars(x, d), news.filing_counts(filed(x, d), ["date", "symbol"]), ["date", "symbol"]), q("daily filings", f"SELECT symbol, date, {zero(kinds, 'filings')} FROM (SELECT symbol, date FROM daily) LEFT JOIN ({a4}) USING (symbol, date)"), "", "date")
    add("D5_fundamentals", lambda x, d: control(bars(x, d), qn.fundamentals(x, d).withColumnsRenamed({"day": "date", "sector": "symbol"}), ["date", "symbol"]), q("daily filings", f"""SELECT symbol, date, {zero(('issuers', 'mean_positive'), 'issuers')} FROM (SELECT symbol, date FROM daily) LEFT JOIN (SELECT day AS date, sector AS symbol, count(*) AS issuers, coalesce(avg(CASE WHEN sentiment > 0 THEN sentiment END), 0) AS mean_positive FROM (SELECT m.day, f.sector, f.issuer, f.sentiment
        FROM (SELECT DISTINCT CAST(date_trunc('month', accepted) AS DATE) AS day FROM filings) m, filings f WHERE f.accepted <= m.day QUALIFY row_number() OVER (PARTITION BY m.day, f.issuer ORDER BY accepted DESC, filing DESC) = 1) GROUP BY 1, 2) USING (symbol, date)"""), "mean_positive", "date")
    add("D5_insider", lambda x, d: control(bars(x, d), qn.insiders(x, d).withColumnsRenamed({"session": "date", "sector": "symbol"}), ["date", "symbol"]), q("daily filings sessions", f"SELECT symbol, date, {zero(('form4', 'form3_5', 'schedule13', 'issuers'), 'issuers')} FROM (SELECT symbol, date FROM daily) LEFT JOIN (SELECT session AS date, sector AS symbol, count(*) FILTER (WHERE form = '4') AS form4, count(*) FILTER (WHERE form IN ('3', '5')) AS form3_5, count(*) FILTER (WHERE form LIKE 'SC 13%' OR form LIKE 'SCHEDULE 13%') AS schedule13, count(DISTINCT issuer) AS issuers FROM filings f ASOF JOIN sessions ON accepted < session GROUP BY 1, 2) USING (symbol, date)"), "", "date")
