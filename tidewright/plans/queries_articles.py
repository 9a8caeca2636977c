"""Documents as rows of a news archive and as versions of stories, under the orders' calendar and holdings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators import articles
from tidewright.plans import stand_ins as s

BASE = 788_918_400  # 1995-01-01
START, END = "1995-01-01", "1998-12-31"


def clock(at, joint: str):
    """Seconds as text, with joint between date and time."""
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    day = F.pmod(at, F.lit(86_400))
    return F.concat(clean.epoch_date(at).cast("string"), F.lit(joint), F.concat_ws(":", two(day / 3600), two(F.pmod(day, F.lit(3600)) / 60), two(F.pmod(day, F.lit(60)))))


def calendar(x, d):
    return s.table(x, d, "orders").select(F.to_date("o_orderdate").alias("session")).distinct()


def holdings(x, d):
    return s.snapshots(x, d).select("snapshot", F.col("symbol").cast("string").alias("symbol"), (F.col("symbol") % 3).cast("string").alias("sector"))


def archive(x, d):
    """Documents; every third one has a date without a time."""
    at = F.lit(BASE) + F.col("doc_id") * 11_700
    raw = F.when(F.col("doc_id") % 3 == 0, clean.epoch_date(at).cast("string")).otherwise(F.concat(clock(at, " "), F.lit(" UTC")))
    return s.table(x, d, "documents").select(raw.alias("published_raw"), (F.col("doc_id") % 150 + 1).cast("string").alias("symbol"), F.col("text").alias("title"), F.col("lang").alias("summary"), F.col("doc_id").cast("string").alias("url"), F.col("source").alias("publisher"))


def versions(x, d):
    """Documents as versions, four to a story; every eleventh withdraws it, half of those without naming a symbol."""
    i, story = F.col("doc_id"), F.floor(F.col("doc_id") / 4)
    at = F.lit(BASE) + story * 46_800 + (i % 4) * 9000
    none = F.lit(None).cast("string")
    return s.table(x, d, "documents").select(
        F.concat(F.lit("story-"), story).alias("id"), none.alias("altId"), none.alias("firstCreated"), F.concat(clock(at, "T"), F.lit("Z")).alias("versionCreated"), (i % 4).cast("int").alias("takeSequence"),
        F.when(i % 11 == 0, "WITHDRAWN").otherwise("STORY").alias("messageType"), none.alias("pubStatus"), F.col("source").alias("provider"), F.col("lang").alias("headline"), F.col("text").alias("body"), none.alias("url"),
        F.when(i % 22 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), story % 150 + 1), F.lit("unknown"))).alias("subjects"),
    )


def entities(x, d):
    return s.table(x, d, "customer").select(F.concat(F.lit("E"), "c_custkey").alias("subject"), F.col("c_custkey").cast("string").alias("symbol"))


def sunday(first: str) -> str:
    """The first Sunday on or after a date."""
    return f"({first} + CAST((7 - dayofweek({first})) % 7 AS INTEGER))"


OFFSET = f"CASE WHEN day >= {sunday('make_date(year(day), 3, 8)')} AND day < {sunday('make_date(year(day), 11, 1)')} THEN 4 ELSE 5 END"
TABLES = "calendar AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders), held AS (SELECT snapshot, CAST(symbol AS VARCHAR) AS symbol, CAST(symbol % 3 AS VARCHAR) AS sector FROM snapshots), days AS (SELECT DISTINCT snapshot FROM held)"
ARCHIVE = f""", {TABLES}, a AS (SELECT *, CAST(make_timestamp(at_s * 1000000) AS DATE) AS day FROM (SELECT doc_id, {BASE} + doc_id * 11700 AS at_s, CAST(doc_id % 150 + 1 AS VARCHAR) AS symbol, text, sha256(lower(trim(text) || ' ' || trim(coalesce(lang, '')))) AS content_hash FROM documents WHERE trim(text) <> '')),
    b AS (SELECT *, epoch(CAST(day AS TIMESTAMP)) AS midnight, {OFFSET} AS off, doc_id % 3 = 0 OR at_s % 86400 = 0 AS plain FROM a), c AS (SELECT *, CAST(CASE WHEN plain THEN midnight ELSE at_s + shift * off * 7200 END AS BIGINT) AS published_s FROM b, (SELECT {{shift}} AS shift)),
    e AS (SELECT *, CASE WHEN shift = 1 AND NOT plain AND published_s <= midnight + (9 + off) * 3600 + 1200 THEN day ELSE day + 1 END AS wanted, CASE WHEN plain THEN '{articles.DATE_ONLY}' WHEN shift = 1 THEN '{articles.REPAIRED}' ELSE '{articles.UNVERIFIED}' END AS timestamp_quality FROM c),
    f AS (SELECT e.*, session AS trading_date FROM e ASOF JOIN calendar ON wanted <= session WHERE session BETWEEN DATE '{START}' AND DATE '{END}'), g AS (SELECT f.*, snapshot FROM f ASOF JOIN days ON day > snapshot),
    h AS (SELECT g.*, sector, snapshot = (SELECT max(snapshot) FROM days) AS extrapolated, sha256(sector || '|' || symbol || '|' || CAST(trading_date AS VARCHAR) || '|' || content_hash) AS article_id FROM g JOIN held USING (snapshot, symbol)),
    k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY sector, content_hash ORDER BY trading_date, day, article_id, at_s, CAST(doc_id AS VARCHAR)) = 1)"""
STORIES = f""", {TABLES}, v AS (SELECT *, CAST(make_timestamp(at_s * 1000000) AS DATE) AS day FROM (SELECT doc_id, text, lang, 'story-' || (doc_id // 4) AS id, doc_id % 4 AS take, {BASE} + (doc_id // 4) * 46800 + (doc_id % 4) * 9000 AS at_s, doc_id % 11 = 0 AS withdrawn, CASE WHEN doc_id % 22 <> 0 THEN CAST((doc_id // 4) % 150 + 1 AS VARCHAR) END AS subject FROM documents)),
    known AS (SELECT DISTINCT id, subject AS symbol FROM v WHERE NOT withdrawn), w AS (SELECT v.*, coalesce(subject, symbol) AS symbol, CASE WHEN at_s <= epoch(CAST(day AS TIMESTAMP)) + (16 + {OFFSET}) * 3600 THEN day ELSE day + 1 END AS wanted FROM v LEFT JOIN known ON known.id = v.id AND v.subject IS NULL),
    p AS (SELECT w.*, session AS trading_date FROM w ASOF JOIN calendar ON wanted <= session WHERE symbol IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) AND session BETWEEN DATE '{START}' AND DATE '{END}'), m AS (SELECT p.*, sector FROM (SELECT p.*, snapshot FROM p ASOF JOIN days ON trading_date > snapshot) p JOIN held USING (snapshot, symbol))
    SELECT 'mrn:' || id || ':' || take || ':' || symbol AS article_id, at_s AS published_s, trading_date, sector, symbol, sha256(coalesce(text, '')) AS body FROM (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY id, sector, symbol, trading_date ORDER BY at_s DESC, take DESC) = 1) WHERE NOT withdrawn"""


def fill(add) -> None:
    columns = "article_id published_s timestamp_quality trading_date sector symbol content_hash extrapolated"
    for name, repair in (("D7", False), ("D7_repaired", True)):
        found = lambda x, d, repair=repair: articles.archive_articles(archive(x, d), holdings(x, d), calendar(x, d), START, END, repair)
        twin = s.sql("snapshots", ARCHIVE.format(shift=int(repair)))
        add(name, lambda x, d, found=found: found(x, d).select(*columns.split()), f"{twin} SELECT {', '.join(columns.split())} FROM k", "", "trading_date")
        add(f"{name}_ledger", lambda x, d, found=found: articles.archive_counts(found(x, d)), f"{twin} SELECT sector, timestamp_quality, count(*) AS n, count(*) FILTER (WHERE extrapolated) AS extrapolated FROM k GROUP BY 1, 2")
    told = lambda x, d: articles.story_articles(versions(x, d), entities(x, d), holdings(x, d), calendar(x, d), START, END)
    add("D8", lambda x, d: told(x, d).select("article_id", "published_s", "trading_date", "sector", "symbol", F.sha2(F.coalesce("summary", F.lit("")), 256).alias("body")), s.sql("snapshots", STORIES), "", "trading_date")
