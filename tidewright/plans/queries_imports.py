"""Documents and orders as a fund's archive, dated and timed news, and filings; outcomes and articles, with twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators import imports
from tidewright.plans import queries_articles as qa
from tidewright.plans import queries_joins as joins
from tidewright.plans import stand_ins as s

START, END = "1995-06-01", "1997-12-31"
STEP = 100_000


def spells(x, d):
    """Holdings as spells of 200 days from their snapshot; a symbol changes sectors by quarter."""
    h = s.snapshots(x, d)
    sector = ((F.col("symbol") + F.quarter("snapshot")) % 3).cast("string")
    return h.select(F.col("symbol").cast("string").alias("symbol"), sector.alias("sector"), F.col("snapshot").alias("available_from"), F.trunc("snapshot", "quarter").alias("effective_from"), F.date_add("snapshot", 200).alias("effective_to"))


def at(scale: int = STEP):
    return F.lit(qa.BASE) + F.col("doc_id") * scale


def dated(x, d):
    i = F.col("doc_id")
    day = F.when(i % 17 == 0, "n/a").otherwise(clean.epoch_date(at()).cast("string"))
    return s.table(x, d, "documents").select(
        i.alias("seq"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.floor(i / 4))).alias("uuid"), (F.floor(i / 4) % 150 + 1).cast("string").alias("symbol"), F.when(i % 5 == 0, "").otherwise("title").alias("title"),
        F.col("source").alias("publisher"), day.alias("report_date"), F.lit("link").alias("link"), F.when(i % 2 == 0, F.col("text")).otherwise("").alias("article"),
    )


def timed(x, d):
    i = F.col("doc_id")
    companies = F.array((i % 150 + 1).cast("string"), (i % 40 + 1).cast("string"), (i % 40 + 1).cast("string"))
    return s.table(x, d, "documents").select(
        i.alias("seq"), F.when(i % 17 == 0, "soon").otherwise(qa.clock(at(), " ")).alias("date_publish"), F.when(i % 2 == 0, "").otherwise(qa.clock(at() + (i % 3) * 40_000, " ")).alias("date_download"),
        F.when(i % 5 == 0, " ").otherwise(F.col("lang")).alias("title"), F.when(i % 4 == 1, "").otherwise(F.lit("same text")).alias("maintext"),
        F.when(i % 13 == 0, F.array().cast("array<string>")).otherwise(companies).alias("mentioned_companies"), F.concat(F.lit("link"), i).alias("url"), F.when(i % 2 == 0, "").otherwise("outlet").alias("news_outlet"), F.col("source").alias("source_domain"),
    )


def archive(x, d):
    i = F.col("doc_id")
    raw = F.when(i % 17 == 0, "soon").otherwise(qa.clock(at(), " "))
    return s.table(x, d, "documents").select(i.alias("seq"), raw.alias("published_raw"), F.concat(F.lit(" "), i % 150 + 1).alias("symbol"), F.when(i % 19 == 0, " ").otherwise(F.col("lang")).alias("title"), F.col("source").alias("summary"), F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("link"), F.floor(i / 5))).alias("url"), F.lit("p").alias("publisher"))


def held(x, d):
    return s.snapshots(x, d).select("snapshot", F.col("symbol").cast("string").alias("symbol"))


def filed(x, d):
    f, i = s.filings(x, d), F.col("filing")
    seconds = i * 7919 % 86_400
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(seconds / 3600), two(seconds % 3600 / 60), two(seconds % 60))
    accepted = F.when(i % 19 == 0, "unknown").otherwise(F.concat(F.col("accepted").cast("string"), F.lit("T"), clock, F.lit(".000Z")))
    return f.select(F.col("issuer").cast("string").alias("cik"), (F.col("issuer") % 3).cast("string").alias("sector"), F.col("issuer").cast("string").alias("symbol"), "form", accepted.alias("acceptance"), i.cast("string").alias("accession"), F.lit("d.htm").alias("document"))


def filing_rows(x, d, preopen):
    found = imports.filing_events(filed(x, d), spells(x, d), qa.calendar(x, d), START, END, preopen)
    return found.select("accession", "outcome", F.when(F.col("outcome") == imports.OK, F.col("trading_date")).alias("trading_date"), "content_hash", "published_at")


CALENDAR = """, calendar AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders),
    sessions_of AS (SELECT session, lag(session) OVER (ORDER BY session) AS previous FROM calendar),
    spells AS (SELECT CAST(symbol AS VARCHAR) AS symbol, CAST((symbol + quarter(snapshot)) % 3 AS VARCHAR) AS sector, snapshot AS available_from, CAST(date_trunc('quarter', snapshot) AS DATE) AS effective_from, snapshot + 200 AS effective_to FROM snapshots)"""
HOLDS = "available_from < {0} AND effective_from <= {0} AND effective_to >= {0}"
IN_RANGE = f"BETWEEN DATE '{START}' AND DATE '{END}'"
INSTANT = f"({qa.BASE} + doc_id * {STEP})"
DATED = f"""{CALENDAR},
    r AS (
        SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'u' || (doc_id // 4) END AS uuid, CAST((doc_id // 4) % 150 + 1 AS VARCHAR) AS symbol, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'title' END AS title,
               CASE WHEN doc_id % 17 <> 0 THEN CAST(make_timestamp({INSTANT} * 1000000) AS DATE) END AS day, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END AS article, source
        FROM documents
    ),
    p AS (SELECT r.*, session AS trading_date FROM r ASOF LEFT JOIN calendar ON day < session),
    m AS (SELECT doc_id, list(DISTINCT sector) AS sectors FROM p JOIN spells USING (symbol) WHERE {HOLDS.format("trading_date")} GROUP BY doc_id),
    o AS (
        SELECT p.*, sectors, CASE WHEN day IS NULL THEN 'invalid_date' WHEN NOT day {IN_RANGE} THEN 'outside_range' WHEN trading_date IS NULL OR trading_date > DATE '{END}' THEN 'no_session'
               WHEN sectors IS NULL THEN 'not_member' WHEN title || article = '' THEN 'empty' ELSE 'ok' END AS outcome
        FROM p LEFT JOIN m USING (doc_id)
    )"""
DATED_ARTICLES = f"""{DATED}, e AS (
        SELECT doc_id, unnest(sectors) AS sector, coalesce(uuid, sha256(symbol || '|' || CAST(day AS VARCHAR) || '|' || title || '|link')) AS id, symbol, trading_date, day, source,
               CASE WHEN article = '' THEN title ELSE title || chr(10) || chr(10) || article END AS text
        FROM o WHERE outcome = 'ok'
    )
    SELECT 'yahoo:' || id || ':' || symbol AS article_id, CAST(day AS VARCHAR) || ' 00:00:00' AS published_at, '{imports.DATE_ONLY}' AS timestamp_quality, trading_date, sector, symbol, 'link' AS url, source AS publisher, sha256(text) AS content_hash
    FROM e QUALIFY row_number() OVER (PARTITION BY id, symbol, sector, trading_date ORDER BY doc_id) = 1"""
TIMED = f"""{CALENDAR},
    r AS (
        SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN {INSTANT} + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE doc_id % 3 * 40000 END END AS available_s, strftime(make_timestamp({INSTANT} * 1000000), '%Y-%m-%d %H:%M:%S') AS date_publish,
               trim(CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE coalesce(lang, '') END) AS title, CASE WHEN doc_id % 4 = 1 THEN '' ELSE 'same text' END AS body,
               CASE WHEN doc_id % 13 = 0 THEN [] ELSE list_distinct([CAST(doc_id % 150 + 1 AS VARCHAR), CAST(doc_id % 40 + 1 AS VARCHAR)]) END AS companies, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'outlet' END AS publisher
        FROM documents
    ),
    t AS (SELECT *, CAST(make_timestamp(available_s * 1000000) AS DATE) AS day FROM r),
    w AS (SELECT *, CASE WHEN available_s * 1000 <= {joins.wall("day", 9, 20)} THEN day ELSE day + 1 END AS wanted FROM t),
    p AS (SELECT w.*, session AS trading_date FROM w ASOF LEFT JOIN calendar ON wanted <= session),
    m AS (SELECT DISTINCT doc_id, symbol, sector FROM (SELECT doc_id, trading_date, unnest(companies) AS symbol FROM p) JOIN spells USING (symbol) WHERE {HOLDS.format("trading_date")}),
    o AS (
        SELECT p.*, CASE WHEN available_s IS NULL THEN 'invalid_date' WHEN NOT day {IN_RANGE} THEN 'outside_range' WHEN trading_date IS NULL OR trading_date > DATE '{END}' THEN 'no_session' WHEN title || body = '' THEN 'empty'
               WHEN len(companies) = 0 THEN 'no_ticker' WHEN doc_id NOT IN (SELECT doc_id FROM m) THEN 'not_member' ELSE 'ok' END AS outcome
        FROM p
    )"""
TIMED_ARTICLES = f"""{TIMED}, e AS (SELECT o.*, symbol, sector, CASE WHEN body = '' THEN title ELSE title || chr(10) || chr(10) || body END AS text FROM o JOIN m USING (doc_id) WHERE outcome = 'ok')
    SELECT 'luckycat:' || sha256('link' || doc_id || '|' || date_publish || '|' || title) || ':' || symbol AS article_id, available_s, '{imports.PREOPEN}' AS timestamp_quality, trading_date, sector, symbol, 'link' || doc_id AS url, publisher, sha256(text) AS content_hash
    FROM e QUALIFY row_number() OVER (PARTITION BY sector, sha256(text), trading_date ORDER BY doc_id, symbol) = 1"""
FUND = f""", calendar AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS session FROM orders), held AS (SELECT DISTINCT snapshot, CAST(symbol AS VARCHAR) AS symbol FROM snapshots), marks AS (SELECT DISTINCT snapshot FROM held),
    r AS (
        SELECT doc_id, CASE WHEN doc_id % 17 <> 0 THEN {INSTANT} END AS at_s, CAST(doc_id % 150 + 1 AS VARCHAR) AS symbol, CASE WHEN doc_id % 19 = 0 THEN '' ELSE trim(coalesce(lang, '')) END AS title, trim(coalesce(source, '')) AS summary,
               CASE WHEN doc_id % 3 <> 0 THEN 'link' || (doc_id // 5) END AS url
        FROM documents
    ),
    t AS (SELECT *, CAST(make_timestamp(at_s * 1000000) AS DATE) AS day, sha256(lower(title || ' ' || summary)) AS content_hash FROM r),
    w AS (SELECT *, CASE WHEN at_s * 1000 <= {joins.wall("day", 9, 20)} THEN day ELSE day + 1 END AS wanted, coalesce(url, content_hash) AS identity FROM t),
    p AS (SELECT w.*, session AS trading_date FROM w ASOF LEFT JOIN calendar ON wanted <= session),
    g AS (SELECT p.*, snapshot FROM p ASOF LEFT JOIN marks ON trading_date > snapshot),
    o AS (
        SELECT g.*, CASE WHEN at_s IS NULL THEN 'missing_timestamp' WHEN title = '' OR trading_date IS NULL OR NOT trading_date {IN_RANGE} THEN 'skipped' WHEN h.symbol IS NULL THEN 'not_member' ELSE 'ok' END AS first
        FROM g LEFT JOIN held h ON h.snapshot = g.snapshot AND h.symbol = g.symbol
    )
    SELECT *, CASE WHEN first = 'ok' AND doc_id > min(CASE WHEN first = 'ok' THEN doc_id END) OVER (PARTITION BY identity) THEN 'duplicate' ELSE first END AS outcome FROM o"""
EVENTS = f"""{CALENDAR},
    f AS (
        SELECT filing, issuer, form, CASE WHEN filing % 19 <> 0 THEN accepted END AS day, CASE WHEN filing % 19 <> 0 THEN epoch(CAST(accepted AS TIMESTAMP)) + filing * 7919 % 86400 END AS at_s,
               CASE WHEN filing % 19 = 0 THEN 'unknownZ' ELSE strftime(make_timestamp(CAST((epoch(CAST(accepted AS TIMESTAMP)) + filing * 7919 % 86400) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') END AS published_at
        FROM filings
    ),
    w AS (SELECT *, CASE WHEN at_s * 1000 <= {joins.wall("day", 9, 20)} THEN day ELSE day + 1 END AS wanted FROM f),
    p AS ({{placed}}),
    o AS (
        SELECT p.*, CASE WHEN form NOT IN ({", ".join(f"'{x}'" for x in imports.FORMS)}) THEN 'form' WHEN held_on IS NULL OR NOT held_on {IN_RANGE} THEN 'date'
               WHEN NOT EXISTS (SELECT 1 FROM spells s WHERE s.symbol = CAST(issuer AS VARCHAR) AND s.sector = CAST(issuer % 3 AS VARCHAR) AND {HOLDS.format("held_on")}) THEN 'not_member' WHEN trading_date IS NULL THEN 'no_session' ELSE 'ok' END AS outcome
        FROM p
    )
    SELECT CAST(filing AS VARCHAR) AS accession, outcome, CASE WHEN outcome = 'ok' THEN trading_date END AS trading_date, sha256((issuer % 3) || '|' || issuer || '|' || filing) AS content_hash, published_at FROM o"""
BY_DAY = "SELECT w.*, session AS trading_date, day AS held_on FROM w ASOF LEFT JOIN calendar ON day < session"
PREOPEN = f"SELECT * EXCLUDE (previous), CASE WHEN at_s * 1000 > {joins.wall('previous', 16)} THEN session END AS held_on, previous AS trading_date FROM (SELECT w.*, session, previous FROM w ASOF LEFT JOIN sessions_of ON wanted <= session)"


def fill(add) -> None:
    q = s.sql
    count = " SELECT outcome, count(*) AS n FROM o GROUP BY 1"
    news = lambda x, d: imports.dated_news(dated(x, d), spells(x, d), qa.calendar(x, d), START, END)
    add("D8_dated", lambda x, d: imports.dated_articles(news(x, d)).drop("text"), q("snapshots", DATED_ARTICLES), "", "trading_date")
    add("D8_dated_ledger", lambda x, d: imports.ledger(news(x, d)), q("snapshots", DATED + count))
    wire = lambda x, d: imports.timed_news(timed(x, d), spells(x, d), qa.calendar(x, d), START, END)
    add("D8_timed", lambda x, d: imports.timed_articles(wire(x, d)).drop("text"), q("snapshots", TIMED_ARTICLES), "", "trading_date")
    add("D8_timed_ledger", lambda x, d: imports.ledger(wire(x, d)), q("snapshots", TIMED + count))
    fund = lambda x, d: imports.fund_news(archive(x, d), held(x, d), qa.calendar(x, d), START, END)
    kept = "article_id seq published_s trading_date cutoff_ms symbol snapshot extrapolated content_hash identity".split()
    named = f"SELECT sha256(symbol || '|' || CAST(trading_date AS VARCHAR) || '|' || identity) AS article_id, doc_id AS seq, at_s AS published_s, trading_date, CAST({joins.wall('trading_date', 9, 20)} AS BIGINT) AS cutoff_ms, symbol, snapshot, trading_date > (SELECT max(snapshot) FROM snapshots) AS extrapolated, content_hash, identity"
    add("D6_provenance", lambda x, d: fund(x, d).where(F.col("outcome") == imports.OK).select(*kept), f"{named} FROM ({q('snapshots', FUND)}) WHERE outcome = 'ok'".replace("(SELECT max(snapshot) FROM snapshots)", "(SELECT max(last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH)) FROM orders)"), "", "trading_date snapshot")
    add("D6_ledger", lambda x, d: imports.ledger(fund(x, d)), f"SELECT outcome, count(*) AS n FROM ({q('snapshots', FUND)}) GROUP BY 1")
    add("D9_by_day", lambda x, d: filing_rows(x, d, False), q("snapshots filings", EVENTS.format(placed=BY_DAY)), "", "trading_date")
    add("D9_preopen", lambda x, d: filing_rows(x, d, True), q("snapshots filings", EVENTS.format(placed=PREOPEN)), "", "trading_date")
