"""Messages, matrices, fund reports, databases, caches and exhibits: each written and read back, with DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.operators import exhibits
from tidewright.plans import queries_news as qn
from tidewright.plans import stand_ins as s
from tidewright.session import shared_path
from tidewright.sources import caches, database, matrix, nport, protobuf
from tidewright.streaming import ingest, live

# Trades and bars as protobuf messages, some of them damaged


def wire_trades(x, d):
    """Trades as messages: without an id, without a symbol, with a field of a newer version, or cut short, by their number."""
    t, i = s.trades(x, d), F.col("event_id")
    meta = F.struct(F.when(i % 11 == 5, "").otherwise(F.concat(F.lit("t"), i)).alias("event_id"), F.col("ts_ms").alias("event_time_unix_ms"), F.lit("file").alias("producer"), F.lit("trade-event-v1").alias("schema_version"))
    volume = F.when(F.isnan("volume") | F.col("volume").isNull(), 0.0).otherwise(F.col("volume"))
    conditions = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda k: F.concat(F.lit("c"), k))
    body = F.struct(
        meta.alias("metadata"), F.when(i % 13 == 2, "").otherwise(F.col("symbol")).alias("symbol"), F.col("price"), volume.alias("volume"), F.col("ts_ms").alias("source_timestamp_unix_ms"),
        F.lit("file").alias("source"), F.when(i % 2 == 0, conditions).otherwise(F.array().cast("array<string>")).alias("trade_conditions"),
    )
    sent = protobuf.encoded(t, body, protobuf.TRADE).select("event_id", "payload")
    newer = F.concat("payload", F.unhex(F.lit("F80105")))
    cut = F.substring("payload", F.lit(1), F.octet_length("payload") - 1)
    return sent.withColumn("payload", F.when(i % 7 == 3, cut).when(i % 17 == 4, newer).otherwise(F.col("payload")))


def read_trades(x, d):
    found = protobuf.decoded(wire_trades(x, d), "payload", protobuf.TRADE, protobuf.trade_fault)
    m = F.col("message")
    return found.select("event_id", "reject_reason", m["metadata"]["event_id"].alias("id"), m["symbol"].alias("symbol"), m["price"].alias("price"), m["volume"].alias("volume"), m["source_timestamp_unix_ms"].alias("ts_ms"), F.size(m["trade_conditions"]).cast("long").alias("conditions"))


WIRE = """SELECT event_id, reason AS reject_reason, CASE WHEN reason IS NULL THEN 't' || event_id END AS id, CASE WHEN reason IS NULL THEN symbol END AS symbol, CASE WHEN reason IS NULL THEN price END AS price,
    CASE WHEN reason IS NULL THEN coalesce(volume, 0) END AS volume, CASE WHEN reason IS NULL THEN ts_ms END AS ts_ms, CASE WHEN reason IS NULL THEN CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) END AS conditions
    FROM (SELECT *, CASE WHEN event_id % 7 = 3 THEN 'truncated' WHEN event_id % 11 = 5 OR event_id % 13 = 2 THEN 'missing identity' END AS reason FROM trades)"""


def read_bars(x, d):
    """Daily bars as messages of two versions, of which one is known."""
    day = F.unix_date("date")
    ms = day.cast("long") * 86_400_000
    version = F.when(day % 5 == 0, "market-bar-v2").otherwise(protobuf.BAR_VERSION)
    body = F.struct(F.struct(F.concat_ws(":", "symbol", "date").alias("event_id"), version.alias("schema_version")).alias("metadata"), "symbol", F.lit("1d").alias("interval"), ms.alias("bar_start_unix_ms"), "open", "high", "low", "close", "volume", F.col("volume").cast("decimal(20,0)").alias("trade_count"), F.lit(True).alias("finalized"))
    sent = protobuf.encoded(s.daily(x, d), body, protobuf.BAR).select("symbol", "date", "payload")
    found, m = protobuf.decoded(sent, "payload", protobuf.BAR, protobuf.bar_fault), F.col("message")
    return found.select("symbol", "date", "reject_reason", m["bar_start_unix_ms"].alias("start_ms"), m["close"].alias("close"), m["trade_count"].cast("long").alias("trades"), m["finalized"].alias("finalized"))


# A cache of what a model says of a text, filled in two runs of which the first was stopped


def cached(x, d):
    """Articles with the score of their content, from a cache by content hash: two shards of five first, then the rest."""
    docs = s.table(x, d, "documents").where("text is not null").select("doc_id", F.sha2(F.lower("text"), 256).alias("content_hash"), F.length("text").alias("length"))
    path, schema = shared_path(x, "cache"), "content_hash string, score double"
    model = lambda rows: rows.select("content_hash", ((F.col("length") % 97) / 100 - (F.col("length") % 61) / 200).alias("score"))
    caches.extend_cache(docs, path, "content_hash", model, schema, 5, only=[0, 3])
    caches.extend_cache(docs, path, "content_hash", model, schema, 5)
    return docs.join(caches.read_cache(x, path, schema), "content_hash").select("doc_id", "content_hash", "score")


# A stream of messages with poison among them; B15: symbols that fall silent


def messages(x, d):
    """Trades as lines of JSON, some cut, some without an id, a symbol or a price above 0."""
    t, i = s.trades(x, d), F.col("event_id")
    body = F.struct(F.when(i % 11 == 5, "").otherwise(i.cast("string")).alias("event_id"), F.when(i % 13 == 2, " ").otherwise(F.col("symbol")).alias("symbol"), F.when(i % 17 == 4, -F.col("price")).otherwise(F.col("price")).alias("price"), F.coalesce("volume", F.lit(0.0)).alias("volume"), "ts_ms", "seq")
    line = F.to_json(body)
    return t.select(F.when(i % 7 == 3, F.substring(line, 1, 9)).otherwise(line).alias("value"))


def ingested(x, d):
    path = shared_path(x, "messages")
    messages(x, d).repartition(4).write.text(f"{path}/in")
    stream = x.readStream.schema("value string").option("maxFilesPerTrigger", 2).text(f"{path}/in")
    ingest.ingest(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return ingest.written_batches(x, f"{path}/out", f"value string, {ingest.TRADE}, reject_reason string")


def letters(x, d):
    return ingested(x, d).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def sent(x, d):
    """What goes out again: rows that were kept, keyed by symbol."""
    rows = ingested(x, d).where("reject_reason is null").select("event_id", "symbol", "ts_ms")
    return ingest.outbox(rows, "symbol", "event_id")


FAULTS = "CASE WHEN event_id % 7 = 3 THEN 'malformed' WHEN event_id % 11 = 5 OR event_id % 13 = 2 THEN 'missing identity' WHEN event_id % 17 = 4 OR NOT price > 0 THEN 'invalid price' END"


def silent(x, d):
    """Trades of which one kind stops after a third: bars that each symbol's own clock has finished."""
    ids = s.table(x, d, "events").agg(F.max("event_id")).first()[0]
    path = shared_path(x, "trades")
    t = s.trades(x, d).where((F.col("symbol") != "view") | (F.col("event_id") * 3 < ids)).withColumn("volume", F.coalesce("volume", F.lit(0.0))).withColumn("ts", F.timestamp_millis("ts_ms"))
    t.coalesce(1).write.parquet(f"{path}/in")
    x.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = x.readStream.schema(t.schema).parquet(f"{path}/in")
    write = live.insert_batches(f"{path}/out", ["kind", "symbol", "start_ms", "event_id"], ["start_ms"])
    live.into(live.per_symbol_bars(stream, 3_600_000), f"{path}/checkpoint", write).awaitTermination()
    return x.read.parquet(f"{path}/out").where("kind = 'bar'").select("symbol", "start_ms", "close", "n")


SILENT = """, t AS (SELECT * FROM trades WHERE symbol <> 'view' OR event_id * 3 < (SELECT max(event_id) FROM trades)), m AS (SELECT symbol, max(ts_ms) - 5000 AS mark FROM t GROUP BY 1)
    SELECT symbol, start_ms, close, n FROM (SELECT symbol, CAST(floor(ts_ms / 3600000) AS BIGINT) * 3600000 AS start_ms, arg_max(price, (ts_ms, -seq)) AS close, count(*) AS n FROM t GROUP BY 1, 2) JOIN m USING (symbol) WHERE start_ms + 3600000 <= mark"""


# Embeddings packed, with an index of which every 17th entry points beyond its file

WIDTH = 64


def packed(x, d):
    path = shared_path(x, "matrix")
    e = s.table(x, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), "embedding")
    index = matrix.write_matrix(e.where(F.size("embedding") == WIDTH), "key", "embedding", path, WIDTH)
    wrong = index.withColumn("row", F.when(F.col("input_hash").cast("long") % 17 == 0, F.col("row") + 10_000_000).otherwise(F.col("row")))
    found = matrix.read_matrix(wrong, path, WIDTH)
    return found.select(F.col("input_hash").cast("long").alias("vec_id"), "fault", F.when(F.col("fault").isNull(), F.size("values")).cast("long").alias("width"), F.get("values", F.lit(0)).cast("double").alias("first"), F.get("values", F.lit(WIDTH - 1)).cast("double").alias("last"))


# Suppliers as funds, orders of a day as submissions, order lines as holdings, parts as names


def report(x, d):
    """(funds, submissions, holdings, names) as tables of text, read back."""
    path = shared_path(x, "nport")
    su, li, p = s.table(x, d, "supplier"), s.table(x, d, "lineitem"), s.table(x, d, "part")
    k = F.col("s_suppkey")
    names = F.array(*(F.lit(f"the {part.lower()} etf") for part, _ in nport.SECTORS))
    fund = F.when(k % 5 == 4, "Some Other Fund").when(k % 7 == 6, F.concat(F.get(names, (k % 11).cast("int")), F.lit(" Premium Income"))).otherwise(F.get(names, (k % 11).cast("int")))
    su.select(F.concat_ws("\t", F.concat(F.lit("A"), k), fund, F.lit("x")).alias("value")).write.text(f"{path}/funds")
    written = lambda day: F.upper(F.date_format(day, "dd-MMM-yyyy"))
    on = F.date_add(F.lit("1996-01-31").cast("date"), (k % 300).cast("int"))
    su.select(F.concat_ws("\t", F.concat(F.lit("A"), k), F.when(k % 13 == 1, "").otherwise(written(F.date_add(on, 30))), F.lit(""), F.lit(""), F.lit(""), written(on), F.lit("")).alias("value")).write.text(f"{path}/submissions")
    blank = [F.lit("")] * 9
    joined = li.where("l_linenumber <= 2").join(p.select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    weight = F.when(F.col("l_quantity") > 48, "").otherwise(F.col("l_quantity").cast("long").cast("string"))
    joined.select(F.concat_ws("\t", F.concat(F.lit("A"), F.col("l_suppkey")), F.lit("h"), F.upper("p_name"), *blank, weight).alias("value")).write.text(f"{path}/holdings")
    known = p.where("p_partkey % 3 <> 0").select(F.concat(F.lit(" "), F.col("p_name"), F.lit(".")).alias("issuer"), F.col("p_partkey").cast("string").alias("symbol"))
    read = nport.read_tsv
    return read(x, f"{path}/funds", nport.FUND), read(x, f"{path}/submissions", nport.SUBMISSION), read(x, f"{path}/holdings", nport.HOLDING), known


def reported(x, d, ledger=False):
    return nport.sector_holdings(*report(x, d), "1996q1")[1 if ledger else 0]


REPORT = f""", funds AS (SELECT 'A' || s_suppkey AS accession, [{", ".join(f"'{sector}'" for _, sector in nport.SECTORS)}][s_suppkey % 11 + 1] AS sector, DATE '1996-01-31' + CAST(s_suppkey % 300 AS INTEGER) AS effective_from FROM supplier WHERE s_suppkey % 5 <> 4 AND s_suppkey % 7 <> 6 AND s_suppkey % 13 <> 1),
    chosen AS (SELECT *, effective_from + 30 AS available_from FROM funds), names AS (SELECT regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS k, max(CAST(p_partkey AS VARCHAR)) AS symbol FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
    held AS (SELECT c.*, n.symbol, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS weight FROM lineitem JOIN part ON p_partkey = l_partkey JOIN chosen c ON c.accession = 'A' || l_suppkey LEFT JOIN names n ON n.k = regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') WHERE l_linenumber <= 2 AND l_quantity <= 48)"""


# A database that Spark brings along


def supplied(x, d):
    """Suppliers put into a database and then changed: a batch that comes twice counts once.

    Their key says whether a number is the second batch's own, as its shifted numbers may be those of other suppliers.
    """
    url, types, key = f"jdbc:derby:{database.host_path(shared_path(x, 'suppliers'))};create=true", {"s_suppkey": "BIGINT NOT NULL", "moved": "BIGINT NOT NULL", "s_name": "VARCHAR(100)", "s_acctbal": "DOUBLE"}, ["s_suppkey", "moved"]
    database.create(x, url, "suppliers", types, [key])
    base = s.table(x, d, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.lit(0).cast("long").alias("moved"), "s_name", "s_acctbal")
    database.insert_new(base, url, "suppliers", types, [key], ["s_acctbal"], "first")
    again = base.withColumn("s_acctbal", F.lit(-1.0))
    moved = again.withColumns({"s_suppkey": F.col("s_suppkey") + 5000, "moved": F.lit(1).cast("long")})
    database.insert_new(again.unionByName(moved), url, "suppliers", types, [key], ["s_name"], "second")
    changed = base.where("s_suppkey % 3 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1)
    for _ in range(2):
        database.upsert(changed, url, "suppliers", types, key, [F.desc("s_acctbal")], "third")
    return database.read_table(x, url, "suppliers", "s_suppkey").drop("moved")


SUPPLIED = "SELECT s_suppkey, s_name, s_acctbal + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 5000, s_name, -1 FROM supplier"


# Pages as filings that link to exhibits, which are other pages


def filed(x, d):
    """Pages as filings, every fourth of another form; each names its exhibit twice, another one, a picture and a place in itself."""
    p = s.table(x, d, "pages")
    i = F.col("page_id")
    more = F.concat(F.lit("<A HREF = 'Exhibit99-"), i, F.lit(""".htm'>one</a><a href="a/b/doc99."""), i % 10, F.lit("""-x.htm">two</a><a href='Exhibit99-"""), i, F.lit(""".htm'>one</a><a href="#ex-99">here</a><a href="/pictures/99.png">no</a>"""))
    day = F.date_add(F.lit("1996-01-01").cast("date"), (i % 300).cast("int"))
    return p.select(
        F.concat(F.lit("sec:"), i).alias("article_id"), day.alias("published_at"), day.alias("trading_date"), (i % 11).cast("string").alias("sector"), F.concat(F.lit("S"), i % 50).alias("symbol"),
        F.when(i % 4 == 3, "10-Q").when(i % 4 == 2, "8-K/A").otherwise("8-K").alias("form"), "url", F.concat("html", more).alias("html"),
    )


def linked(x, d):
    return exhibits.exhibit_links(filed(x, d)).select("article_id", "trading_date", "sector", "symbol", "exhibit_url", "exhibit_name")


def exhibited(x, d):
    """Of the pages named first, every third is missing and every seventh shows nothing; the others are pages of the table."""
    p = s.table(x, d, "pages")
    folder = F.regexp_replace("url", r"[^/]*$", "")
    pages = p.where("page_id % 3 <> 0").select(F.concat(folder, F.lit("Exhibit99-"), F.col("page_id"), F.lit(".htm")).alias("url"), F.when(F.col("page_id") % 7 == 0, "<p> -- </p>").otherwise(F.col("html")).alias("html"))
    return exhibits.exhibit_articles(exhibits.exhibit_links(filed(x, d)), pages)


LINKS = r"""SELECT article_id, trading_date, sector, symbol, regexp_replace(url, '[^/]*$', '') || href AS exhibit_url, regexp_extract(href, '([^/]*)$', 1) AS exhibit_name
    FROM (SELECT 'sec:' || page_id AS article_id, DATE '1996-01-01' + CAST(page_id % 300 AS INTEGER) AS trading_date, CAST(page_id % 11 AS VARCHAR) AS sector, 'S' || (page_id % 50) AS symbol, url, unnest(['Exhibit99-' || page_id || '.htm', 'a/b/doc99.' || (page_id % 10) || '-x.htm']) AS href FROM pages WHERE page_id % 4 <> 3)"""
OUTCOMES = """SELECT outcome, count(*) AS n, count(DISTINCT page_id) AS filings FROM (
        SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'missing' WHEN page_id % 7 = 0 THEN 'empty' ELSE 'written' END AS outcome FROM pages WHERE page_id % 4 <> 3
        UNION ALL SELECT page_id, 'missing' FROM pages WHERE page_id % 4 <> 3
    ) GROUP BY 1"""

STAMPED = "'S' || (page_id % 50) AS symbol, CAST(page_id % 11 AS VARCHAR) AS sector, DATE '1996-01-01' + CAST(page_id % 300 AS INTEGER) AS published_at, DATE '1996-01-01' + CAST(page_id % 300 AS INTEGER) AS trading_date"
WRITTEN = rf"""SELECT 'sec-exhibit:' || sha256(url) AS article_id, * EXCLUDE (t), 'SEC' AS publisher, sha256(t) AS content_hash
    FROM (SELECT 'sec:' || page_id AS filing_id, {STAMPED}, 'Exhibit99-' || page_id || '.htm' AS title, regexp_replace(url, '[^/]*$', '') || 'Exhibit99-' || page_id || '.htm' AS url, {qn.visible_sql('html')} AS t
    FROM pages WHERE page_id % 4 <> 3 AND page_id % 3 <> 0 AND page_id % 7 <> 0)"""
FILED = f"""SELECT * EXCLUDE (t), sha256(t) AS content_hash FROM (SELECT * EXCLUDE (v), {qn.sections_sql('v')} AS t FROM (SELECT 'sec:' || page_id AS article_id, {STAMPED}, CASE WHEN page_id % 4 = 2 THEN '8-K/A' ELSE '8-K' END AS form, url,
    {qn.visible_sql("html || '<a>one</a><a>two</a><a>one</a><a>here</a><a>no</a>'")} AS v FROM pages WHERE page_id % 4 <> 3)) WHERE t <> ''"""


def fill(add) -> None:
    q = s.sql
    add("S4", read_trades, q("trades", WIRE), "price volume")
    add("S4_bars", read_bars, q("daily", f"SELECT symbol, date, CASE WHEN v2 THEN 'unsupported schema version' END AS reject_reason, CASE WHEN NOT v2 THEN epoch_ms(CAST(date AS TIMESTAMP)) END AS start_ms, CASE WHEN NOT v2 THEN close END AS close, CASE WHEN NOT v2 THEN CAST(volume AS BIGINT) END AS trades, CASE WHEN NOT v2 THEN true END AS finalized FROM (SELECT *, date_diff('day', DATE '1970-01-01', date) % 5 = 0 AS v2 FROM daily)"), "close", "date")
    add("D11_cache", cached, "SELECT doc_id, sha256(lower(text)) AS content_hash, (length(text) % 97) / 100 - (length(text) % 61) / 200 AS score FROM documents WHERE text IS NOT NULL", "score")
    add("B14", letters, q("trades", f"SELECT coalesce({FAULTS}, 'kept') AS reason, count(*) AS n FROM trades GROUP BY 1"))
    add("K8", sent, q("trades", f"""SELECT symbol AS key, '{{"event_id":"' || event_id || '","symbol":"' || symbol || '","ts_ms":' || ts_ms || '}}' AS value, CAST(event_id AS VARCHAR) AS id FROM trades WHERE {FAULTS} IS NULL"""))
    add("B15", silent, q("trades", SILENT), "close")
    add("S16", packed, f"SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN 'out of range' END AS fault, CASE WHEN vec_id % 17 <> 0 THEN CAST({WIDTH} AS BIGINT) END AS width, CASE WHEN vec_id % 17 <> 0 THEN CAST(embedding[1] AS DOUBLE) END AS first, CASE WHEN vec_id % 17 <> 0 THEN CAST(embedding[{WIDTH}] AS DOUBLE) END AS last FROM embeddings WHERE len(embedding) = {WIDTH}", "first last")
    add("S17", reported, f"WITH {REPORT[2:]} SELECT sector, symbol, effective_from, available_from, DATE '2099-12-31' AS effective_to, min(weight) AS weight, 'SEC-NPORT-1996q1' AS source FROM held WHERE symbol IS NOT NULL GROUP BY ALL", "", "effective_from available_from effective_to")
    add("S17_ledger", lambda x, d: reported(x, d, True), f"WITH {REPORT[2:]} SELECT sector, '1996q1' AS quarter, effective_from, available_from, accession, coalesce(total, 0) AS total, coalesce(unresolved, 0) AS unresolved FROM chosen LEFT JOIN (SELECT accession, count(*) AS total, count(*) FILTER (WHERE symbol IS NULL) AS unresolved FROM held GROUP BY 1) USING (accession)", "", "effective_from available_from")
    add("S18", supplied, SUPPLIED, "s_acctbal")
    add("D10", linked, LINKS, "", "trading_date")
    add("D10_outcomes", lambda x, d: exhibits.outcomes(exhibited(x, d)), OUTCOMES)
    add("D10_articles", lambda x, d: exhibited(x, d).where("outcome = 'written'").drop("outcome", "text"), WRITTEN, "", "published_at trading_date")
    add("D10_filings", lambda x, d: exhibits.filing_articles(filed(x, d)).drop("text"), FILED, "", "published_at trading_date")
