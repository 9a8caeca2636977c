"""Identifiers, validity rules, exports, published tables, gates and running aggregates over the given tables, with twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators import news, recent
from tidewright.plans import api, sector_panel
from tidewright.plans import queries_news as qn
from tidewright.plans import stand_ins as s
from tidewright.session import shared_path
from tidewright.sources import readers, writers
from tidewright.streaming import live


# candles of which some closes are missing, negative, zero or infinite
def candles(x, d):
    k, c = F.dayofmonth("date"), F.col("close")
    close = F.when(k == 3, -c).when(k == 5, 0.0).when(k == 7, F.lit(None)).when(k == 11, F.lit(float("nan"))).when(k == 13, F.lit(float("inf"))).otherwise(c)
    return s.daily(x, d).withColumn("close", close)


# Whole texts through CSV, with nulls, empty ones, quotes, line breaks and carriage returns
def texts(x, d):
    i = F.col("doc_id")
    odd = F.when(i % 10 == 0, F.lit(None)).when(i % 10 == 1, "").when(i % 10 == 2, F.concat(F.lit("\r\n"), "text", F.lit('\r"a,b"\r\n'))).when(i % 10 == 3, '"').when(i % 10 == 4, " , ").otherwise(F.col("text"))
    return s.table(x, d, "documents").select("doc_id", odd.alias("text"), F.lit("end").alias("last"))


def through_csv(x, d):
    path = shared_path(x, "csv")
    writers.write_csv(texts(x, d), path)
    return readers.read_csv(x, path, "doc_id long, text string, last string").select("doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("hash"), "last")


# K6: a panel written with 12, 15 and 17 significant digits, read back as texts
def panel_texts(x, d):
    rows = s.daily(x, d).select("symbol", "date", (F.col("close") / 3).alias("price"), (F.col("volume") / 1e9 / 7).alias("share"))
    out = None
    for digits in (12, 15, 17):
        path = shared_path(x, f"panel{digits}")
        writers.write_csv(rows, path, digits)
        found = readers.read_csv(x, path, "symbol string, date string, price string, share string").withColumn("digits", F.lit(digits))
        out = found if out is None else out.unionByName(found)
    return out


# K9: a research table published twice: what comes again is replaced, what is old goes
def research(x, d):
    f = s.filings(x, d).select("filing", F.col("accepted").alias("date"), F.col("form").alias("body"), "sentiment")
    first = writers.published(None, f, ["filing"], "run-1", 2000, "2001-01-01")
    changed = f.where("filing % 3 = 0").withColumn("sentiment", F.col("sentiment") + 1)
    return writers.published(first, changed, ["filing"], "run-2", 365, "2001-06-01")


# Hashes of files for a manifest
def hashed_files(x, d):
    path = shared_path(x, "files")
    line = F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey")
    s.table(x, d, "nation").orderBy("n_nationkey").select(line.alias("value")).coalesce(1).write.text(path)
    return writers.file_hashes(x, path).select("bytes", "sha256")


# Feature events of which some don't fit the model
NAMES = ["open", "high", "low", "close", "volume"]


def events(x, d):
    k = F.dayofmonth("date")
    values = F.array(*(F.col(n) for n in NAMES))
    names = F.when(k == 4, F.array(*map(F.lit, NAMES[::-1]))).otherwise(F.array(*map(F.lit, NAMES)))
    odd = F.when(k == 6, F.slice(values, 1, 4)).when(k == 8, F.concat(F.slice(values, 1, 4), F.array(F.lit(float("nan"))))).otherwise(values)
    version, hashed = F.when(k == 2, "v2").otherwise("v1"), F.when(k == 3, "other").otherwise(str(clean.schema_hash(NAMES)))
    return s.daily(x, d).select(F.col("symbol").alias("target_symbol"), "date", version.alias("feature_version"), hashed.alias("schema_hash"), names.alias("names"), odd.alias("values"))


def gated(x, d):
    """What a model of one symbol may score; its score here is a fixed sum, clamped."""
    found = api.gated(events(x, d), "1-URGENT", "v1", str(clean.schema_hash(NAMES)), NAMES)
    p = F.get("values", F.lit(3)) / F.get("values", F.lit(1)) * 1.5 - 0.25
    ok = F.col("reject_reason").isNull()
    q = F.when(ok, F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))
    return found.select("target_symbol", "date", "reject_reason", q.alias("probability"), F.when(q >= 0.5, "Bullish").when(q < 0.5, "Bearish").alias("signal"))


GATE = """SELECT symbol AS target_symbol, date, reason AS reject_reason, CASE WHEN reason IS NULL THEN q END AS probability, CASE WHEN reason IS NULL THEN CASE WHEN q >= 0.5 THEN 'Bullish' ELSE 'Bearish' END END AS signal
    FROM (SELECT symbol, date, least(greatest(close / high * 1.5 - 0.25, 0), 1) AS q, CASE WHEN symbol <> '1-URGENT' OR k IN (2, 3) THEN 'schema' WHEN k = 4 THEN 'order' WHEN k = 6 THEN 'count' WHEN k = 8 THEN 'finite' END AS reason FROM (SELECT *, dayofmonth(date) AS k FROM daily))"""


# The aggregate of a sector's day as each article arrives, and the same kept by a stream
def running_day(x, d):
    w = Window.partitionBy("sector", "day").orderBy("published_ms", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return s.articles(x, d).select("doc_id", "sector", "day", F.count("*").over(w).alias("n"), F.avg("score").over(w).alias("mean_score"), F.max("published_ms").over(w).alias("last_ms"))


def streamed_day(x, d):
    """Two deliveries of every article, in the order of their days; what the stream says last of each sector and day."""
    path = shared_path(x, "news")
    a = s.articles(x, d).select(F.col("doc_id").cast("string").alias("article_id"), "sector", "score", F.timestamp_millis("published_ms").alias("ts"))
    a.unionByName(a).coalesce(1).write.parquet(f"{path}/in")
    stream = x.readStream.schema(a.schema).parquet(f"{path}/in")
    write = lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/out/{number}")
    live.into(live.running_news(stream), f"{path}/checkpoint", write, "update").awaitTermination()
    found = x.read.option("recursiveFileLookup", "true").parquet(f"{path}/out")
    last = found.groupBy("sector", "day").agg(F.max_by(F.struct("n", "mean_score"), "batch").alias("l"))
    return last.select("sector", "day", "l.n", "l.mean_score")


# Embeddings of sectors by session, 0 where there are none; sessions and sectors are those of the table
MEANS = [f"mean_{i}" for i in range(8)]


def embedding_panel(x, d):
    e = qn.embedded(x, d).withColumn("sector", F.col("sector").cast("long"))
    grid = e.select("session").distinct().join(F.broadcast(e.select("sector").distinct()), F.lit(True))  # sectors are labels: few
    return news.zero_filled(grid, news.embedding_means(e, ["session", "sector"], 8).select("session", "sector", "symbols", "contents", *MEANS), ["session", "sector"])


def embedding_sql() -> str:
    dims = ", ".join(f"avg(embedding[{i + 1}]::DOUBLE) AS mean_{i}" for i in range(8))
    zero = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("symbols", "contents", *MEANS))
    return f"""WITH {qn.EMBEDDED}, o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY session, sector, content_hash ORDER BY seq) = 1),
        g AS (SELECT session, sector FROM (SELECT DISTINCT session FROM e), (SELECT DISTINCT sector FROM e)), f AS (SELECT session, sector, count(*) AS contents, {dims} FROM o GROUP BY 1, 2), y AS (SELECT session, sector, count(DISTINCT symbol) AS symbols FROM e GROUP BY 1, 2)
        SELECT g.session, CAST(g.sector AS BIGINT) AS sector, {zero}, CASE WHEN symbols IS NULL THEN 'empty' ELSE 'ok' END AS coverage_status FROM g LEFT JOIN y USING (session, sector) LEFT JOIN f USING (session, sector)"""


def event_values(x, d):
    """Every value of every live event, by name."""
    e = sector_panel.live_events(s.sector_bars(x, d), "v1")
    return e.select("target_symbol", "event_time", F.explode(F.arrays_zip("names", "values")).alias("v")).select("target_symbol", "event_time", F.col("v.names").alias("name"), F.col("v.values").alias("value"))


def fill(add) -> None:
    q = s.sql
    number = lambda c: f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"
    add("F2", lambda x, d: s.trades(x, d).select("event_id", clean.trade_id(F.lit("file")).alias("id")), q("trades", f"SELECT event_id, 'file:sha256:' || sha256(concat_ws('|', 'file', symbol, ts_ms, {number('price')}, {number('volume')}, seq)) AS id FROM trades"))
    add("F29", lambda x, d: candles(x, d).where(~clean.infinite(F.col("close")) & (F.col("close") > 0)).select("symbol", "date", "close"), q("daily", "SELECT symbol, date, close FROM daily WHERE dayofmonth(date) NOT IN (3, 5, 7, 11, 13) AND close > 0"), "close", "date")
    odd = "CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN chr(13) || chr(10) || text || chr(13) || '\"a,b\"' || chr(13) || chr(10) WHEN 3 THEN '\"' WHEN 4 THEN ' , ' ELSE text END"
    add("S5", through_csv, f"SELECT doc_id, length(t) AS n, sha256(t) AS hash, 'end' AS last FROM (SELECT doc_id, replace({odd}, chr(13), '') AS t FROM documents)")
    digits = " UNION ALL ".join(f"SELECT symbol, CAST(date AS VARCHAR) AS date, printf('%.{n}g', close / 3) AS price, printf('%.{n}g', volume / 1e9 / 7) AS share, {n}::BIGINT AS digits FROM daily" for n in (12, 15, 17))
    add("K6", panel_texts, q("daily", digits))
    add("K9", research, q("filings", "SELECT filing, accepted AS date, sentiment + CASE WHEN filing % 3 = 0 THEN 1 ELSE 0 END AS sentiment, CASE WHEN filing % 3 = 0 THEN 'run-2' ELSE 'run-1' END AS run FROM filings WHERE accepted >= DATE '2001-06-01' - 365"), "sentiment", "date")
    add("K13", hashed_files, "SELECT CAST(strlen(t) AS BIGINT) AS bytes, sha256(t) AS sha256 FROM (SELECT string_agg(n_nationkey || '|' || n_name || '|' || n_regionkey || chr(10), '' ORDER BY n_nationkey) AS t FROM nation)")
    add("M24", gated, q("daily", GATE), "probability", "date")
    add("B12", running_day, q("articles", "SELECT doc_id, sector, day, count(*) OVER w AS n, avg(score) OVER w AS mean_score, max(published_ms) OVER w AS last_ms FROM articles WINDOW w AS (PARTITION BY sector, day ORDER BY published_ms, doc_id ROWS UNBOUNDED PRECEDING)"), "mean_score", "day")
    add("B12_stream", streamed_day, q("articles", "SELECT sector, CAST(make_timestamp(published_ms * 1000) AS DATE) AS day, count(*) AS n, avg(score) AS mean_score FROM articles GROUP BY 1, 2"), "mean_score", "day")
    add("B9_recent", lambda x, d: recent.recent_unique(s.repeated_trades(x, d).select(F.col("event_id").alias("id"), "symbol", "seq", "ts_ms"), "id", "seq"))
    add("D5_embedding", embedding_panel, embedding_sql(), " ".join(MEANS))
    values = ", ".join(sector_panel.LIVE)
    from tidewright.plans import queries_panels as qp

    ready = " AND ".join(f"isfinite({c})" for c in sector_panel.LIVE)
    add("D15_values", event_values, s.sql("sector_bars", f"{qp.UNIVERSE}{qp.rolled(True)}{qp.crossed()} SELECT symbol AS target_symbol, date AS event_time, name, value FROM (UNPIVOT (SELECT symbol, date, {values} FROM x WHERE {ready}) ON {values} INTO NAME name VALUE value)"), "value", "event_time")
