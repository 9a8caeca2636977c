"""Readers, writers, guards and exports over the given tables in the formats they read, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators import bars
from tidewright.plans import api, sector_panel
from tidewright.plans import stand_ins as s
from tidewright.session import shared_path
from tidewright.sources import readers, writers


def frames(x, d):
    """Trades as frames of the trade socket, one to a line: every tenth is a ping and every thirteenth is cut off."""
    t = s.trades(x, d)
    kind = F.when(F.col("event_id") % 10 == 0, "ping").otherwise("trade")
    body = F.to_json(F.struct(kind.alias("type"), F.array(F.struct(F.col("symbol").alias("s"), F.col("price").alias("p"), F.col("volume").alias("v"), F.col("ts_ms").alias("t"))).alias("data")))
    return t.select(F.when(F.col("event_id") % 13 == 0, F.lit('{"type": "tra')).otherwise(body).alias("value"))


def submitted(x, d):
    """Orders as each customer's filings in parallel arrays, of which the forms are one short."""
    f = s.filings(x, d).groupBy("issuer").agg(F.sort_array(F.collect_list(F.struct("filing", "form", F.col("accepted").cast("string").alias("accepted")))).alias("a"))
    of = lambda c: F.transform("a", lambda v: v[c].cast("string"))
    recent = F.struct(of("filing").alias("accessionNumber"), F.expr("transform(slice(a, 1, size(a) - 1), v -> v.form)").alias("form"), of("accepted").alias("acceptanceDateTime"), of("accepted").alias("filingDate"), of("filing").alias("primaryDocument"))
    return f.select(F.to_json(F.struct(F.col("issuer").cast("string").alias("cik"), F.array(F.concat(F.lit("T"), F.col("issuer").cast("string"))).alias("tickers"), F.struct(recent.alias("recent")).alias("filings"))).alias("value"))


def facts(x, d):
    """Suppliers' order lines as company facts: a tag for each return flag, a unit for each line status."""
    li = s.table(x, d, "lineitem")
    value = F.struct(F.col("l_orderkey").cast("string").alias("accn"), F.col("l_extendedprice").alias("val"), F.to_date("l_shipdate").cast("string").alias("end"))
    units = li.groupBy("l_suppkey", "l_returnflag", "l_linestatus").agg(F.collect_list(value).alias("v"))
    tags = units.groupBy("l_suppkey", "l_returnflag").agg(F.map_from_entries(F.collect_list(F.struct("l_linestatus", "v"))).alias("units"))
    found = tags.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.struct("units")))).alias("t"))
    return found.select(F.to_json(F.struct(F.col("l_suppkey").alias("cik"), F.create_map(F.lit("us-gaap"), "t").alias("facts"))).alias("value"))


def told(x, d):
    """Turns of conversations as stories: a third each in `data`, in `payload`, and without an envelope."""
    story = F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("turn").cast("int").alias("takeSequence"), F.col("text").alias("headline"), F.array(F.col("role")).alias("subjects"))
    k = F.col("turn") % 3
    return s.table(x, d, "conversations").select(F.when(k == 0, F.to_json(F.struct(story.alias("data")))).when(k == 1, F.to_json(F.struct(story.alias("payload")))).otherwise(F.to_json(story)).alias("value"))


def through_array(x, d):
    """Nations, of which every fifth has no number, as a file with one JSON array, read back."""
    path = shared_path(x, "json")
    key = F.when(F.col("n_nationkey") % 5 == 0, "NaN").otherwise(F.col("n_nationkey").cast("string"))
    line = F.concat(F.lit('{"key": '), key, F.lit(', "name": "NaN '), F.col("n_name"), F.lit('"}'))
    s.table(x, d, "nation").agg(F.concat(F.lit("["), F.array_join(F.collect_list(line), ", "), F.lit("]")).alias("value")).write.text(path)
    return readers.json_array_files(x, f"{path}/part-*", "key double, name string")


def described(x, d):
    """Parts as models' metadata, with fields left out of some."""
    k = F.col("p_partkey")
    m = F.struct(
        F.when(k % 7 != 0, F.col("p_name")).alias("model_id"), F.col("p_brand").alias("target_symbol"), F.when(k % 2 == 0, "v002").alias("model_version"), F.col("p_size").alias("prediction_horizon"),
        F.lit("f1").alias("feature_version"), F.when(k % 5 != 0, F.array(F.lit("return_1"), F.lit("return_3"))).alias("features"),
    )
    return s.table(x, d, "part").select("p_partkey", F.to_json(m).alias("value"))


def sent(x, d):
    """Events as live messages: updates (some without a field), states, heartbeats, others and broken ones."""
    e, k = s.trades(x, d), F.col("event_id")
    text = lambda *names: [F.lit("x").alias(n) for n in names]
    p = F.col("price")
    trade = F.struct(*text("event_id", "symbol"), p.alias("price"), F.when(k % 11 != 0, F.lit(1.0)).alias("volume"), *text("timestamp", "source"))
    bar = F.struct(*text("bar_id", "symbol", "interval", "bar_start", "bar_end"), *(p.alias(n) for n in ("open", "high", "low", "close", "volume", "trade_count")), *text("first_trade_timestamp", "last_trade_timestamp"))
    kind = F.element_at(F.array(*map(F.lit, ("market_update", "stream_status", "heartbeat", "other"))), (k % 4 + 1).cast("int"))
    m = F.to_json(F.struct(kind.alias("type"), F.when(k % 3 != 0, "open").alias("status"), F.when(k % 7 != 0, k).alias("sequence"), trade.alias("trade"), bar.alias("one_minute"), bar.alias("five_minute")))
    return e.select("event_id", F.when(k % 17 == 0, "{").otherwise(m).alias("value"))


def asked(x, d):
    """Events as requests for bars."""
    k = F.col("event_id")
    return s.trades(x, d).select("event_id", F.when(k % 3 == 0, "1m").when(k % 3 == 1, "5m").otherwise("1h").alias("interval"), ((k % 50) * 50).alias("limit"), F.when(k % 5 == 0, F.lit("2024-1-01")).when(k % 5 == 1, F.lit("2024-01-01")).alias("date"))


def stored(x, d):
    """Daily sentiment of parts by version: stored rows, and arriving ones of which some are newer."""
    p = s.table(x, d, "part")
    return p.select(F.col("p_partkey").alias("symbol"), F.lit("v1").alias("version"), (F.col("p_size") / 50).alias("score"))


def arriving(x, d):
    p = s.table(x, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("symbol"), F.explode(F.array(F.lit("v1"), F.lit("v2"))).alias("version"), (F.col("p_size") / 50 + 1).alias("score"))
    return p.unionByName(p.withColumn("score", F.col("score") + 1))


def counts(x, d):
    """Named counters of the frames that are taken and refused, by reason."""
    return readers.trade_frames(frames(x, d)).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("counter")).agg(F.count("*").alias("value"))


def inserted(x, d):
    """Suppliers written by two inserts of overlapping keys: first write wins."""
    path = shared_path(x, "insert")
    p = s.table(x, d, "supplier").select("s_suppkey", "s_acctbal")
    writers.insert_new(p.where("s_suppkey % 2 = 0"), path, ["s_suppkey"], ["s_acctbal"])
    writers.insert_new(p.withColumn("s_acctbal", F.col("s_acctbal") + 1), path, ["s_suppkey"], ["s_acctbal"])
    return x.read.parquet(path)


def upserted(x, d):
    """The same by two upserts: last write wins."""
    path = shared_path(x, "upsert")
    p = s.table(x, d, "supplier").select("s_suppkey", "s_acctbal")
    writers.upsert(p, path, ["s_suppkey"], ["s_acctbal"])
    writers.upsert(p.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), path, ["s_suppkey"], ["s_acctbal"])
    return writers.read_upserted(x, path)


def resolved(x, d):
    """Parts as holdings of issuers, resolved by a ticker table that has some of their names, otherwise spelt."""
    p = s.table(x, d, "part")
    tickers = p.where("p_partkey % 3 <> 0").select(F.regexp_replace(F.lower("p_name"), " ", "-").alias("issuer"), F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("symbol"))
    found = readers.resolve_issuers(p.select("p_partkey", F.col("p_name").alias("issuer")), tickers)
    return found.select("p_partkey", "symbol", F.col("symbol").isNotNull().alias("resolved"))


def shipped(x, d):
    """Lines with the customer of their order, by ship date: some ship after the last snapshot."""
    return s.table(x, d, "lineitem").join(s.table(x, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("symbol")), "l_orderkey").select("l_orderkey", "l_linenumber", "symbol", F.to_date("l_shipdate").alias("date"))


def scored(x, d):
    return s.predictions(x, d).where("part = 'test'").select("doc_id", F.col("fold").alias("date"), "label", "p", (F.col("p") * 0.5 + 0.25).alias("calibrated"))


def schemas(x, d):
    """Parts as schemas: the first names of the live one (all of them for some), and the words of the part's own."""
    live = F.slice(F.array(*map(F.lit, sector_panel.LIVE)), F.lit(1), (F.col("p_partkey") % 44).cast("int"))
    return s.table(x, d, "part").select("p_partkey", F.concat(live, F.split("p_name", " ")).alias("names"))


HASHED = f"""SELECT p_partkey, lower(lpad(printf('%x', CAST(list_reduce(list_concat([{clean.LIVE_START}::UHUGEINT], list_transform(range(1, 1 + length(t)), lambda i: ascii(t[i])::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616) AS UBIGINT)), 16, '0')) AS schema_hash
    FROM (SELECT p_partkey, array_to_string(list_transform({{names}}, lambda n: n || '|'), '') AS t FROM part)"""


def fill(add) -> None:
    q = s.sql
    add("S2", lambda x, d: readers.trade_frames(frames(x, d)).groupBy("reject_reason", "symbol").agg(F.count("*").alias("n"), F.sum("ts_ms").alias("ts"), F.max("price").alias("most")), q("trades", "SELECT reason AS reject_reason, CASE WHEN reason IS NULL THEN symbol END AS symbol, count(*) AS n, CAST(sum(CASE WHEN reason IS NULL THEN ts_ms END) AS BIGINT) AS ts, max(CASE WHEN reason IS NULL THEN price END) AS most FROM (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'malformed' WHEN event_id % 10 = 0 THEN 'control frame' END AS reason FROM trades) GROUP BY 1, 2"), "most")
    add("S6", lambda x, d: readers.plain_list(s.table(x, d, "supplier").select(F.concat(F.lit(" "), "s_name", F.lit(" ,"), F.col("s_nationkey").cast("string"), F.lit(" , \"q\"")).alias("value")), ["name", "nation", "quoted", "missing"]), "SELECT s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation, '\"q\"' AS quoted, CAST(NULL AS VARCHAR) AS missing FROM supplier")
    add("S9", through_array, "SELECT CASE WHEN n_nationkey % 5 <> 0 THEN CAST(n_nationkey AS DOUBLE) END AS key, 'NaN ' || n_name AS name FROM nation", "key")
    add("S10", lambda x, d: readers.submissions(submitted(x, d)), q("filings", "SELECT lpad(CAST(issuer AS VARCHAR), 10, '0') AS cik, 'T' || issuer AS symbol, i - 1 AS position, CAST(filing AS VARCHAR) AS accession, form, CAST(accepted AS VARCHAR) AS accepted_at, CAST(accepted AS VARCHAR) AS filed_on, CAST(filing AS VARCHAR) AS document FROM (SELECT *, row_number() OVER (PARTITION BY issuer ORDER BY filing) AS i, count(*) OVER (PARTITION BY issuer) AS n FROM filings) WHERE i < n"))
    add("S11", lambda x, d: readers.company_facts(facts(x, d)).select("cik", "tag", "unit", "accn", "val", "end"), "SELECT l_suppkey AS cik, l_returnflag AS tag, l_linestatus AS unit, CAST(l_orderkey AS VARCHAR) AS accn, l_extendedprice AS val, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS \"end\" FROM lineitem", "val")
    add("S12", lambda x, d: readers.stories(told(x, d)).select("id", F.col("takeSequence").alias("take"), F.sha2("headline", 256).alias("headline"), F.get("subjects", F.lit(0)).alias("subject")), "SELECT conv_id || '-' || turn AS id, CAST(turn AS BIGINT) AS take, sha256(text) AS headline, role AS subject FROM conversations")
    add("S20", lambda x, d: readers.model_metadata(described(x, d)).select("p_partkey", "model_id", "model_version", "prediction_horizon", "fault"), "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS model_id, CASE WHEN p_partkey % 2 = 0 THEN 'v002' ELSE 'v001' END AS model_version, CAST(p_size AS BIGINT) AS prediction_horizon, CASE WHEN p_partkey % 7 = 0 THEN 'incomplete' WHEN p_partkey % 5 = 0 THEN 'no features' END AS fault FROM part")
    live = ", ".join(f"'{n}'" for n in sector_panel.LIVE)
    add("F25", lambda x, d: schemas(x, d).select("p_partkey", clean.names_hash(F.col("names")).alias("schema_hash")), HASHED.format(names=f"list_concat([{live}][:p_partkey % 44], string_split(p_name, ' '))"))
    add("F31", lambda x, d: readers.messages(sent(x, d)).select("event_id", "kind"), "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 4 = 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0 AND value IS NOT NULL THEN 'update' WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN 'status' WHEN event_id % 4 = 2 AND event_id % 7 <> 0 THEN 'heartbeat' END AS kind FROM events")
    add("F34", lambda x, d: asked(x, d).select("event_id", api.request_fault(F.col("interval"), F.col("limit"), F.col("date")).alias("fault")), "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 'INVALID_INTERVAL' WHEN event_id % 50 * 50 NOT BETWEEN 1 AND 2000 THEN 'INVALID_LIMIT' WHEN event_id % 5 = 0 THEN 'INVALID_DATE' END AS fault FROM events")
    add("F35", lambda x, d: api.extrapolated(shipped(x, d), s.snapshots(x, d), "date", "symbol").groupBy("date", "extrapolated").agg(F.count("*").alias("n")), q("snapshots", "SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_shipdate AS DATE) > (SELECT max(snapshot) FROM snapshots) AND o_custkey IN (SELECT symbol FROM snapshots WHERE snapshot = (SELECT max(snapshot) FROM snapshots)) AS extrapolated, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"), "", "date")
    add("K5", lambda x, d: writers.merged(stored(x, d), arriving(x, d), ["symbol", "version"], [F.desc("score")]), "SELECT p_partkey AS symbol, 'v1' AS version, p_size / 50 AS score FROM part WHERE p_size <= 25 UNION ALL SELECT p_partkey, v, p_size / 50 + 2 FROM part, (SELECT unnest(['v1', 'v2']) AS v) WHERE p_size > 25", "score")
    add("K11", lambda x, d: api.chart_rows(bars.bars(s.trades(x, d))), q("trades", "SELECT strftime(make_timestamp(ts_ms // 60000 * 60000000), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, arg_min(price, ts_ms) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts_ms) AS close, sum(volume) AS volume FROM trades GROUP BY symbol, ts_ms // 60000"), "open high low close volume")
    add("K12", counts, "SELECT CASE WHEN event_id % 13 = 0 THEN 'malformed' WHEN event_id % 10 = 0 THEN 'control frame' ELSE 'accepted' END AS counter, count(*) AS value FROM events GROUP BY 1")
    plus = "SELECT s_suppkey, s_acctbal + CASE WHEN s_suppkey % 2 = {} THEN 1 ELSE 0 END AS s_acctbal FROM supplier"
    add("K1_written", inserted, plus.format(1), "s_acctbal")
    add("K2_written", upserted, plus.format(0), "s_acctbal")
    letters = "regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g')"
    add("S17_tickers", resolved, f"SELECT p_partkey, symbol, symbol IS NOT NULL AS resolved FROM (SELECT p_partkey, {letters} AS k FROM part) LEFT JOIN (SELECT {letters} AS k, min('T' || p_partkey) AS symbol FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1) USING (k)")
    add("K14", lambda x, d: api.prediction_rows(scored(x, d), "market"), q("predictions", "SELECT 'market' AS feature_subset, fold AS date, CAST(label AS BIGINT) AS label, p AS probability_positive_label, p * 0.5 + 0.25 AS calibrated_probability_positive_label FROM predictions WHERE part = 'test'"), "probability_positive_label calibrated_probability_positive_label")
    names = ["return_1", "volume"]
    add("Q6", lambda x, d: api.prediction(s.daily(x, d).withColumn("p", F.col("close") / F.col("high")), clean.schema_hash(names), names), q("daily", "SELECT symbol, date, least(greatest(close / high, 0), 1) AS probability, CASE WHEN close / high >= 0.5 THEN 'Bullish' ELSE 'Bearish' END AS signal FROM daily"), "probability", "date")
