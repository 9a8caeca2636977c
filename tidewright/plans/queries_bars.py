"""Bars, cleaning rules and served queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators import bars, dedup
from tidewright.plans import api
from tidewright.plans import stand_ins as s
from tidewright.session import keep_first
from tidewright.sources import readers

HOUR = 3_600_000


def bar_sql(source: str, width: int, last: str = "(ts_ms, -seq)") -> str:
    return f"""SELECT symbol, CAST(floor(ts_ms / {width}) AS BIGINT) * {width} AS bar_start_ms, arg_min(price, (ts_ms, seq)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, {last}) AS close, sum(volume) AS volume, count(*) AS trade_count, min(ts_ms) AS first_trade_ms, max(ts_ms) AS last_trade_ms, CAST(floor(ts_ms / {width}) AS BIGINT) * {width} + {width} AS bar_end_ms
        FROM {source} GROUP BY symbol, CAST(floor(ts_ms / {width}) AS BIGINT)"""


ROLL = """SELECT symbol, CAST(floor(bar_start_ms / 300000) AS BIGINT) * 300000 AS bar_start_ms, arg_min(open, bar_start_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_start_ms) AS close,
    sum(volume) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count, min(first_trade_ms) AS first_trade_ms, max(last_trade_ms) AS last_trade_ms, CAST(floor(bar_start_ms / 300000) AS BIGINT) * 300000 + 300000 AS bar_end_ms
    FROM m GROUP BY symbol, CAST(floor(bar_start_ms / 300000) AS BIGINT)"""
LATE = """marked AS (SELECT *, coalesce(max(ts_ms) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 5000 >= (CAST(floor(ts_ms / 60000) AS BIGINT) + 1) * 60000, false) AS late FROM trades)"""
OHLC = "open high low close volume"


def hourly(x, d):
    return bars.bars(s.trades(x, d), HOUR)


def shuffled(x, d):
    """Trades in another order of arrival, so that some are late."""
    return s.trades(x, d).withColumn("seq", F.col("event_id") * 7919 % 1_000_003)


SHUFFLED = "late AS (SELECT * REPLACE ((event_id * 7919) % 1000003 AS seq) FROM trades)"


def windows(x, d):
    """Each symbol's history in requests of 30 days from its first bar, with the bars that each brings."""
    rows = s.daily(x, d).select("symbol", "date")
    spans = rows.groupBy("symbol").agg(F.min("date").alias("start"), F.date_add(F.max("date"), 1).alias("end"))
    return readers.window_counts(rows, readers.planned_windows(spans), ["symbol"], "date", spans)


WINDOWS = """, spans AS (SELECT symbol, min(date) AS s, max(date) + 1 AS e FROM daily GROUP BY 1), counts AS (SELECT d.symbol, (d.date - s) // 30 AS nth, count(*) AS n FROM daily d JOIN spans USING (symbol) GROUP BY 1, 2),
    planned AS (SELECT symbol, s, e, unnest(range(CAST(ceil((e - s) / 30) AS BIGINT))) AS nth FROM spans)
    SELECT symbol, nth, s + CAST(30 * nth AS INTEGER) AS window_start, least(s + CAST(30 * nth + 30 AS INTEGER), e) AS window_end, coalesce(n, 0) AS n FROM planned LEFT JOIN counts USING (symbol, nth)"""
MADE_UP = f"SELECT {bars.IN_TURN}[seq % 18 + 1] AS symbol, 630 + (seq % 100) / 100 AS price, CAST(100 + seq % 900 AS DOUBLE) AS volume, ts_ms, seq FROM trades"


def fill(add) -> None:
    q = s.sql
    add("B1", lambda x, d: bars.bars(s.trades(x, d)), q("trades", bar_sql("trades", 60000)), OHLC)
    add("B1_hourly", hourly, q("trades", bar_sql("trades", HOUR)), OHLC)
    marks = "SELECT symbol, max(ts_ms) - 5000 AS watermark_ms FROM trades GROUP BY 1"
    add("B2", lambda x, d: s.trades(x, d).groupBy("symbol").agg((F.max("ts_ms") - bars.LATENESS_MS).alias("watermark_ms")), q("trades", marks))
    add("B3", lambda x, d: bars.finalised(hourly(x, d), s.trades(x, d)), q("trades", f"SELECT b.* FROM ({bar_sql('trades', HOUR)}) b JOIN ({marks}) m USING (symbol) WHERE bar_end_ms <= watermark_ms"), OHLC)
    add("B4", lambda x, d: bars.late_trades(shuffled(x, d)), q("trades", "SELECT 0").replace("SELECT 0", f""", {SHUFFLED}, {LATE.replace("FROM trades", "FROM late")}, f AS (SELECT symbol, CAST(floor(ts_ms / 60000) AS BIGINT) * 60000 AS b, min(seq) AS first FROM marked WHERE NOT late GROUP BY 1, 2)
        SELECT event_id, m.symbol, ts_ms, seq, CAST(floor(ts_ms / 60000) AS BIGINT) * 60000 AS bar_start_ms, CASE WHEN first < seq THEN 'bar already finalized' ELSE 'lateness exceeded configured threshold' END AS reason
        FROM marked m LEFT JOIN f ON f.symbol = m.symbol AND f.b = CAST(floor(ts_ms / 60000) AS BIGINT) * 60000 WHERE late"""))
    dup = "SELECT * EXCLUDE (gap) FROM (SELECT *, ts_ms - lag(ts_ms) OVER (PARTITION BY event_id ORDER BY seq) AS gap FROM repeated) WHERE gap IS NULL OR gap > 900000"
    add("B5", lambda x, d: bars.first_seen(s.repeated_trades(x, d)), q("repeated", dup), "price volume")
    add("B6", lambda x, d: bars.roll_up(bars.bars(s.trades(x, d))), q("trades", f", m AS ({bar_sql('trades', 60000)}) {ROLL}"), OHLC)
    live = lambda of, width: f"newest_{of} AS (SELECT *, CAST(floor(ts_ms / {width}) AS BIGINT) AS b, max(CAST(floor(ts_ms / {width}) AS BIGINT)) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM late), ok_{of} AS (SELECT * FROM newest_{of} WHERE n IS NULL OR b >= n)"
    both = " UNION ALL ".join(f"SELECT *, '{of}' AS interval FROM ({bar_sql(f'ok_{of}', width, '(ts_ms, seq)')})" for of, width in (("1m", 60000), ("5m", 300000)))
    add("B8", lambda x, d: bars.live_store(shuffled(x, d)), q("trades", f", {SHUFFLED}, {live('1m', 60000)}, {live('5m', 300000)} {both}"), OHLC)
    add("B9", lambda x, d: dedup.latest_n(hourly(x, d), ["symbol"], [F.desc("bar_start_ms")], 50), q("trades", f"SELECT * FROM ({bar_sql('trades', HOUR)}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_start_ms DESC) <= 50"), OHLC)
    add("B10", lambda x, d: bars.aligned(hourly(x, d), ["click", "login", "purchase", "search", "view"]), q("trades", f"""SELECT bar_end_ms, len(list_filter(req, lambda r: NOT list_contains(have, r))) = 0 AS complete, array_to_string(list_filter(req, lambda r: NOT list_contains(have, r)), ',') AS missing, CAST(len(have) AS BIGINT) AS n_symbols
        FROM (SELECT bar_end_ms, list(DISTINCT symbol) AS have, ['click', 'login', 'purchase', 'search', 'view'] AS req FROM ({bar_sql('trades', HOUR)}) WHERE symbol IN ('click', 'login', 'purchase', 'search', 'view') GROUP BY 1)"""))
    add("B11", lambda x, d: keep_first(bars.bars(s.repeated_trades(x, d)).unionByName(bars.bars(s.trades(x, d))), ["symbol", "bar_start_ms"], [F.desc("trade_count")]).select("symbol", "bar_start_ms", "trade_count"), q("repeated", f"SELECT symbol, bar_start_ms, max(trade_count) AS trade_count FROM ({bar_sql('repeated', 60000)} UNION ALL {bar_sql('trades', 60000)}) GROUP BY 1, 2"))
    # rules over trades
    t = lambda x, d: s.trades(x, d).withColumn("price", F.when(F.col("event_id") % 13 == 0, -F.col("price")).otherwise(F.col("price"))).withColumn("volume", F.when(F.col("event_id") % 17 == 0, F.lit(None)).otherwise(F.col("volume"))).withColumn("symbol", F.when(F.col("event_id") % 19 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("symbol"))))
    bad = "dirty AS (SELECT event_id, CASE WHEN event_id % 19 = 0 THEN '  ' ELSE ' ' || symbol END AS symbol, CASE WHEN event_id % 13 = 0 THEN -price ELSE price END AS price, CASE WHEN event_id % 17 = 0 THEN NULL ELSE volume END AS volume, ts_ms FROM trades)"
    fault = "CASE WHEN trim(symbol) = '' THEN 'empty symbol' WHEN price <= 0 THEN 'invalid price' WHEN volume IS NULL OR volume < 0 THEN 'invalid volume' WHEN ts_ms = 0 THEN 'missing timestamp' END"
    add("F1", lambda x, d: t(x, d).select("event_id", clean.normalised_symbol(F.col("symbol")).alias("symbol"), clean.trade_fault().alias("reject_reason")), q("trades", f", {bad} SELECT event_id, upper(trim(symbol)) AS symbol, {fault} AS reject_reason FROM dirty"))
    add("K7", lambda x, d: dedup.count_by_reason(t(x, d).withColumn("reject_reason", clean.trade_fault())), q("trades", f", {bad} SELECT coalesce({fault}, 'kept') AS reason, count(*) AS n FROM dirty GROUP BY 1"))
    add("F3", lambda x, d: s.trades(x, d).where(F.col("symbol").isin("click", "view")).select("event_id", "symbol"), q("trades", "SELECT event_id, symbol FROM trades WHERE symbol IN ('click', 'view')"))
    b = lambda x, d: hourly(x, d).withColumn("high", F.when(F.col("trade_count") % 3 == 0, F.col("low") - 1).otherwise(F.col("high")))
    add("F4", lambda x, d: bars.bar_faults(b(x, d)).select("symbol", "bar_start_ms", "reject_code"), q("trades", f"""SELECT symbol, bar_start_ms, CASE WHEN trim(symbol) = '' THEN 'EMPTY_SYMBOL' WHEN open <= 0 THEN 'INVALID_OPEN' WHEN high <= 0 THEN 'INVALID_HIGH' WHEN low <= 0 THEN 'INVALID_LOW'
        WHEN close <= 0 THEN 'INVALID_CLOSE' WHEN volume IS NULL OR volume < 0 THEN 'INVALID_VOLUME' WHEN high < greatest(open, close, low) OR low > least(open, close, high) THEN 'INVALID_RANGE' END AS reject_code
        FROM (SELECT * REPLACE (CASE WHEN trade_count % 3 = 0 THEN low - 1 ELSE high END AS high) FROM ({bar_sql('trades', HOUR)}))"""))
    add("F5", lambda x, d: s.daily(x, d).where("low > 0 and high >= greatest(open, close) and low <= least(open, close) and volume >= 0").select("symbol", "date", "close"), q("daily", "SELECT symbol, date, close FROM daily WHERE low > 0 AND high >= greatest(open, close) AND low <= least(open, close) AND volume >= 0"), "close", "date")
    add("F6", lambda x, d: s.table(x, d, "documents").select("doc_id", clean.content_hash(F.col("source"), F.col("lang"), joint="\n").alias("content_hash")), "SELECT doc_id, sha256(lower(trim(source) || chr(10) || trim(lang))) AS content_hash FROM documents")
    add("F7", lambda x, d: s.filings(x, d).select("filing", F.col("form").isin(clean.FILING_FORMS).alias("supported"), clean.form_class(F.col("form")).alias("kind")), q("filings", """SELECT filing, form IN ('8-K', '8-K/A', '10-K', '10-K/A', '10-Q', '10-Q/A', '6-K', '20-F', '40-F') AS supported, CASE WHEN form LIKE '8-K%' THEN '8-K' WHEN form LIKE '10-Q%' THEN '10-Q' WHEN form LIKE '10-K%' THEN '10-K'
        WHEN form = '4' THEN 'form4' WHEN form IN ('3', '5') THEN 'form3_5' WHEN form LIKE 'SC 13%' OR form LIKE 'SCHEDULE 13%' THEN 'schedule13' ELSE 'other' END AS kind FROM filings"""))
    add("F8", lambda x, d: s.table(x, d, "conversations").select("conv_id", "turn", clean.withdrawn(F.col("role"), F.col("text")).alias("withdrawn")), "SELECT conv_id, turn, regexp_matches(lower(role || ' ' || text), 'delete|withdraw|retract|kill|remove') AS withdrawn FROM conversations")
    add("F9", lambda x, d: s.table(x, d, "part").select("p_partkey", clean.pollable(F.upper(F.regexp_extract("p_name", "^([a-zA-Z]+)", 1))).alias("pollable")), "SELECT p_partkey, regexp_full_match(upper(regexp_extract(p_name, '^([a-zA-Z]+)', 1)), '[A-Z]{1,5}') AS pollable FROM part")
    stamp = lambda: F.concat(F.lit("2024-01-0"), (F.col("event_id") % 9 + 1).cast("string"), F.lit("T12:30:45"), F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise(" bad"))
    add("F10", lambda x, d: s.table(x, d, "events").select("event_id", F.unix_seconds(clean.iso_instant(stamp())).alias("at_s")), """SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(epoch(make_timestamp(2024, 1, event_id % 9 + 1, 12, 30, 45)) AS BIGINT) WHEN 1 THEN CAST(epoch(make_timestamp(2024, 1, event_id % 9 + 1, 10, 30, 45)) AS BIGINT) END AS at_s FROM events""")
    text = lambda: F.concat(F.lit("2024-02-1"), (F.col("event_id") % 9).cast("string"), F.lit(" 01:02:03"), F.when(F.col("event_id") % 2 == 0, " UTC").otherwise(""))
    add("F11", lambda x, d: s.table(x, d, "events").select("event_id", F.date_format(clean.plain_instant(text()), "yyyy-MM-dd HH:mm:ss").alias("at")), "SELECT event_id, '2024-02-1' || (event_id % 9) || ' 01:02:03' AS at FROM events")
    add("F12", lambda x, d: s.trades(x, d).select("event_id", clean.epoch_date(F.floor(F.col("ts_ms") / 1000)).alias("date")), q("trades", "SELECT event_id, CAST(make_timestamp(ts_ms * 1000) AS DATE) AS date FROM trades"), "", "date")
    add("F13", lambda x, d: s.trades(x, d).select("event_id", clean.floor_to(F.col("ts_ms"), 300_000).alias("start_ms")), q("trades", "SELECT event_id, ts_ms - ts_ms % 300000 AS start_ms FROM trades"))
    offset = "CASE WHEN {0} >= march AND {0} < november THEN 4 ELSE 5 END"
    days = """days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), seasons AS (SELECT date, CAST(make_date(year(date), 3, 1) + CAST((7 - dayofweek(make_date(year(date), 3, 1))) % 7 + 7 AS INTEGER) AS DATE) AS march,
        CAST(make_date(year(date), 11, 1) + CAST((7 - dayofweek(make_date(year(date), 11, 1))) % 7 AS INTEGER) AS DATE) AS november FROM days)"""
    add("F14", lambda x, d: s.table(x, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().select("date", clean.close_ms(F.col("date")).alias("close_ms"), clean.cutoff_ms(F.col("date")).alias("cutoff_ms")), f"WITH {days} SELECT date, CAST(epoch_ms(CAST(date AS TIMESTAMP)) + (16 + {offset.format('date')}) * 3600000 AS BIGINT) AS close_ms, CAST(epoch_ms(CAST(date AS TIMESTAMP)) + (9 + {offset.format('date')}) * 3600000 + 1200000 AS BIGINT) AS cutoff_ms FROM seasons", "", "date")
    add("F15", lambda x, d: s.table(x, d, "orders").select(F.to_date("o_orderdate").alias("date")).distinct().select("date", clean.exchange_ms(F.col("date"), 9, 30).alias("open_ms")), f"WITH {days} SELECT date, CAST(epoch_ms(CAST(date AS TIMESTAMP)) + (9 + {offset.format('date')}) * 3600000 + 1800000 AS BIGINT) AS open_ms FROM seasons", "", "date")
    add("F16", lambda x, d: s.table(x, d, "lineitem").select("l_orderkey", "l_linenumber", clean.clipped_change(F.col("l_extendedprice"), F.col("l_quantity") * 700.0371).alias("change")), "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity * 700.0371) < 1e-12 THEN 0 ELSE greatest(least(l_extendedprice / (l_quantity * 700.0371) - 1, 5), -5) END AS change FROM lineitem", "change", "", "l_linenumber")
    add("F17", lambda x, d: s.table(x, d, "customer").select("c_custkey", clean.padded_cik(F.col("c_custkey").cast("string")).alias("cik"), clean.archive_path(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.concat(F.lit("0001-24-"), F.col("c_custkey").cast("string")), F.lit("a.htm")).alias("path")), "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, 'edgar/data/' || regexp_replace(lpad(CAST(c_custkey AS VARCHAR), 10, '0'), '^0+', '') || '/000124' || c_custkey || '/a.htm' AS path FROM customer")
    add("F21", lambda x, d: s.table(x, d, "documents").select("doc_id", clean.meaningful(F.col("text")).alias("meaningful")), "SELECT doc_id, regexp_matches(text, '[A-Za-z0-9]') AS meaningful FROM documents")
    logits = lambda: F.array((F.col("l_discount") * 10).alias("a"), F.col("l_tax") * 10, F.col("l_quantity") / 10)
    soft = lambda i: F.get(clean.softmax(logits()), F.lit(i))
    add("F24", lambda x, d: s.table(x, d, "lineitem").select("l_orderkey", "l_linenumber", soft(0).alias("positive"), (soft(0) - soft(1)).alias("score")), "SELECT l_orderkey, l_linenumber, exp(a - m) / z AS positive, (exp(a - m) - exp(b - m)) / z AS score FROM (SELECT *, exp(a - m) + exp(b - m) + exp(c - m) AS z FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 10 AS c, greatest(l_discount * 10, l_tax * 10, l_quantity / 10) AS m FROM lineitem))", "positive score", "", "l_linenumber")
    add("F26", lambda x, d: s.table(x, d, "documents").select("doc_id", clean.shard(F.sha2("source", 256), 16).alias("shard")), "SELECT doc_id, ('0x' || substr(sha256(source), 1, 2))::BIGINT % 16 AS shard FROM documents")
    add("F27", lambda x, d: clean.faults_of(s.daily(x, d), ["open", "close"], ["open", "close", "volume"]), q("daily", "SELECT count(*) AS rows, count(*) FILTER (WHERE open IS NULL OR close IS NULL) AS not_finite, max(greatest(abs(open), abs(close), abs(volume))) AS largest FROM daily"), "largest")
    add("F28", lambda x, d: s.daily(x, d).select("symbol", "date", clean.compact(F.col("volume")).alias("volume")), q("daily", "SELECT symbol, date, ln(1 + greatest(volume, 0)) AS volume FROM daily"), "volume", "date")
    et = "(ts_ms - 5 * 3600000)"  # the events are of January
    add("F30", lambda x, d: s.trades(x, d).where(clean.regular_hours(F.col("ts_ms"))).select("event_id"), q("trades", f"SELECT event_id FROM trades WHERE floor({et} / 60000)::BIGINT % 1440 BETWEEN 570 AND 960"))
    add("F32", lambda x, d: s.daily(x, d).select("symbol", "date", (F.col("close") - F.col("open")).alias("change"), (F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100).alias("change_percent")), q("daily", "SELECT symbol, date, close - open AS change, (close - open) / open * 100 AS change_percent FROM daily"), "change change_percent", "date")
    add("F33", lambda x, d: s.trades(x, d).select("event_id", clean.prediction_date(F.col("ts_ms")).alias("date")), q("trades", "SELECT event_id, CAST(date - CASE dayofweek(date) WHEN 6 THEN 1 WHEN 0 THEN 2 ELSE 0 END AS DATE) AS date FROM (SELECT event_id, CAST(make_timestamp((ts_ms - 21600000) * 1000) AS DATE) AS date FROM trades)"), "", "date")
    add("F36", lambda x, d: s.trades(x, d).select("event_id", clean.market_open(F.col("ts_ms")).alias("open")), q("trades", f"SELECT event_id, dayofweek(make_timestamp({et} * 1000)) BETWEEN 1 AND 5 AND {et} // 60000 % 1440 >= 570 AND {et} // 60000 % 1440 < 960 AS open FROM trades"))
    add("F37", lambda x, d: s.daily(x, d).select(F.concat_ws("|", F.col("date").cast("string"), "symbol").alias("key")).select("key", F.split_part("key", F.lit("|"), F.lit(1)).alias("date"), F.split_part("key", F.lit("|"), F.lit(2)).alias("symbol")), q("daily", "SELECT CAST(date AS VARCHAR) || '|' || symbol AS key, CAST(date AS VARCHAR) AS date, symbol FROM daily"))
    add("F38", lambda x, d: s.table(x, d, "pages").select("page_id", clean.safe_name(F.col("url")).alias("name")), "SELECT page_id, replace(replace(replace(replace(url, '/', '_'), '\\', '_'), ':', '_'), ' ', '_') AS name FROM pages")
    add("K4", lambda x, d: s.table(x, d, "part").select("p_partkey", clean.entity_kind(F.col("p_brand")).alias("kind"), clean.entity_kind(F.concat(F.lit("macro:"), F.col("p_type"))).alias("macro_kind"), clean.entity_name(F.concat(F.lit("macro:"), F.col("p_type"))).alias("name")), "SELECT p_partkey, CASE WHEN p_brand LIKE 'XLK%' OR length(p_brand) <= 5 THEN 'etf' ELSE 'company' END AS kind, 'macro' AS macro_kind, p_type AS name FROM part")
    # served
    stored = lambda x, d: hourly(x, d).where(F.col("bar_start_ms") % (2 * HOUR) == 0)
    merged = f"SELECT symbol, bar_start_ms, close, CASE WHEN bar_start_ms % 10800000 = 0 THEN 'live' ELSE 'stored' END AS origin FROM ({bar_sql('trades', HOUR)}) WHERE bar_start_ms % 7200000 = 0 OR bar_start_ms % 10800000 = 0"
    add("J11", lambda x, d: bars.merge_live(stored(x, d), hourly(x, d).where(F.col("bar_start_ms") % (3 * HOUR) == 0)).select("symbol", "bar_start_ms", "close", "origin"), q("trades", merged), "close")
    day = lambda x, d: bars.daily_from_bars(hourly(x, d), "UTC")
    days_sql = f"SELECT symbol, CAST(make_timestamp(bar_start_ms * 1000) AS DATE) AS date, arg_min(open, bar_end_ms) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar_end_ms) AS close, sum(volume) AS volume FROM ({bar_sql('trades', HOUR)}) GROUP BY 1, 2"
    add("A11", day, q("trades", days_sql), OHLC, "date")
    add("J12", lambda x, d: bars.completed_and_today(day(x, d).where(F.dayofmonth("date") < 20), day(x, d).withColumn("close", F.lit(0.0))).select("symbol", "date", "close"), q("trades", f"SELECT symbol, date, CASE WHEN day(date) < 20 THEN close ELSE 0.0 END AS close FROM ({days_sql})"), "close", "date")
    add("Q1", lambda x, d: api.universe(x, d), "SELECT r_name AS category, n_name AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey")
    add("Q2", lambda x, d: api.latest_bar(hourly(x, d)).select("symbol", "bar_start_ms", "close"), q("trades", f"SELECT symbol, bar_start_ms, close FROM ({bar_sql('trades', HOUR)}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_end_ms DESC) = 1"), "close")
    add("Q3", lambda x, d: api.bars_between(hourly(x, d), "view", 1_704_153_600_000, 1_704_499_200_000, 60).select("symbol", "bar_start_ms", "close"), q("trades", f"SELECT symbol, bar_start_ms, close FROM ({bar_sql('trades', HOUR)}) WHERE symbol = 'view' AND bar_start_ms >= 1704153600000 AND bar_end_ms <= 1704499200000 ORDER BY bar_start_ms DESC LIMIT 60"), "close")
    add("O1", lambda x, d: api.latest_bars(hourly(x, d), "click", 120).select("symbol", "bar_start_ms", "close"), q("trades", f"SELECT symbol, bar_start_ms, close FROM ({bar_sql('trades', HOUR)}) WHERE symbol = 'click' ORDER BY bar_start_ms DESC LIMIT 120"), "close")
    add("Q4", lambda x, d: api.snapshot(stored(x, d), hourly(x, d).where(F.col("bar_start_ms") % (3 * HOUR) == 0)), q("trades", f"SELECT symbol, bar_start_ms, close, origin FROM ({merged}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_start_ms DESC) = 1"), "close")
    add("Q7", lambda x, d: api.status(hourly(x, d), 1_707_000_000_000), q("trades", f"SELECT count(DISTINCT symbol) AS symbols, max(bar_end_ms) AS newest_ms, 1707000000000 - max(bar_end_ms) AS age_ms, count(*) AS n_bars FROM ({bar_sql('trades', HOUR)})"))
    add("S14", windows, q("daily", WINDOWS), "", "window_start window_end")
    add("S19", lambda x, d: bars.synthetic_trades(s.trades(x, d), "seq", "ts_ms"), q("trades", f"SELECT 'benchmark-' || symbol || '-' || seq AS event_id, * FROM ({MADE_UP})"), "price volume")
    add("S19_bars", lambda x, d: bars.bars(bars.synthetic_trades(s.trades(x, d), "seq", "ts_ms"), HOUR), s.sql("trades", f", made AS ({MADE_UP}) {bar_sql('made', HOUR, '(ts_ms, -seq)')}"), OHLC)
