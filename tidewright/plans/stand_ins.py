"""The given tables in the roles of trades, daily bars, calendars, articles, filings and holdings; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import epoch_ms

BENCH = "5-LOW"
#: The symbols of the stand-in universe.
SYMBOLS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
KINDS = ["click", "view", "purchase", "signup", "logout"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trades(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), F.col("value").alias("price"), F.expr("try_cast(regexp_extract(props, '\"k\": *([0-9]+)', 1) as double)").alias("volume"), epoch_ms("ts").alias("ts_ms"), F.col("event_id").alias("seq"))


def repeated_trades(spark: SparkSession, d: str) -> DataFrame:
    """trades, every seventh of which arrives again, and every eleventh 20 minutes later under its old id."""
    t = trades(spark, d)
    again = t.where("event_id % 7 = 0").withColumn("seq", F.col("seq") + 10_000_000)
    later = t.where("event_id % 11 = 0").withColumn("seq", F.col("seq") + 20_000_000).withColumn("ts_ms", F.col("ts_ms") + 1_200_000)
    return t.unionByName(again).unionByName(later)


def daily(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"),
    )


def monthly(spark: SparkSession, d: str) -> DataFrame:
    """daily by calendar month: bars that every symbol has on almost every date, for panels of a full universe."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("date")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume"),
    )


def sector_bars(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as trades of the panel's 18 symbols, by week: sessions that all symbols have, over seven years."""
    from tidewright.plans.sector_panel import CONTEXT, SECTORS

    li = table(spark, d, "lineitem")
    symbol = F.element_at(F.array(*map(F.lit, SECTORS + CONTEXT)), (F.col("l_partkey") % 18 + 1).cast("int"))
    at = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    return li.groupBy(symbol.alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(
        F.min_by("l_extendedprice", at).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"),
        F.max_by("l_extendedprice", at).alias("close"), F.sum("l_quantity").alias("volume"),
    )


def vix(spark: SparkSession, d: str) -> DataFrame:
    """A daily index with gaps."""
    return daily(spark, d).where((F.col("symbol") == "1-URGENT") & (F.dayofmonth("date") % 3 != 0)).select("date", "close")


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Dates on which all five symbols have a bar."""
    return daily(spark, d).groupBy("date").agg(F.count_distinct("symbol").alias("k")).where("k = 5").select(F.col("date").alias("session"))


def published_ms(doc_id: str = "doc_id") -> Column:
    """An article's instant: some hours and minutes into the calendar, by its id."""
    return F.lit(788_918_400_000) + F.col(doc_id) * 11_700_000


def articles(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    a = docs.join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")), "doc_id", "left")
    pos = (F.col("n_chars") % 97) / 100
    neg = (F.col("n_chars") % 61) / 200
    return a.select(
        "doc_id", F.col("source").alias("publisher"), F.col("lang").alias("sector"), F.sha2(F.lower("text"), 256).alias("content_hash"), published_ms().alias("published_ms"),
        pos.alias("positive"), neg.alias("negative"), (pos - neg).alias("score"), ((F.col("doc_id") % 48).cast("double")).alias("age_hours"), ((F.col("doc_id") % 5) / 10).alias("weight"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("macro"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("fixture"), ((F.col("doc_id") % 4) / 4).alias("sector_share"),
        F.date_add(F.lit("1995-01-01").cast("date"), F.floor(F.col("doc_id") * 11_700_000 / 86_400_000).cast("int")).alias("day"), "n_chars",
    )


def filings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as filings: issuer, form and acceptance date."""
    o = table(spark, d, "orders")
    form = F.element_at(F.array(*map(F.lit, ("8-K", "10-Q", "10-K", "10-K/A", "4", "5", "SC 13D", "S-1"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("filing"), F.col("o_custkey").alias("issuer"), form.alias("form"), F.to_date("o_orderdate").alias("accepted"), F.col("o_orderpriority").alias("sector"), (F.sqrt(F.col("o_orderkey") % 200) / 7 - 1).alias("sentiment"))


def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Quarterly holdings: the customers that ordered in the quarter, available from its last day."""
    o = table(spark, d, "orders")
    quarter = F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2))
    return o.select(quarter.alias("snapshot"), F.col("o_custkey").alias("symbol"), "o_totalprice").groupBy("snapshot", "symbol").agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("weight"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents with a score from their length, and a fold."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    p = ((F.col("n_chars") * 7 + F.col("doc_id")) % 101) / 101
    return labels.join(docs, "doc_id").select("doc_id", p.alias("p"), F.col("quality").cast("int").alias("label"), (F.col("doc_id") % 3).alias("fold"), F.when(F.col("doc_id") % 5 < 3, "train").when(F.col("doc_id") % 5 == 3, "validate").otherwise("test").alias("part"), "n_chars")


SQL = {
    "trades": """trades AS (SELECT event_id, event_type AS symbol, value AS price, TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS volume, epoch_us(ts) // 1000 AS ts_ms, event_id AS seq FROM events)""",
    "repeated": """repeated AS (SELECT * FROM trades UNION ALL SELECT event_id, symbol, price, volume, ts_ms, seq + 10000000 FROM trades WHERE event_id % 7 = 0
        UNION ALL SELECT event_id, symbol, price, volume, ts_ms + 1200000, seq + 20000000 FROM trades WHERE event_id % 11 = 0)""",
    "daily": """daily AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
        arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)""",
    "sector_bars": """sector_bars AS (SELECT ['XLB', 'XLC', 'XLE', 'XLF', 'XLI', 'XLK', 'XLP', 'XLRE', 'XLU', 'XLV', 'XLY', 'SPY', 'QQQ', 'IWM', 'TLT', 'HYG', 'GLD', 'USO'][l_partkey % 18 + 1] AS symbol,
        CAST(date_trunc('week', l_shipdate) AS DATE) AS date, first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low,
        last(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)""",
    "r1": """r1 AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER o > 0 THEN ln(close / lag(close) OVER o) END AS r1, close - lag(close) OVER o AS d1 FROM daily WINDOW o AS (PARTITION BY symbol ORDER BY date))""",
    "sessions": """sessions AS (SELECT date AS session FROM daily GROUP BY date HAVING count(DISTINCT symbol) = 5)""",
    "articles": """articles AS (SELECT d.doc_id, source AS publisher, lang AS sector, sha256(lower(text)) AS content_hash, 788918400000 + d.doc_id * 11700000 AS published_ms,
        (n_chars % 97) / 100 AS positive, (n_chars % 61) / 200 AS negative, (n_chars % 97) / 100 - (n_chars % 61) / 200 AS score, CAST(d.doc_id % 48 AS DOUBLE) AS age_hours, (d.doc_id % 5) / 10 AS weight,
        coalesce(quality = 1, false) AS macro, coalesce(toxic = 1, false) AS fixture, (d.doc_id % 4) / 4 AS sector_share,
        CAST(DATE '1995-01-01' + CAST(floor(d.doc_id * 11700000 / 86400000) AS INTEGER) AS DATE) AS day, n_chars
        FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id))""",
    "filings": """filings AS (SELECT o_orderkey AS filing, o_custkey AS issuer, ['8-K', '10-Q', '10-K', '10-K/A', '4', '5', 'SC 13D', 'S-1'][o_orderkey % 8 + 1] AS form, CAST(o_orderdate AS DATE) AS accepted,
        o_orderpriority AS sector, sqrt(o_orderkey % 200) / 7 - 1 AS sentiment FROM orders)""",
    "snapshots": """snapshots AS (SELECT last_day(CAST(date_trunc('quarter', o_orderdate) AS DATE) + INTERVAL 2 MONTH) AS snapshot, o_custkey AS symbol, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS weight FROM orders GROUP BY 1, 2)""",
    "predictions": """predictions AS (SELECT l.doc_id, ((n_chars * 7 + l.doc_id) % 101) / 101 AS p, CAST(quality AS INTEGER) AS label, l.doc_id % 3 AS fold,
        CASE WHEN l.doc_id % 5 < 3 THEN 'train' WHEN l.doc_id % 5 = 3 THEN 'validate' ELSE 'test' END AS part, n_chars FROM labels l JOIN documents d USING (doc_id))""",
}
NEEDS = {"repeated": ["trades"], "r1": ["daily"], "sessions": ["daily"]}


def sql(needs: str, body: str) -> str:
    """body behind the named stand-ins and those they need."""
    names: list[str] = []

    def add(n: str) -> None:
        for m in NEEDS.get(n, []):
            add(m)
        if n not in names:
            names.append(n)

    for n in needs.split():
        add(n)
    return ("WITH RECURSIVE " + ",\n".join(SQL[n] for n in names) + "\n" if names else "") + body
