"""Readers. Each has an explicit schema; rows that can't be read come back with a reason, never silently dropped."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRADE_FRAME = "type string, msg string, data array<struct<s:string,p:double,v:double,t:bigint,c:array<string>>>"
HISTORY = "symbol string, timestamp_utc long, open double, high double, low double, close double, volume double"
SUBMISSIONS = "cik string, name string, tickers array<string>, filings struct<recent:struct<accessionNumber:array<string>,form:array<string>,acceptanceDateTime:array<string>,filingDate:array<string>,primaryDocument:array<string>>>"
FACTS = "cik long, entityName string, facts map<string,map<string,struct<units:map<string,array<struct<accn:string,val:double,end:string,frame:string,form:string>>>>>>"
STORY_BODY = "id:string,altId:string,firstCreated:string,versionCreated:string,takeSequence:int,messageType:string,pubStatus:string,provider:string,headline:string,body:string,url:string,subjects:array<string>"
STORY = ", ".join(f.replace(":", " ", 1) for f in STORY_BODY.replace("array<string>", "array!").split(",")).replace("array!", "array<string>") + "".join(f", {w} struct<{STORY_BODY}>" for w in ("data", "payload", "message"))
HOLDINGS = "sector string, symbol string, effective_from string, available_from string, effective_to string, weight double, source string"
OPEN_END = "9999-12-31"
#: What a quoted empty field is to the parser, so that it isn't null; no text is this.
EMPTY = "\x01\x02empty\x03"


def trade_frames(lines: DataFrame) -> DataFrame:
    """lines (value) -> trades; frames of another type and lines that aren't JSON have reject_reason instead."""
    seq = F.monotonically_increasing_id().alias("line")
    parsed = lines.select(seq, F.from_json("value", TRADE_FRAME).alias("f"))
    reason = F.when(F.col("f").isNull() | F.col("f.type").isNull(), "malformed").when(F.col("f.type") != "trade", "control frame").when(F.coalesce(F.size("f.data"), F.lit(0)) <= 0, "no trades")
    tagged = parsed.withColumn("reject_reason", reason)
    good = tagged.where("reject_reason is null").select("line", F.posexplode("f.data").alias("place", "t"), "reject_reason")
    good = good.select("line", "place", F.col("t.s").alias("symbol"), F.col("t.p").alias("price"), F.col("t.v").alias("volume"), F.col("t.t").alias("ts_ms"), F.col("t.c").alias("conditions"), "reject_reason")
    return good.unionByName(tagged.where("reject_reason is not null").select("line", "reject_reason"), allowMissingColumns=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with a header: line breaks in quotes, doubled quotes. Carriage returns are dropped wherever they stand;
    an empty field is null, a quoted empty one an empty text."""
    rows = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, enforceSchema=True, lineSep="\n", nullValue="", emptyValue=EMPTY)
    text = lambda c: F.when(F.col(c) == EMPTY, "").otherwise(F.regexp_replace(c, "\r", ""))
    return rows.select(*(text(c).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    from tidewright.functions.clean import epoch_date

    return read_csv(spark, path, HISTORY).withColumn("date", epoch_date(F.col("timestamp_utc")))


def order_faults(daily: DataFrame) -> DataFrame:
    """Rows whose date isn't after the one before, by symbol in order of seq: a history that has any is refused."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("seq")
    return daily.withColumn("before", F.lag("date").over(w)).where(F.col("date") <= F.col("before"))


def submissions(rows: DataFrame, column: str = "value") -> DataFrame:
    """Filings from parallel arrays, cut to the shortest."""
    r = F.col("j.filings.recent")
    names = {"accessionNumber": "accession", "form": "form", "acceptanceDateTime": "accepted_at", "filingDate": "filed_on", "primaryDocument": "document"}
    least = F.least(*(F.size(r[n]) for n in names))
    parsed = rows.select(F.from_json(column, SUBMISSIONS).alias("j"))
    zipped = F.arrays_zip(*(r[n].alias(a) for n, a in names.items()))
    return parsed.select(F.lpad("j.cik", 10, "0").alias("cik"), F.get("j.tickers", F.lit(0)).alias("symbol"), F.posexplode(F.slice(zipped, F.lit(1), least)).alias("position", "f")).select("cik", "symbol", "position", "f.*")


def company_facts(rows: DataFrame, column: str = "value", taxonomy: str = "us-gaap") -> DataFrame:
    """(cik, tag, unit, accn, val, end, frame, form), a row for each value."""
    j = rows.select(F.from_json(column, FACTS).alias("j"))
    tags = j.select("j.cik", F.explode(F.element_at("j.facts", F.lit(taxonomy))).alias("tag", "f"))
    units = tags.select("cik", "tag", F.explode("f.units").alias("unit", "v"))
    return units.select("cik", "tag", "unit", F.explode("v").alias("x")).select("cik", "tag", "unit", "x.*")


def stories(lines: DataFrame) -> DataFrame:
    """Versions of stories, out of their envelope if they have one; subjects may be strings or objects with a code."""
    j = lines.select(F.from_json("value", STORY).alias("j"))
    fields = [f.split(":")[0] for f in STORY_BODY.split(",")]
    out = j.select(*(F.coalesce(F.col(f"j.{f}"), F.col(f"j.data.{f}"), F.col(f"j.payload.{f}"), F.col(f"j.message.{f}")).alias(f) for f in fields))
    code = lambda s: F.coalesce(*(F.get_json_object(s, f"$.{k}") for k in ("ric", "permId", "permid", "code", "id", "value")), s)
    return out.withColumn("subjects", F.transform("subjects", lambda s: F.when(s.startswith("{"), code(s)).otherwise(s)))


def holdings(spark: SparkSession, path: str) -> DataFrame:
    """Holdings snapshots with a fault column: only the open end is allowed, and dates must be YYYY-MM-DD."""
    iso = r"^\d{4}-\d{2}-\d{2}$"
    rows = read_csv(spark, path, HOLDINGS)
    fault = F.when(~F.col("effective_from").rlike(iso), "bad date").when(F.col("effective_to") != OPEN_END, "closed interval").when(F.col("weight").isNull(), "bad weight")
    return rows.withColumn("fault", fault)


def issuer_key(c):
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def resolve_issuers(rows: DataFrame, tickers: DataFrame) -> DataFrame:
    """rows (issuer) with the symbol of the ticker table's equal name, letters and digits only; null if unresolved."""
    t = tickers.select(issuer_key(F.col("issuer")).alias("_k"), "symbol").groupBy("_k").agg(F.min("symbol").alias("symbol"))
    return rows.withColumn("_k", issuer_key(F.col("issuer"))).join(t, "_k", "left").drop("_k")


def float_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Rows (row, values) of packed little-endian float32 files of `width` columns; a ragged file raises."""
    import numpy as np

    def read(batches):
        for b in batches:
            for content in b["content"]:
                x = np.frombuffer(content, "<f4")
                if len(x) % width:
                    raise ValueError("the file's size isn't a multiple of the width")
                x = x.reshape(-1, width)
                yield pd.DataFrame({"row": np.arange(len(x)), "values": list(x)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "row long, values array<float>")


def json_array_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array, also packed as .xz. NaN outside of strings is null, invalid UTF-8 is replaced."""
    import lzma
    import re

    #: a string, to be left as it is, or a bare NaN
    bare = re.compile(r'("(?:[^"\\]|\\.)*")|\bNaN\b', re.S)

    @F.pandas_udf("string")
    def text(name: pd.Series, content: pd.Series) -> pd.Series:
        whole = [(lzma.decompress(c) if n.endswith(".xz") else c).decode("utf-8", "replace") for n, c in zip(name, content, strict=True)]
        return pd.Series([bare.sub(lambda m: m.group(1) or "null", t) for t in whole])

    files = spark.read.format("binaryFile").load(path)
    return files.select(F.inline(F.from_json(text("path", "content"), f"array<struct<{schema}>>")))


def plain_list(lines: DataFrame, names: list[str], column: str = "value") -> DataFrame:
    """Lines cut at commas, blanks around fields dropped; quotes mean nothing here. Missing fields are null."""
    parts = F.split(column, ",", -1)
    return lines.select(*(F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)))


METADATA = "model_id string, target_symbol string, model_version string, prediction_horizon int, feature_version string, features array<string>"
BAR = "bar_id:string,symbol:string,interval:string,bar_start:string,bar_end:string,open:double,high:double,low:double,close:double,volume:double,trade_count:double,first_trade_timestamp:string,last_trade_timestamp:string"
TRADE = "event_id:string,symbol:string,price:double,volume:double,timestamp:string,source:string"
MESSAGE = f"type string, status string, sequence double, trade struct<{TRADE}>, one_minute struct<{BAR}>, five_minute struct<{BAR}>"


def model_metadata(rows: DataFrame, column: str = "value") -> DataFrame:
    """Metadata of models from JSON, and a fault where one can't be served: a required field is missing or there are no
    feature names. The version is v001 unless given."""
    m = rows.select("*", F.from_json(column, METADATA).alias("m")).select(*(c for c in rows.columns if c != column), "m.*")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    fault = F.when(blank("model_id") | blank("target_symbol") | blank("feature_version"), "incomplete").when(F.coalesce(F.size("features"), F.lit(0)) <= 0, "no features")
    return m.withColumns({"model_version": F.coalesce("model_version", F.lit("v001")), "fault": fault})


def messages(rows: DataFrame, column: str = "value") -> DataFrame:
    """kind of each live message: update, status or heartbeat; null where it has another type or lacks a field."""
    j = F.from_json(column, MESSAGE)
    m = F.col("_m")

    def has(part: str, body: str):
        found = F.lit(True)
        for f in body.split(","):
            name, kind = f.split(":")
            c = m[part][name]
            found = found & (c.isNotNull() if kind == "string" else c.isNotNull() & ~F.isnan(c))
        return found

    update = (m["type"] == "market_update") & m["sequence"].isNotNull() & has("trade", TRADE) & has("one_minute", BAR) & has("five_minute", BAR)
    kind = F.when(update, "update").when((m["type"] == "stream_status") & m["status"].isNotNull(), "status").when((m["type"] == "heartbeat") & m["sequence"].isNotNull(), "heartbeat")
    return rows.withColumn("_m", j).withColumn("kind", kind).drop("_m")


def request_windows(spark: SparkSession, start: str, end: str, days: int = 30) -> DataFrame:
    """Spans of `days` from start, the last one cut at end."""
    one = spark.range(1).select(F.lit(start).cast("date").alias("start"), F.lit(end).cast("date").alias("end"))
    return planned_windows(one, days).select("window_start", "window_end")


def planned_windows(spans: DataFrame, days: int = 30) -> DataFrame:
    """spans (start, end as dates, any keys) -> a row for each `days` of each from start, with nth from 0, the last one cut at end.

    A span that doesn't end after its start, or lacks either, has no window.
    """
    if days <= 0:
        raise ValueError("windows have a positive number of days")
    n = F.ceil(F.date_diff("end", "start") / days).cast("int")
    each = spans.where("end > start").withColumn("nth", F.explode(F.sequence(F.lit(0), n - 1)))
    found = each.withColumn("window_start", F.date_add("start", F.col("nth") * days))
    return found.withColumn("window_end", F.least(F.date_add("window_start", days), F.col("end"))).drop("start", "end")


def window_counts(rows: DataFrame, windows: DataFrame, keys: list[str], date: str, starts: DataFrame, days: int = 30) -> DataFrame:
    """windows with n, how many of the rows (keys, date) fall into each: a row's window follows from its span's start."""
    nth = F.floor(F.date_diff(date, "start") / days).cast("int")
    counts = rows.join(starts.select(*keys, "start"), keys).groupBy(*keys, nth.alias("nth")).agg(F.count("*").alias("n"))
    return windows.join(counts, [*keys, "nth"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def stream(spark: SparkSession, kind: str, **options) -> DataFrame:
    """A stream of any source that the session has; Kafka needs its package."""
    return spark.readStream.format(kind).options(**options).load()
