"""Streams that outlive bad messages: a batch is split into rows and dead letters, and counts once it is whole.

A batch is written under its number in one go, rows and dead letters alike, and its folder is marked when the last
file is there. A batch that comes again, after a failure or a restart, replaces what the first try left; readers take
marked batches only. So a message is never lost, never counted twice, and never stops the stream.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.sources.caches import read_parts, whole_parts

TRADE = "event_id string, symbol string, price double, volume double, ts_ms long, seq long"


def parsed_trades(messages: DataFrame) -> DataFrame:
    """messages (value) -> value, the trade's fields, and reject_reason where it isn't a trade that can be counted."""
    t = F.from_json("value", TRADE)
    rows = messages.select("value", t.alias("t"))
    blank = lambda c: F.trim(F.coalesce(F.col(f"t.{c}"), F.lit(""))) == ""
    fields = [f.split()[0] for f in TRADE.split(", ")]
    none = F.lit(True)
    for f in fields:
        none = none & F.col(f"t.{f}").isNull()
    reason = (
        F.when(F.col("t").isNull() | none, "malformed").when(blank("event_id") | blank("symbol"), "missing identity")
        .when(~(F.coalesce("t.price", F.lit(0.0)) > 0) | F.isnan("t.price"), "invalid price").when(~(F.coalesce("t.volume", F.lit(-1.0)) >= 0) | F.isnan("t.volume"), "invalid volume")
        .when(F.coalesce("t.ts_ms", F.lit(0)) <= 0, "missing timestamp")
    )
    return rows.select("value", "t.*", reason.alias("reject_reason"))


def batch_writer(path: str, parse: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: parse adds reject_reason; rows and dead letters of a batch are written in one job."""

    def write(batch: DataFrame, number: int) -> None:
        tagged = parse(batch).withColumn("dead", F.col("reject_reason").isNotNull())
        tagged.write.mode("overwrite").partitionBy("dead").parquet(f"{path}/batch={number}")

    return write


def ingest(stream: DataFrame, path: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame] = parsed_trades, once: bool = True):
    """Starts the query; with `once` it ends with what is there."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch_writer(path, parse))
    return (w.trigger(availableNow=True) if once else w).start()


def written_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows and dead letters of all batches that are whole; schema is that of the parsed rows and `dead`."""
    return read_parts(spark, [f"{p}/dead={d}" for p in whole_parts(spark, path) for d in partitions(spark, p)], schema)


def partitions(spark: SparkSession, path: str) -> list[str]:
    """Which of dead=false and dead=true a batch has."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dead=*")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().getName().removeprefix("dead=") for f in found or [])


def outbox(rows: DataFrame, key: str, event_id: str) -> DataFrame:
    """Rows as messages of a log: key, value (JSON with fields in the order of their names), and id, by which a reader drops what is sent twice."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(rows.columns))).alias("value"), F.col(event_id).cast("string").alias("id"))
