"""Session settings and small helpers that every plan uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tidewright", **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; in local mode, where it is unset, in a temporary one."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def epoch_ms(ts: str) -> Column:
    """Milliseconds since 1970 of a time stamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))")


def running_max(rows: DataFrame, key: str, order: str, value: str, out: str, width: int, strict: bool = True, tie: str | None = None) -> DataFrame:
    """Adds out: the largest value before this row (strict) or up to it, by key in the order of an integer column.

    Two levels, so that a key with very many rows isn't one task: spans of `width` orders are reduced to a row each,
    the largest of earlier spans is carried over those, and a window inside each span does the rest. Rows of one order
    stand by `tie`, if given. A null key is a key like any other, and rows without an order stand last.
    """
    span = F.struct(F.col(key).alias("key"), F.floor(F.col(order) / width).alias("nth"))  # in a struct, nulls meet in a join
    spanned = rows.withColumn("_span", span)
    tops = spanned.groupBy("_span").agg(F.max(value).alias("_top"))
    before = Window.partitionBy("_span.key").orderBy(F.asc_nulls_last("_span.nth")).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_span", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy("_span").orderBy(*map(F.asc_nulls_last, [order, *([tie] if tie else [])])).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    found = spanned.withColumn("_inside", F.max(value).over(inside)).join(tops, "_span")
    return found.withColumn(out, F.greatest("_before", "_inside")).drop("_span", "_before", "_inside")


def keep_first(rows: DataFrame, keys: list, order: list) -> DataFrame:
    """One row for each key: the first in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")
