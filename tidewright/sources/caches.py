"""Tables in parts that count once they are whole: caches of what is dear to compute, and batches of a stream.

A part is a folder that Spark marks when the last of its files is there. Readers take marked folders only, so that a
run that was stopped leaves nothing half done, and the next one goes on where it ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.ordering import saved
from tidewright.session import keep_first

SHARDS = 16
MARK = "_SUCCESS"


def whole_parts(spark: SparkSession, path: str, depth: int = 1) -> list[str]:
    """The folders `depth` levels below path that are whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *["*"] * depth, MARK]))
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(str(f.getPath().getParent()) for f in found or [])


def read_parts(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def shard_of(key: Column, shards: int) -> Column:
    """By the first byte of a hash in hex, as model inputs are dealt to workers."""
    return F.conv(F.substring(key, 1, 2), 16, 10).cast("int") % shards


def read_cache(spark: SparkSession, path: str, schema, key: str | None = None) -> DataFrame:
    """All that the cache holds. Runs at the same time may both have added a key: with `key`, it is there once."""
    rows = read_parts(spark, whole_parts(spark, path, 2), schema)
    return rows if key is None else keep_first(rows, [key], [F.xxhash64(*rows.columns)])


def extend_cache(inputs: DataFrame, path: str, key: str, infer: Callable[[DataFrame], DataFrame], schema, shards: int = SHARDS, only: list[int] | None = None) -> int:
    """Adds what the cache lacks of inputs (key, a hash in hex, and what infer takes); the number of parts that were written.

    infer turns rows of inputs into rows of schema. Shards go one after another, each on the whole cluster: what is
    missing of a shard is an anti-join with that shard's parts alone, and becomes a part. A stopped run loses the
    shard at hand. A shard that lacks nothing writes nothing. only: these shards, for workers that share a cache.
    """
    spark = inputs.sparkSession
    once = saved(inputs.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("_shard", shard_of(F.col(key), shards)), "inputs")
    asked = {r[0] for r in once.select("_shard").distinct().collect()}
    wrote = 0
    for s in sorted(asked if only is None else asked & set(only)):
        done = read_parts(spark, whole_parts(spark, f"{path}/shard={s}"), schema).select(key)
        todo = once.where(F.col("_shard") == s).drop("_shard").join(done, key, "left_anti")
        if todo.isEmpty():
            continue
        infer(todo).select(*(f.name for f in spark.createDataFrame([], schema).schema)).write.parquet(f"{path}/shard={s}/part-{uuid.uuid4().hex}")
        wrote += 1
    return wrote
