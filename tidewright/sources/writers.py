"""Writers that may run twice and leave the same table."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import keep_first


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True


def insert_new(rows: DataFrame, path: str, keys: list[str], order: list) -> None:
    """Appends the first row of each key that the table lacks: first write wins."""
    fresh = keep_first(rows, keys, order)
    if exists(rows.sparkSession, path):
        fresh = fresh.join(rows.sparkSession.read.parquet(path).select(*keys), keys, "left_anti")
    fresh.write.mode("append").parquet(path)


def merged(stored: DataFrame, rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The table after an upsert: new rows replace stored ones of the same key, the last of several winning."""
    last = keep_first(rows, keys, order)
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert(rows: DataFrame, path: str, keys: list[str], order: list) -> None:
    """Writes the merged table beside the old one and returns only when it is whole; readers take the newest version."""
    spark = rows.sparkSession
    versions = version_table(spark, path)
    new = keep_first(rows, keys, order) if versions is None else merged(spark.read.parquet(f"{path}/v{versions}"), rows, keys, order)
    new.write.mode("overwrite").parquet(f"{path}/v{0 if versions is None else versions + 1}")


def version_table(spark: SparkSession, path: str) -> int | None:
    n = None
    while exists(spark, f"{path}/v{0 if n is None else n + 1}"):
        n = 0 if n is None else n + 1
    return n


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v{version_table(spark, path)}")


def entity_rows(articles: DataFrame) -> DataFrame:
    """One row for each entity of an article, with its kind and its name without a prefix."""
    from tidewright.functions.clean import entity_kind, entity_name

    e = articles.select("article_id", F.explode("entity_ids").alias("entity")).distinct()
    return e.select("article_id", entity_kind(F.col("entity")).alias("kind"), entity_name(F.col("entity")).alias("entity"))


def write_csv(rows: DataFrame, path: str, digits: int | None = None) -> None:
    """CSV with a header, quoted where needed: null is an empty field, an empty text a quoted one. digits: significant
    digits of doubles, written without closing zeros, as panels have 12, 15 or 17."""
    if digits is not None:
        rows = rows.select(*(significant(F.col(c), digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in rows.dtypes))
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue='""', lineSep="\n", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def significant(c: Column, digits: int) -> Column:
    """A number with at most so many significant digits, in the shorter of plain and exponent form."""
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v != v else f"{v:.{digits}g}")

    return run(c.cast("double"))


def published(stored: DataFrame | None, rows: DataFrame, keys: list[str], run: str, keep_days: int, today: str) -> DataFrame:
    """The published table after a run: rows without bodies and with the run's name replace those of the same key, and
    what is older than keep_days before today goes."""
    new = keep_first(rows.drop("body"), keys, [F.xxhash64(*sorted(c for c in rows.columns if c != "body"))]).withColumn("run", F.lit(run))
    whole = new if stored is None else stored.join(new.select(*keys), keys, "left_anti").unionByName(new)
    return whole.where(F.col("date") >= F.date_sub(F.lit(today).cast("date"), keep_days))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of the files of a folder, for manifests; each file is read by one task. Empty files aren't listed."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def rows_hash(rows: DataFrame) -> DataFrame:
    """Rows and a hash of them that doesn't depend on their order."""
    h = F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("rows_hash"))


def manifest(rows: DataFrame, **facts) -> str:
    found = rows_hash(rows).first()
    body = facts | {"rows": found["n"], "rows_hash": found["rows_hash"]}
    return json.dumps(body | {"sha256": hashlib.sha256(json.dumps(body, sort_keys=True).encode()).hexdigest()}, sort_keys=True)


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, object]:
    """rows with an observation of how many pass and how many were rejected, without another job."""
    from pyspark.sql import Observation

    o = Observation(name)
    rejected = F.count_if(F.col("reject_reason").isNotNull()) if "reject_reason" in rows.columns else F.lit(0).cast("long")
    return rows.observe(o, F.count("*").alias("rows"), rejected.alias("rejected")), o
