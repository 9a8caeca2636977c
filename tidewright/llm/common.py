"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(docs: DataFrame, column: str = "text"):
    """The text, null counting as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


@functools.lru_cache(maxsize=4)
def squeezers(level: int = 3):
    """(compressor, decompressor), made once for each Python process."""
    import zstandard

    return zstandard.ZstdCompressor(level=level), zstandard.ZstdDecompressor()


def squeeze(*columns: np.ndarray, level: int = 3) -> bytes:
    """Columns of whole numbers of one length, byte by byte (all lowest bytes first), so that small numbers take little."""
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns)
    return squeezers(level)[0].compress(planes)


def stretch_out(data: bytes, *types: str) -> list[np.ndarray]:
    """The columns of squeeze, of little-endian types."""
    planes, wide = np.frombuffer(squeezers()[1].decompress(data), np.uint8), [np.dtype(t).itemsize for t in types]
    m, out, at = len(planes) // sum(wide), [], 0
    for t, w in zip(types, wide, strict=True):
        out.append(np.ascontiguousarray(planes[at : at + w * m].reshape(w, m).T).view(t).reshape(m))
        at += w * m
    return out


def drop(df: DataFrame) -> None:
    """Deletes the files of a table of `written` that nothing will read again."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0]).getParent() if df.inputFiles() else None
    if folder is not None:
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def rows_of(batches, *columns: str, step: int = 512):
    """Tuples of Python values from Arrow batches, few at a time so that long texts don't pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(c).to_pylist() for c in columns), strict=True)


def give_back() -> None:
    """Returns memory that Python and Arrow no longer use to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of some C libraries only
    if trim is not None:
        trim(0)


def lean(run):
    """run, a function of batches, giving memory back when its batches end: workers live on between tasks of a stage and the next."""

    def go(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return go


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (node, label), label the least node reachable. edges: columns a, b; other columns are ignored.

    Alternates the large-star and small-star steps, which need about log(n) rounds and never hold a component in
    one task: what a hub gathers is one minimum, found with map-side aggregation. Nodes without an edge to another
    node aren't returned. Null ends are dropped, repeated edges and loops do no harm.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u > v")
    e = written(e.distinct(), "edges")
    was = None
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u is linked to the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        e = written(small, "edges")
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == was:
            break
        was = tuple(now)
    else:
        raise ValueError(f"components have not settled in {rounds} rounds")
    labels = e.groupBy("u").agg(F.min("v").alias("label")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node")).distinct().join(e.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return labels.unionByName(roots.withColumn("label", F.col("node")))


NULL_ID = -(1 << 62)


def id_key(doc_id, text):
    """(doc_id, text_hash), never null: what names a row of documents, but for rows that repeat both."""
    return F.coalesce(doc_id.cast("long"), F.lit(NULL_ID)).alias("id_key"), F.xxhash64(text).alias("text_key")


def keep_rows(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows of docs named by winners (id_key, text_key, repeats), all columns; of rows that repeat a name, one.

    The rows go in a struct meanwhile, so that no name of theirs can clash.
    """
    key, text = id_key(docs["doc_id"], text_column(docs))
    keyed = docs.select(key, text, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole"))
    found = keyed.join(winners.select("id_key", "text_key", "repeats"), ["id_key", "text_key"])
    kept = found.where("not repeats")
    if not winners.where("repeats").isEmpty():
        kept = kept.unionByName(found.where("repeats").dropDuplicates(["id_key", "text_key"]))
    return kept.select("whole.*")
