"""Packed matrices of float32: files of rows without a header, and an index that says where each input's row is.

Writing, a task fills a file of its own and tells the index where its rows are; files of failed tries are in no index.
Reading, index rows meet by stretch of a file, and a task reads that stretch alone, so that no file is read as a whole
and vectors aren't shuffled.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file that one read takes.
STRETCH = 8192
INDEX = "input_hash string, file string, row long"


def opened(path: str):
    """(file system, path in it) of a path or address that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def write_matrix(rows: DataFrame, key: str, values: str, path: str, width: int) -> DataFrame:
    """Writes vectors of exactly `width` finite numbers and returns the index (input_hash, file, row), which is saved at path/index."""
    import pyarrow as pa

    def run(batches):
        name, stream, n = f"{uuid.uuid4().hex}.f32", None, 0
        system, folder = opened(path)
        for b in batches:
            if not b.num_rows:
                continue
            if stream is None:
                system.create_dir(folder, recursive=True)
                stream = system.open_output_stream(f"{folder}/{name}")
            vectors = b.column("values")
            flat = vectors.flatten().to_numpy(zero_copy_only=False)
            if vectors.null_count or (np.diff(vectors.offsets.to_numpy()) != width).any() or not np.isfinite(flat).all():
                raise ValueError(f"vectors must have {width} finite numbers")
            stream.write(np.ascontiguousarray(flat, "<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([name] * b.num_rows), pa.array(np.arange(n, n + b.num_rows))], names=["input_hash", "file", "row"])
            n += b.num_rows
        if stream is not None:
            stream.close()

    picked = rows.select(F.col(key).cast("string").alias("key"), F.col(values).cast("array<float>").alias("values"))
    picked.mapInArrow(run, INDEX).write.parquet(f"{path}/index")
    return rows.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def files_of(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(file, rows) of a matrix; a file whose size isn't a multiple of a row's raises."""
    from pyarrow import fs

    system, folder = opened(path)
    found = [(f.base_name, f.size) for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".f32")]
    for name, size in found:
        if size % (4 * width):
            raise ValueError(f"{name}: the size isn't a multiple of {width} numbers")
    return spark.createDataFrame([(name, size // (4 * width)) for name, size in found], "_file string, _rows long")


def read_matrix(index: DataFrame, path: str, width: int, stretch: int = STRETCH) -> DataFrame:
    """index (input_hash, file, row) -> input_hash, file, row, values, fault: "no such file", "out of range" or null."""
    import pyarrow as pa

    files = files_of(index.sparkSession, path, width)  # a row for each task that wrote
    known = index.select("input_hash", "file", "row").join(F.broadcast(files), F.col("file") == F.col("_file"), "left")
    fault = F.when(F.col("_rows").isNull(), "no such file").when(F.col("row").isNull() | (F.col("row") < 0) | (F.col("row") >= F.col("_rows")), "out of range")
    known = known.select("input_hash", "file", "row", fault.alias("fault"))

    def fetch(key, wanted):
        system, folder = opened(path)
        at = wanted.column("row").to_numpy()
        first, last = int(at.min()), int(at.max())
        with system.open_input_file(f"{folder}/{key[0].as_py()}") as f:
            x = np.frombuffer(f.read_at((last - first + 1) * 4 * width, first * 4 * width), "<f4").reshape(-1, width)[at - first]
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * width, pa.int32()), pa.array(x.ravel()))
        return pa.table({"input_hash": wanted.column("input_hash"), "file": wanted.column("file"), "row": wanted.column("row"), "values": vectors, "fault": pa.nulls(len(at), pa.string())})

    good = known.where("fault is null").groupBy("file", F.expr(f"row div {stretch}").alias("stretch")).applyInArrow(fetch, f"{INDEX}, values array<float>, fault string")
    return good.unionByName(known.where("fault is not null"), allowMissingColumns=True)
