"""Rows whose id isn't among the last so many ids that were taken: a live store's memory, over a whole history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import running, saved

HORIZON = 100_000


def recent_unique(rows: DataFrame, key: str, order: str, horizon: int = HORIZON) -> DataFrame:
    """rows in order of arrival without those whose key is among the last `horizon` keys that were taken before.

    Whether a row is taken depends on how many were taken since its key was, and so on the rows before. That is settled
    by rounds: from a guess (first rows of their keys are taken), count what is taken before each row, and judge each
    key's rows by those counts, until no judgement changes. A round settles at least the first row that was misjudged;
    where keys come back within the horizon, or not at all, the guess is right. Keys' rows are streamed, one number in
    hand. Null keys are never repeats.
    """
    arrived = saved(rows.withColumn("_arrival", F.monotonically_increasing_id()), "arrived")
    slim = arrived.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order).alias("at"), "_arrival")
    first = slim.groupBy("key").agg(F.min(F.struct("at", "_arrival"))["_arrival"].alias("_first"))
    state = slim.join(first, "key").select("key", "at", "_arrival", (F.col("_arrival") == F.col("_first")).cast("long").alias("taken"))
    schema = "key string, _arrival long, at {}, taken long, was long".format(rows.schema[order].dataType.simpleString())

    def judge(batches):
        import pyarrow as pa

        last_key = last = None
        for b in batches:
            taken = []
            for k, before in zip(b.column("key").to_pylist(), b.column("before").to_pylist(), strict=True):
                if k != last_key:
                    last_key, last = k, None
                new = last is None or last < before - horizon
                last = before if new else last
                taken.append(int(new))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("_arrival"), b.column("at"), pa.array(taken, pa.int64()), b.column("taken")], names=["key", "_arrival", "at", "taken", "was"])

    while True:
        counted = running(state, [], ["at", "_arrival"], "taken").drop("total")
        dealt = counted.repartition("key").sortWithinPartitions("key", "at", "_arrival")
        judged = saved(dealt.mapInArrow(judge, schema), "judged")
        state = judged.drop("was")
        if judged.where("taken <> was").isEmpty():
            break
    out = arrived.join(judged.where("taken = 1").select("_arrival"), "_arrival", "left_semi").drop("_arrival")
    return out.unionByName(arrived.where(F.col(key).isNull()).drop("_arrival"))
