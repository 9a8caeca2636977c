"""Circular moving-block bootstrap of a mean and of the area under the ROC curve.

A replicate of n ordered rows is made of blocks of consecutive rows that start at drawn places and go on around the
end; the last block is cut so that n rows are drawn. A replicate is never written down as rows: a row's weight in it is
the number of blocks that cover the row, which a task counts from the replicate's sorted starts. For the area, rows go
by score, so that a replicate's concordant pairs are prefix sums of weights; a task streams its range of scores with a
few numbers for each replicate in hand, and ranges are put together by what those before them hold.

Draws are a function of seed, replicate and block in whole numbers below 2 ** 62, so that SQL can draw the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordering import numbered

BLOCK, REPLICATES, TAIL = 20, 1000, 0.025
PRIME = 2_147_483_647
#: Rows that a task takes at a time; each such batch draws all replicates again.
BATCH = 1 << 18


def starts(seed: int, replicate: int, blocks: int, n: int) -> np.ndarray:
    """Where the blocks of a replicate start, from 0 to n - 1."""
    b = np.arange(blocks, dtype=np.int64)
    x = ((replicate + 1) * 1_000_003 + (b + 1) * 7_919 + seed % PRIME * 104_729) % PRIME
    h = x * 48_271 % PRIME
    h = (h * h + x) % PRIME
    h = (h * 69_621 + replicate) % PRIME
    h = (h * h + b) % PRIME
    g = (h * 40_692 + 1) % PRIME
    g = (g * g + h) % PRIME
    return (h * PRIME + g) % n


def weights(at: np.ndarray, n: int, seed: int, replicate: int, block: int) -> np.ndarray:
    """How often rows at places `at` are drawn in a replicate."""
    blocks = -(-n // block)
    drawn = starts(seed, replicate, blocks, n)
    whole, last, rest = np.sort(drawn[:-1]), drawn[-1], n - (blocks - 1) * block
    upto = np.searchsorted(whole, at, "right")
    around = at < block
    under = np.searchsorted(whole, np.where(around, n + at - block, at - block), "right")
    out = np.where(around, upto + len(whole) - under, upto - under)
    return out + ((at - last) % n < rest)


def batches_of(batches, columns: list[str], most: int):
    """Arrays of columns, about `most` rows at a time."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append([b.column(c).to_numpy(zero_copy_only=False) for c in columns])
            n += b.num_rows
        if n >= most:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def by_series(arrays: list[np.ndarray]):
    """Runs of equal first elements."""
    cuts = np.flatnonzero(np.diff(arrays[0])) + 1
    for a, b in zip([0, *cuts], [*cuts, len(arrays[0])], strict=True):
        yield int(arrays[0][a]), [x[a:b] for x in arrays[1:]]


def series_of(rows: DataFrame, series: str | None, order: str, **columns) -> DataFrame:
    """(series, i from 0 in order, n, columns as doubles); rows with a null among them are left out."""
    key = F.lit(0).cast("long") if series is None else F.col(series).cast("long")
    picked = rows.select(key.alias("series"), F.col(order).alias("o"), *(F.col(c).cast("double").alias(n) for n, c in columns.items()))
    return numbered(picked.dropna(subset=["series", *columns]), ["series"], ["o"], "i", "n").drop("o")


def mean_replicates(rows: DataFrame, order: str, value: str, series: str | None = None, block: int = BLOCK, replicates: int = REPLICATES, seed: int = 7) -> DataFrame:
    """(series, replicate, value): means of the replicates. series: a whole number, added to the seed; one series if not given."""
    import pyarrow as pa

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for arrays in batches_of(batches, ["series", "i", "n", "v"], BATCH):
            for s, (i, n, v) in by_series(arrays):
                total = sums.setdefault(s, np.zeros(replicates))
                for r in range(replicates):
                    total[r] += weights(i, int(n[0]), seed + s, r, block) @ v / n[0]
        for s, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, s)), pa.array(np.arange(replicates)), pa.array(total)], names=["series", "replicate", "value"])

    # sorted, so that a batch has few series
    parts = series_of(rows, series, order, v=value).sortWithinPartitions("series").mapInArrow(run, "series long, replicate long, value double")
    return parts.groupBy("series", "replicate").agg(F.sum("value").alias("value"))


class Pairs:
    """Concordant pairs of a range of scores, for each replicate: pos, neg, pairs, and those of the score at hand."""

    def __init__(self, replicates: int):
        self.pos, self.neg, self.pairs, self.here_pos, self.here_neg = (np.zeros(replicates) for _ in range(5))
        self.score = None

    def close(self) -> None:
        self.pairs += self.here_pos * (self.neg + self.here_neg / 2)
        self.pos, self.neg = self.pos + self.here_pos, self.neg + self.here_neg
        self.here_pos, self.here_neg = np.zeros(len(self.pos)), np.zeros(len(self.pos))

    def add(self, score: np.ndarray, label: np.ndarray, weigh) -> None:
        """Rows in order of score; weigh(replicate) gives their weights."""
        if self.score is not None and score[0] != self.score:
            self.close()
        group = np.concatenate([[0], np.cumsum(np.diff(score) != 0)])
        self.score = score[-1]
        for r in range(len(self.pos)):
            w = weigh(r)
            pos, neg = np.bincount(group, w * label), np.bincount(group, w * (1 - label))
            pos[0], neg[0] = pos[0] + self.here_pos[r], neg[0] + self.here_neg[r]
            below = self.neg[r] + np.cumsum(neg) - neg
            self.pairs[r] += (pos[:-1] * (below[:-1] + neg[:-1] / 2)).sum()
            self.pos[r], self.neg[r] = self.pos[r] + pos[:-1].sum(), below[-1]
            self.here_pos[r], self.here_neg[r] = pos[-1], neg[-1]


def auc_replicates(rows: DataFrame, order: str, score: str, label: str, series: str | None = None, block: int = BLOCK, replicates: int = REPLICATES, seed: int = 7) -> DataFrame:
    """(series, replicate, value): areas of the replicates that have both outcomes, equal scores counting half. label: 0 or 1."""
    import pyarrow as pa

    names = ["series", "part", "replicate", "pos", "neg", "pairs"]

    def run(batches):
        from pyspark import TaskContext

        part, found = TaskContext.get().partitionId(), {}
        for arrays in batches_of(batches, ["series", "i", "n", "score", "label"], BATCH):
            for s, (i, n, x, y) in by_series(arrays):
                found.setdefault(s, Pairs(replicates)).add(x, y, lambda r, i=i, n=int(n[0]), s=s: weights(i, n, seed + s, r, block))
        for s, p in found.items():
            p.close()
            k = np.arange(replicates)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(replicates, s)), pa.array(np.full(replicates, part)), pa.array(k), pa.array(p.pos), pa.array(p.neg), pa.array(p.pairs)], names=names)

    ranged = series_of(rows, series, order, score=score, label=label).repartitionByRange("series", "score").sortWithinPartitions("series", "score")
    parts = ranged.mapInArrow(run, "series long, part long, replicate long, pos double, neg double, pairs double")
    before = Window.partitionBy("series", "replicate").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("below", F.coalesce(F.sum("neg").over(before), F.lit(0.0)))
    whole = parts.groupBy("series", "replicate").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pairs") + F.col("pos") * F.col("below")).alias("pairs"))
    return whole.where("pos > 0 and neg > 0").select("series", "replicate", (F.col("pairs") / (F.col("pos") * F.col("neg"))).alias("value"))


def lower_bounds(found: DataFrame, tail: float = TAIL) -> DataFrame:
    """Replicates (series, value) -> (series, lower, replicates): the value at floor(tail * (replicates - 1)) in order."""
    values = found.groupBy("series").agg(F.sort_array(F.collect_list("value")).alias("v"))  # a bounded number each
    at = F.floor(F.lit(tail) * (F.size("v") - 1)).cast("int")
    return values.select("series", F.get("v", at).alias("lower"), F.size("v").cast("long").alias("replicates"))


def auc_lower_bound(rows: DataFrame, order: str, score: str, label: str, series: str | None = None, **options) -> DataFrame:
    """(series, lower, replicates). A series of whose replicates none has both outcomes gets 0.5 and 0 replicates."""
    key = F.lit(0).cast("long") if series is None else F.col(series).cast("long")
    bounds = lower_bounds(auc_replicates(rows, order, score, label, series, **options)).withColumnRenamed("series", "_of")
    every = rows.select(key.alias("series")).where("series is not null").distinct()
    return every.join(bounds, F.col("series") == F.col("_of"), "left").select("series", F.coalesce("lower", F.lit(0.5)).alias("lower"), F.coalesce("replicates", F.lit(0)).alias("replicates"))


def mean_lower_bound(rows: DataFrame, order: str, value: str, series: str | None = None, **options) -> DataFrame:
    """(series, lower, replicates) of the mean of a value, such as the difference of two models' errors on the same row."""
    return lower_bounds(mean_replicates(rows, order, value, series, **options))
