"""Fits that need iteration: each step is an aggregate by fold, a few numbers a row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newton(rows: DataFrame, rounds: int = 25, ridge: float = 1e-6) -> DataFrame:
    """rows (key, x, y) -> (key, b, m): intercept and slope of a logistic fit for each key that has both outcomes.

    A step is one aggregate over all rows, grouped by key before; only a key's sums reach the driver. Steps are kept
    within +-20.
    """
    spark, kind = rows.sparkSession, rows.schema["key"].dataType.simpleString()
    counts = rows.where("x is not null and y is not null").groupBy("key", "x", "y").agg(F.count("*").alias("k")).persist()
    found = {r.key: (0.0, 1.0) for r in counts.groupBy("key").agg(F.count_distinct("y").alias("n")).where("n > 1").collect()}
    going = set(found)
    for _ in range(rounds):
        if not going:
            break
        at = spark.createDataFrame([(k, *found[k]) for k in going], f"fit_key {kind}, b double, m double")
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("b") + F.col("m") * F.col("x")))))
        each = counts.join(F.broadcast(at), F.col("key").eqNullSafe(F.col("fit_key"))).withColumn("e", F.col("k") * (F.col("y") - p)).withColumn("w", F.col("k") * p * (1 - p))
        sums = each.groupBy("key").agg(F.sum("e").alias("g0"), F.sum(F.expr("e * x")).alias("g1"), F.sum("w").alias("h0"), F.sum(F.expr("w * x")).alias("h1"), F.sum(F.expr("w * x * x")).alias("h2"))
        for r in sums.collect():
            step = np.linalg.solve(np.array([[r.h0 + ridge, r.h1], [r.h1, r.h2 + ridge]]), np.array([r.g0, r.g1]))
            b, m = found[r.key]
            found[r.key] = float(np.clip(b + step[0], -20, 20)), float(np.clip(m + step[1], -20, 20))
            if np.abs(step).max() < 1e-12:
                going.discard(r.key)
    counts.unpersist()
    return spark.createDataFrame([(k, *v) for k, v in found.items()], f"fit_key {kind}, b double, m double")


def platt(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, part, p, label) -> intercept and slope fitted on validation rows of each fold, within the clamps."""
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("p").cast("double")))
    fits = newton(rows.where("part = 'validate'").select(F.col(key).alias("key"), F.log(q / (1 - q)).alias("x"), F.col("label").cast("double").alias("y")), 30)
    within = lambda c, least, most, other: F.greatest(F.lit(least), F.least(F.lit(most), F.coalesce(c, F.lit(other))))
    keys = rows.select(key).distinct()
    return keys.join(F.broadcast(fits), F.col(key).eqNullSafe(F.col("fit_key")), "left").select(key, within("b", -2.0, 2.0, 0.0).alias("intercept"), within("m", 0.75, 1.25, 1.0).alias("slope"))


def logistic_map(rows: DataFrame, key: str, x: str) -> DataFrame:
    """Adds p by a logistic fit on x, standardised, of each fold's training rows: an expanding refit when folds expand.

    A fold with one outcome has p 0.5, one without training rows has none.
    """
    train = rows.where("part = 'train'").select(F.col(key).alias("key"), F.col(x).cast("double").alias("raw"), F.col("label").cast("double").alias("y"))
    scale = train.groupBy(F.col("key").alias("scale_key")).agg(F.avg("raw").alias("mean"), F.stddev_pop("raw").alias("sd")).withColumn("sd", F.when(F.col("sd") > 1e-12, F.col("sd")).otherwise(1.0))
    fits = newton(train.join(F.broadcast(scale), F.col("key").eqNullSafe(F.col("scale_key"))).select("key", ((F.col("raw") - F.col("mean")) / F.col("sd")).alias("x"), "y"))
    found = rows.join(F.broadcast(scale), F.col(key).eqNullSafe(F.col("scale_key")), "left").join(F.broadcast(fits), F.col(key).eqNullSafe(F.col("fit_key")), "left")
    z = F.coalesce("b", F.lit(0.0)) + F.coalesce("m", F.lit(0.0)) * (F.col(x) - F.col("mean")) / F.col("sd")
    return found.select(*(rows[c] for c in rows.columns), (1 / (1 + F.exp(-F.when(z.isNotNull(), F.greatest(F.lit(-20.0), F.least(F.lit(20.0), z)))))).alias("p"))
