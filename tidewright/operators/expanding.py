"""Logistic maps of a score, refitted month by month on all rows that came before, for each of several series.

All months' fits go on at once: a Newton step is one aggregate over the rows, each of which counts for every later
month, with the sums of a month formed where the rows are read. Only those sums reach the driver, a row for each
series and month of the calendar.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordering import saved

#: Bounds of the linear part, of coefficients, of curvature; the ridge; when steps end.
LINEAR, COEFFICIENT, CURVATURE, RIDGE, STEPS, SMALL = 30.0, 20.0, 1e-8, 1e-6, 30, 1e-7


def folds(samples: DataFrame, validation_months: int = 6, purge: int = 1) -> DataFrame:
    """samples (series, nth, month) -> a row for each series and month that has `validation_months` months before it.

    limit: training rows are those before it (it drops `purge` rows before validation, but leaves one); validate_from
    and test_from: where the months of validation and the month itself begin.
    """
    first = samples.groupBy("series", "month").agg(F.min("nth").alias("test_from"))  # the calendar
    w = Window.partitionBy("series").orderBy("month")
    found = first.withColumn("validate_from", F.lag("test_from", validation_months).over(w)).where("validate_from is not null")
    limit = F.when(F.col("validate_from") > 1, F.greatest(F.lit(1), F.col("validate_from") - purge)).otherwise(F.lit(1))
    return found.withColumn("limit", limit.cast("long"))


def linear(score: str = "score") -> Column:
    z = (F.col(score) - F.col("mean")) / F.col("scale")
    return F.greatest(F.lit(-LINEAR), F.least(F.lit(LINEAR), F.col("intercept") + F.col("slope") * z))


def probability(score: str = "score") -> Column:
    """Of a row joined to its fit."""
    return 1 / (1 + F.exp(-linear(score)))


def fits(samples: DataFrame, limits: DataFrame) -> DataFrame:
    """(series, month, mean, scale, intercept, slope) of each row of limits (series, month, limit).

    samples: series, nth, score, label (0 or 1), no nulls. A fit takes the rows with nth < limit, their scores
    standardised by mean and population deviation. It starts from the log odds of the share of positives, and has
    slope 0 where scores don't vary or one outcome is missing. A limit with no rows before it has no fit.
    """
    spark, kinds = samples.sparkSession, ", ".join(f"{c} {samples.schema[c].dataType.simpleString() if c == 'series' else limits.schema[c].dataType.simpleString()}" for c in ("series", "month"))
    samples = saved(samples.select("series", "nth", F.col("score").cast("double"), F.col("label").cast("double")), "samples")
    schema = f"{kinds}, limit long, mean double, scale double, intercept double, slope double"

    def joined(of: DataFrame) -> DataFrame:
        of = of.select(F.col("series").alias("_series"), *(c for c in of.columns if c != "series"))
        return samples.join(F.broadcast(of), (F.col("series") == F.col("_series")) & (F.col("nth") < F.col("limit")))

    stats = joined(limits.select("series", "month", "limit")).groupBy("series", "month", "limit")
    stats = stats.agg(F.count("*").alias("n"), F.sum("label").alias("k"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    found, going = {}, set()
    for r in stats.collect():
        prior, flat = (r.k + 0.5) / (r.n + 1), not r.sd > 1e-12
        found[r.series, r.month] = [r.limit, r["mean"], 1.0 if flat else r.sd, math.log(prior / (1 - prior)), 0.0 if flat or r.k in (0, r.n) else 1.0]
        if found[r.series, r.month][-1]:
            going.add((r.series, r.month))
    bounded = lambda x: max(-COEFFICIENT, min(COEFFICIENT, x))
    for _ in range(STEPS):
        if not going:
            break
        z, p = (F.col("score") - F.col("mean")) / F.col("scale"), probability()
        each = joined(spark.createDataFrame([(*k, *found[k]) for k in going], schema)).withColumns({"z": z, "p": p})
        each = each.withColumn("e", F.col("p") - F.col("label")).withColumn("c", F.greatest(F.expr("p * (1 - p)"), F.lit(CURVATURE)))
        sums = each.groupBy("series", "month").agg(F.sum("e").alias("g0"), F.sum(F.expr("e * z")).alias("g1"), F.sum("c").alias("h00"), F.sum(F.expr("c * z")).alias("h01"), F.sum(F.expr("c * z * z")).alias("h11"))
        for r in sums.collect():
            key, h00, h11 = (r.series, r.month), r.h00 + RIDGE, r.h11 + RIDGE
            determinant = h00 * h11 - r.h01 * r.h01
            if not determinant > 1e-12:
                going.discard(key)
                continue
            d0, d1 = (h11 * r.g0 - r.h01 * r.g1) / determinant, (h00 * r.g1 - r.h01 * r.g0) / determinant
            found[key][3], found[key][4] = bounded(found[key][3] - d0), bounded(found[key][4] - d1)
            if abs(d0) < SMALL and abs(d1) < SMALL:
                going.discard(key)
    return spark.createDataFrame([(*k, *v) for k, v in found.items()], schema).drop("limit")


def mapped(rows: DataFrame, fitted: DataFrame, score: str = "score", out: str = "p") -> DataFrame:
    """rows (series, month, score and others) with their month's probability; rows of months without a fit go."""
    of = fitted.select(F.col("series").alias("_series"), F.col("month").alias("_month"), "mean", "scale", "intercept", "slope")
    found = rows.join(F.broadcast(of), (F.col("series") == F.col("_series")) & (F.col("month") == F.col("_month")))
    return found.select(*(rows[c] for c in rows.columns), probability(score).alias(out))
