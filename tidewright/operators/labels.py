"""Labels and chronological splits. Rows have symbol, date, open, close and whatever else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordering import numbered
from tidewright.operators.rolling import order


def lead(c: str, n: int) -> Column:
    return F.lead(c, n).over(order())


def up(x: Column) -> Column:
    return F.when(x.isNotNull(), (x > 0).cast("int"))


def close_up(days: int = 1) -> Column:
    """Whether the close of `days` later is above this one; null without a future."""
    return up(lead("close", days) / F.col("close") - 1)


def open_to_close_up(days: int = 1) -> Column:
    """From the next open to the close of `days` later."""
    return up(lead("close", days) / lead("open", 1) - 1)


def excess_up(daily: DataFrame, bench: str, days: int) -> DataFrame:
    """Adds label: this symbol's return over `days` sessions is above the benchmark's between the same two dates."""
    ahead = daily.withColumn("_to", lead("date", days)).withColumn("_ret", lead("close", days) / F.col("close") - 1)
    b = daily.where(F.col("symbol") == bench).select("date", F.col("close").alias("_c"))
    found = ahead.where("_to is not null").join(b.withColumnRenamed("_c", "_c0"), "date").join(b.select(F.col("date").alias("_to"), F.col("_c").alias("_c1")), "_to")
    return found.withColumn("label", (F.col("_ret") > F.col("_c1") / F.col("_c0") - 1).cast("int")).drop("_to", "_ret", "_c0", "_c1")


def high_volatility_next(median: str) -> Column:
    """Whether the next session's absolute open-to-close change is above this session's trailing median."""
    move = F.abs(lead("close", 1) / lead("open", 1) - 1)
    return F.when(move.isNotNull() & F.col(median).isNotNull(), (move > F.col(median)).cast("int"))


def log_variance_next() -> Column:
    return F.ln(F.pow(F.ln(lead("close", 1) / lead("open", 1)), 2) + 1e-8)


def chronological(rows: DataFrame, by: str, fraction: float) -> DataFrame:
    """Adds part: the last ceil(n * fraction) rows, in order of `by` and then of the other columns, are test."""
    placed = numbered(rows, [], [by, *(c for c in rows.columns if c != by)], "_nth", "_n")
    return placed.withColumn("part", F.when(F.col("_nth") >= F.col("_n") - F.ceil(F.col("_n") * fraction), "test").otherwise("train")).drop("_nth", "_n")


def three_way(rows: DataFrame, date: str, train_end, validate_end, test_end) -> DataFrame:
    """Adds part by inclusive ends; rows after test_end are an error, told by part = "beyond"."""
    d = F.col(date)
    return rows.withColumn("part", F.when(d <= F.lit(train_end), "train").when(d <= F.lit(validate_end), "validate").when(d <= F.lit(test_end), "test").otherwise("beyond"))


def yearly_folds(sessions: DataFrame, first_test: int, last_test: int) -> DataFrame:
    """(fold, date, part): train to two years before, validate the year before, test the year."""
    folds = F.explode(F.sequence(F.lit(first_test), F.lit(last_test))).alias("fold")
    y = F.year("date")
    part = F.when(y <= F.col("fold") - 2, "train").when(y == F.col("fold") - 1, "validate").when(y == F.col("fold"), "test")
    return sessions.select("date", folds).withColumn("part", part).where("part is not null")


def monthly_folds(sessions: DataFrame, first_year: int, validation_months: int = 6, purge: int = 5, train_months: int | None = None) -> DataFrame:
    """(fold, date, part) by month, with `purge` sessions dropped before validation and before test.

    sessions: date, one row each. A test month is of first_year + 2 or later. Everything is ranks over the calendar,
    a row a day.
    """
    day = sessions.select("date").distinct().withColumn("nth", F.row_number().over(Window.orderBy("date")))
    day = day.withColumn("month", (F.year("date") * 12 + F.month("date") - 1))
    months = day.groupBy("month").agg(F.min("nth").alias("first"), F.max("nth").alias("last"))
    tests = months.where(F.col("month") >= (first_year + 2) * 12).select(F.col("month").alias("fold"), F.col("first").alias("test_first"), F.col("last").alias("test_last"))
    start = months.select((F.col("month") + validation_months).alias("fold"), F.col("first").alias("validate_first"))
    folds = tests.join(start, "fold")
    oldest = F.lit(0) if train_months is None else F.col("fold") - validation_months - train_months
    rows = day.join(F.broadcast(folds), (day["nth"] <= folds["test_last"]) & (day["month"] >= oldest))
    n = F.col("nth")
    part = F.when(n >= F.col("test_first"), "test").when((n >= F.col("validate_first")) & (n < F.col("test_first") - purge), "validate").when(n < F.col("validate_first") - purge, "train")
    return rows.select("fold", "date", part.alias("part")).where("part is not null")


def three_folds(rows: DataFrame, by: str, folds: int = 3) -> DataFrame:
    """Chronological folds: of n rows in folds + 2 equal spans, fold i trains on i spans, validates on one, tests on the next, a row dropped at the end of train and validation."""
    out = numbered(rows, [], [by], "_i", "_n").select(*rows.columns, "_i", F.floor(F.col("_n") / (folds + 2)).alias("_span"), F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold"))
    a, b, c = (F.expr(f"(fold + {k}) * _span") for k in range(3))
    i = F.col("_i")
    part = F.when(i < a - 1, "train").when((i >= a) & (i < b - 1), "validate").when((i >= b) & (i < c), "test")
    return out.withColumn("part", part).where("part is not null").drop("_i", "_span")
