"""Evaluation of predictions and exposures. Rows have p (probability), label (0 or 1) and keys such as fold or year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.ordering import running

CLIP = 1e-7


def auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Area under the ROC curve with average ranks, null where a class is missing.

    Ranks come from counts by distinct score, which shuffle pre-aggregated, so a hot key is a count, not a sort; without
    keys, counts go by ranges of scores.
    """
    per = rows.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    w = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("before", F.sum("n").over(w) - F.col("n")) if keys else running(per, [], ["p"], "n")
    per = per.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    out = per.groupBy(*keys).agg(F.sum("pos").alias("p1"), F.sum(F.col("n") - F.col("pos")).alias("n1"), F.sum(F.col("rank") * F.col("pos")).alias("r"))
    value = F.when((F.col("p1") > 0) & (F.col("n1") > 0), (F.col("r") - F.col("p1") * (F.col("p1") + 1) / 2) / (F.col("p1") * F.col("n1")))
    return out.select(*keys, value.alias("auc"))


def binary(rows: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Accuracy, log loss, AUC, positive rate and mean probability."""
    q = F.least(F.greatest(F.col("p"), F.lit(CLIP)), F.lit(1 - CLIP))
    loss = -F.when(F.col("label") == 1, F.ln(q)).otherwise(F.ln(1 - q))
    hit = ((F.col("p") >= threshold).cast("int") == F.col("label")).cast("double")
    plain = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(loss).alias("log_loss"), F.avg(F.col("label").cast("double")).alias("positive_rate"), F.avg("p").alias("mean_p"))
    return plain.join(auc(rows, keys), keys) if keys else plain.crossJoin(auc(rows, keys))


def calibration(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Brier score, balanced accuracy and expected calibration error over ten bins."""
    right = F.col("p") >= 0.5
    plain = rows.groupBy(*keys).agg(
        F.avg(F.pow(F.col("p") - F.col("label"), 2)).alias("brier"),
        ((F.try_divide(F.count_if(right & (F.col("label") == 1)), F.count_if(F.col("label") == 1)) + F.try_divide(F.count_if(~right & (F.col("label") == 0)), F.count_if(F.col("label") == 0))) / 2).alias("balanced_accuracy"),
        F.count("*").alias("n"),
    )
    bins = rows.groupBy(*keys, F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("k"), F.avg("p").alias("mp"), F.avg(F.col("label").cast("double")).alias("ml"))
    ece = bins.groupBy(*keys).agg(F.sum(F.col("k") * F.abs(F.col("mp") - F.col("ml"))).alias("_e"))
    joined = plain.join(ece, keys) if keys else plain.crossJoin(ece)
    return joined.withColumn("ece", F.col("_e") / F.col("n")).drop("_e")


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum("label").cast("long").alias("positives"))


def confusion(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    said = F.col("p") >= threshold
    one = F.col("label") == 1
    return rows.agg(F.count_if(said & one).alias("tp"), F.count_if(said & ~one).alias("fp"), F.count_if(~said & one).alias("fn"), F.count_if(~said & ~one).alias("tn"), F.greatest(F.avg(F.col("label").cast("double")), 1 - F.avg(F.col("label").cast("double"))).alias("majority"))


def class_prior(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The positive rate of the training rows."""
    return rows.where("part = 'train'").groupBy(*keys).agg(F.avg(F.col("label").cast("double")).alias("prior"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The threshold of 0.05 to 0.95 in steps of 0.01 with the best accuracy; ties go to the nearest to 0.5, then the lower.

    Counts by hundredth of p are enough, so rows are never multiplied by thresholds.
    """
    per = rows.groupBy(F.floor(F.round(F.col("p") * 100, 9)).alias("h")).agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    t = rows.sparkSession.range(5, 96).select(F.col("id").alias("t"))
    right = F.when(F.col("h") >= F.col("t"), F.col("pos")).otherwise(F.col("neg"))
    found = t.join(F.broadcast(per)).groupBy("t").agg((F.sum(right) / F.sum(F.col("pos") + F.col("neg"))).alias("accuracy"))
    return found.agg(F.max_by(F.struct("t", "accuracy"), F.struct("accuracy", -F.abs(F.col("t") - 50), -F.col("t"))).alias("b")).select((F.col("b.t") / 100).alias("threshold"), F.col("b.accuracy").alias("accuracy"))


def promotion(windows: DataFrame, least: float = 0.55, at_least: int = 2) -> DataFrame:
    """windows (validate_auc, test_auc): whether there are enough and all are above the limit."""
    ok = (F.col("validate_auc") > least) & (F.col("test_auc") > least)
    return windows.agg(F.count("*").alias("windows"), (F.coalesce(F.bool_and(F.coalesce(ok, F.lit(False))), F.lit(False)) & (F.count("*") >= at_least)).alias("promoted"))


def average_rank(v: str, out: str, rows: DataFrame) -> DataFrame:
    """Adds v's average rank over all rows, from counts by value."""
    per = rows.groupBy(v).agg(F.count("*").alias("_n"))
    per = running(per, [], [v], "_n", "_before").select(v, (F.col("_before") + (F.col("_n") + 1) / 2).alias(out))
    return rows.join(per, v)


def variance_errors(rows: DataFrame) -> DataFrame:
    """QLIKE, errors of log variance, Spearman correlation and ratio of means, floors at 1e-10. rows: actual, forecast."""
    a, f = F.greatest("actual", F.lit(1e-10)), F.greatest("forecast", F.lit(1e-10))
    d = F.ln(f) - F.ln(a)
    plain = rows.agg(F.avg(a / f - F.ln(a / f) - 1).alias("qlike"), F.avg(F.abs(d)).alias("mae_log"), F.sqrt(F.avg(d * d)).alias("rmse_log"), (F.avg(f) / F.avg(a)).alias("ratio"))
    ranked = average_rank("forecast", "rf", average_rank("actual", "ra", rows))
    return plain.crossJoin(ranked.agg(F.corr("ra", "rf").alias("spearman")))


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds z_<column>, by mean and population deviation (1 if that is under 1e-6) of the training rows."""
    fit = rows.where("part = 'train'").agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    joined = rows.crossJoin(F.broadcast(fit))  # one row
    scale = lambda c: F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}"))
    return joined.select(*rows.columns, *(((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(f"z_{c}") for c in columns))


def scale_ratio(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of actual over forecast on validation rows: what forecasts are multiplied by."""
    return rows.where("part = 'validate'").groupBy(*keys).agg(F.avg(F.try_divide("actual", "forecast")).alias("scale"))


def empirical_quantile(rows: DataFrame, v: str, q: float) -> DataFrame:
    """The element at floor(q * (n - 1)) of the sorted values, without interpolation, from counts by value."""
    per = rows.where(F.col(v).isNotNull()).groupBy(v).agg(F.count("*").alias("_n"))
    per = running(per, [], [v], "_n", "_before", "_all").withColumn("_to", F.col("_before") + F.col("_n"))
    return per.where(F.col("_to") > F.floor(q * (F.col("_all") - 1))).agg(F.min(v).alias("quantile"))


def overlays() -> dict:
    """Exposure rules over p and sigma."""
    return {
        "probability": F.least(F.greatest(1 - F.col("p"), F.lit(0.25)), F.lit(1.0)),
        "volatility": F.least(F.greatest(0.15 / (F.greatest("sigma", F.lit(1e-6)) * F.sqrt(F.lit(252.0))), F.lit(0.25)), F.lit(1.0)),
    }


def backtest(rows: DataFrame, keys: list[str], costs_bps: list[int], order: str = "date") -> DataFrame:
    """rows: exposure e and return r in order. For each cost: final equity, largest drawdown, turnover, Sharpe, CAGR.

    The first exposure is bought from nothing; equity starts at 1, which is the first peak.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    moved = rows.withColumn("_turn", F.abs(F.col("e") - F.lag("e", 1, 0.0).over(w)))
    every = moved.withColumn("cost_bps", F.explode(F.array(*map(F.lit, costs_bps)))).withColumn("_net", F.col("e") * F.col("r") - F.col("cost_bps") / 10_000 * F.col("_turn"))
    path = Window.partitionBy(*keys, "cost_bps").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("_equity", F.exp(F.sum(F.ln(1 + F.col("_net"))).over(path)))
    every = every.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_equity").over(path)))
    final = F.max_by("_equity", order)
    return every.groupBy(*keys, "cost_bps").agg(final.alias("equity"), F.min(F.col("_equity") / F.col("_peak") - 1).alias("max_drawdown"), F.avg("_turn").alias("turnover"), F.when(F.stddev_samp("_net") > 0, F.avg("_net") / F.stddev_samp("_net") * F.sqrt(F.lit(252.0))).alias("sharpe"), (F.pow(final, 252 / F.count("*")) - 1).alias("cagr"))
