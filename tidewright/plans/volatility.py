"""The report on "the next session moves more than usual": a model and three plain scores, month by month, out of sample.

Every score becomes a probability by a logistic map that is refitted for each month on the rows up to half a year
before it; the model's is calibrated on that half year besides. The report has classification metrics, by year too,
bootstrap bounds of the areas, the model's quintiles of risk, and what exposures that follow the scores would earn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import bootstrap, expanding, metrics, models
from tidewright.operators import rolling as r
from tidewright.operators.indicators import ewma_variance
from tidewright.operators.labels import high_volatility_next, lead
from tidewright.operators.ordering import saved

# The scores in the order of their seeds, costs, sessions of history, target and seed of the report.
SCORES = ["raw_model", "calibrated_model", "rolling_volatility", "ewma_volatility", "previous_day_abs_return"]
COSTS = [0, 5, 10, 20]
HISTORY, TARGET, LARGE_MOVE, SEED = 60, 0.15, 0.02, 20_260_810


def samples(daily: DataFrame, symbol: str) -> DataFrame:
    """A row for each session of a symbol that has 60 before it and one after it: its scores, label and next return."""
    bars = ewma_variance(r.with_returns(daily.where(F.col("symbol") == symbol)).withColumn("x", r.intraday()), "variance", "x")
    found = bars.withColumn("median", r.trailing_median(20)).select(
        "date", F.date_format("date", "yyyy-MM").alias("month"), (F.row_number().over(r.order()) - 1).alias("at"), high_volatility_next("median").alias("label"),
        r.realised_volatility(20).alias("rolling_volatility"), F.sqrt("variance").alias("ewma_volatility"), r.open_to_close().alias("previous_day_abs_return"),
        r.mean_range(20).alias("raw_model"), (lead("close", 1) / lead("open", 1) - 1).alias("next_return"),
    )
    found = found.where((F.col("at") >= HISTORY) & F.col("label").isNotNull())
    return found.withColumn("nth", F.row_number().over(Window.orderBy("date")) - 1).drop("at")  # a symbol's calendar


def long(rows: DataFrame, names: list[str], out: str) -> DataFrame:
    """A row for each of the named columns: series (its place among SCORES) and its value."""
    parts = F.explode(F.array(*(F.struct(F.lit(SCORES.index(n)).cast("long").alias("series"), F.col(n).alias(out)) for n in names))).alias("_s")
    return rows.select(*(c for c in rows.columns if c not in names), parts).select("*", "_s.*").drop("_s")


def predictions(days: DataFrame) -> DataFrame:
    """samples -> (series, nth, date, month, label, next_return, score, p) of each month that can be predicted, for each score."""
    plain = [n for n in SCORES if n != "calibrated_model"]
    each = saved(long(days, plain, "score"), "scores")
    calendar = saved(expanding.folds(each), "folds")
    fitted = saved(expanding.fits(each, calendar), "fits")
    found = expanding.mapped(each, fitted)
    # the model's map of a month, at work on the half year before it
    model = calendar.where("series = 0").select("series", "month", "validate_from", "test_from")
    before = each.where("series = 0").select("nth", "label", "score")
    checked = before.join(F.broadcast(model), (F.col("nth") >= F.col("validate_from")) & (F.col("nth") < F.col("test_from") - 1))
    checked = expanding.mapped(checked, fitted).select(F.col("month").alias("fold"), F.lit("validate").alias("part"), "p", "label")
    scaling = models.platt(checked, "fold").withColumnRenamed("fold", "month")
    q = F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6))
    again = found.where("series = 0").join(F.broadcast(scaling), "month")
    calibrated = 1 / (1 + F.exp(-(F.col("intercept") + F.col("slope") * F.log(q / (1 - q)))))
    again = again.withColumn("p", calibrated).withColumn("series", F.lit(1).cast("long")).drop("intercept", "slope")
    every = found.unionByName(again.select(found.columns))
    return saved(every.withColumn("score", F.when(F.col("series") < 2, F.col("p")).otherwise(F.col("score"))), "predictions")


def name_of(series: str = "series") -> Column:
    return F.element_at(F.array(*map(F.lit, SCORES)), (F.col(series) + 1).cast("int"))


def told(rows: DataFrame, section: str, name: Column, at: Column, values: dict[str, Column]) -> DataFrame:
    """(section, name, at, metric, value), a row for each of the values."""
    metric = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in values.items()))).alias("m")
    return rows.select(F.lit(section).alias("section"), name.alias("name"), at.cast("string").alias("at"), metric).select("section", "name", "at", "m.*")


def classification(scored: DataFrame) -> list[DataFrame]:
    slope = scored.withColumn("month", F.lit("all")).select("series", "nth", "month", "label", F.log(F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6)) / (1 - F.greatest(F.least("p", F.lit(1 - 1e-6)), F.lit(1e-6)))).alias("score"))
    limits = slope.groupBy("series", "month").agg((F.max("nth") + 1).cast("long").alias("limit"))
    slopes = expanding.fits(slope, limits).select("series", F.col("slope").alias("calibration_slope"))
    whole = metrics.binary(scored, ["series"]).join(metrics.calibration(scored, ["series"]).drop("n"), "series").join(slopes, "series")
    half = lambda c: F.coalesce(F.col(c), F.lit(0.5))
    values = {"auc": half("auc"), "log_loss": F.col("log_loss"), "brier": F.col("brier"), "balanced_accuracy": half("balanced_accuracy"), "ece": F.col("ece"), "calibration_slope": F.col("calibration_slope")}
    by_year = metrics.binary(scored.withColumn("year", F.year("date")), ["series", "year"])
    yearly = {"rows": F.col("n"), "accuracy": F.col("accuracy"), "auc": F.col("auc"), "log_loss": F.col("log_loss")}
    return [told(whole, "classification", name_of(), F.lit("all"), values), told(by_year, "by year", name_of(), F.col("year"), yearly)]


def strategies(exposed: DataFrame, costs: list[int]) -> DataFrame:
    """exposed (name, date, e, r) -> a row for each name and cost: what the exposures earn after costs of changing them.

    The first exposure is bought from nothing; equity starts at 1, which is the first peak, and may go below 0.
    """
    w = Window.partitionBy("name").orderBy("date")
    each = exposed.withColumn("turn", F.abs(F.col("e") - F.lag("e", 1, 0.0).over(w))).withColumn("cost", F.explode(F.array(*map(F.lit, costs))))
    each = each.withColumn("net", F.col("e") * F.col("r") - F.col("cost") / 10_000 * F.col("turn"))
    path = Window.partitionBy("name", "cost").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = 1 + F.col("net")
    size = F.when(F.count_if(grown == 0).over(path) > 0, 0.0).otherwise(F.exp(F.sum(F.when(grown != 0, F.ln(F.abs(grown)))).over(path)))
    each = each.withColumn("equity", F.when(F.count_if(grown < 0).over(path) % 2 == 1, -size).otherwise(size))
    each = each.withColumn("fall", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(path)) - 1)
    n, sd, last = F.count("*"), F.stddev_samp("net"), F.max_by("equity", "date")
    return each.groupBy("name", "cost").agg(
        F.avg("e").alias("average_exposure"), F.avg("net").alias("average_daily_return"), F.when(sd > 1e-12, F.sqrt(F.lit(252.0)) * F.avg("net") / sd).otherwise(0.0).alias("sharpe"),
        F.when(last > 0, F.pow(last, 252 / n) - 1).otherwise(-1.0).alias("cagr"), F.least(F.lit(0.0), F.min("fall")).alias("max_drawdown"), F.avg("turn").alias("turnover"), last.alias("final_equity"),
    )


def exposures(scored: DataFrame, threshold: float) -> DataFrame:
    """(name, date, e, r) of the four ways to be exposed."""
    kept = lambda x: F.greatest(F.lit(0.25), F.least(F.lit(1.0), x))
    one = lambda n, e, s: scored.where(F.col("series") == SCORES.index(s)).select(F.lit(n).alias("name"), "date", e.alias("e"), F.col("next_return").alias("r"))
    model = one("model", kept(1 - F.col("p")), "calibrated_model")
    mean = model.agg(F.avg("e")).first()[0]
    follow = kept(TARGET / (F.greatest("score", F.lit(1e-6)) * F.sqrt(F.lit(252.0))))
    ways = [model, model.withColumn("name", F.lit("exposure_matched_buy_and_hold")).withColumn("e", F.lit(mean)), one("ewma_risk_target", follow, "ewma_volatility")]
    ways.append(one("top_quartile_50_percent_overlay", F.when(F.col("p") >= threshold, 0.5).otherwise(1.0), "raw_model"))
    out = ways[0]
    for x in ways[1:]:
        out = out.unionByName(x)
    return out


def report(scored: DataFrame, block: int = bootstrap.BLOCK, replicates: int = bootstrap.REPLICATES) -> DataFrame:
    """predictions -> (section, name, at, metric, value): the whole report, in long form."""
    out = classification(scored)
    bounds = bootstrap.auc_lower_bound(scored, "nth", "score", "label", "series", block=block, replicates=replicates, seed=SEED)
    out.append(told(bounds, "bootstrap", name_of(), F.lit("all"), {"auc_lower_2_5_percentile": F.col("lower")}))
    raw = scored.where("series = 0")
    ranked = raw.withColumn("bucket", r.buckets("p", ["series"], "nth")).withColumn("move", F.abs("next_return"))
    quintiles = ranked.groupBy("bucket").agg(F.avg("move").alias("move"), F.avg((F.col("move") > LARGE_MOVE).cast("double")).alias("large"))
    out.append(told(quintiles, "risk quintiles", F.lit("raw_model"), F.col("bucket"), {"mean_next_abs_return": F.col("move"), "fraction_above_2_percent": F.col("large")}))
    quartile = metrics.empirical_quantile(raw, "p", 0.75)
    threshold = quartile.first()[0]
    out.append(told(quartile, "protocol", F.lit("top_quartile_threshold"), F.lit("all"), {"threshold": F.col("quantile")}))
    earned = strategies(exposures(scored, threshold if threshold is not None else 1.0), COSTS)
    out.append(told(earned, "strategy", F.col("name"), F.col("cost"), {c: F.col(c) for c in earned.columns if c not in ("name", "cost")}))
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
