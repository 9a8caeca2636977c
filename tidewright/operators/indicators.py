"""Chart indicators, the recursive ones followed along each symbol's dates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.rolling import folded


def ema(daily: DataFrame, k: int, out: str, value: str = "close") -> DataFrame:
    """Exponential mean: seeded with the plain mean of the first k, then alpha 2 / (k + 1); null before the seed."""

    def step(s, x, i):
        if i < k:
            s += x
            return (s / k, (s / k,)) if i == k - 1 else (s, (None,))
        s += 2 / (k + 1) * (x - s)
        return s, (s,)

    return folded(daily.where(F.col(value).isNotNull()), [out], step, 0.0, value)


def ewma_variance(daily: DataFrame, out: str, value: str, alpha: float = 2 / 21) -> DataFrame:
    """Exponential mean of squares over the whole history, from 0, the first row left out."""

    def step(s, x, i):
        s = alpha * x * x + (1 - alpha) * s if i and x is not None else s
        return s, (s,)

    return folded(daily, [out], step, 0.0, value)


def wilder_rsi(daily: DataFrame, out: str, k: int = 14) -> DataFrame:
    """Gains and losses by Wilder's means, seeded with plain ones of the first k changes; 100 without losses."""

    def step(s, x, i):
        last, gain, loss = s
        d = x - last if i else 0.0
        up, down = max(d, 0.0), max(-d, 0.0)
        gain, loss = (gain + up / k, loss + down / k) if i <= k else ((gain * (k - 1) + up) / k, (loss * (k - 1) + down) / k)
        return (x, gain, loss), (None if i < k else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss),)

    return folded(daily.where("close is not null"), [out], step, (0.0, 0.0, 0.0))


def macd(daily: DataFrame) -> DataFrame:
    """Adds macd (12 less 26), signal (9 over the macd line) and histogram, where all are defined."""
    both = ema(ema(daily, 12, "_fast"), 26, "_slow").withColumn("macd", F.col("_fast") - F.col("_slow")).where("macd is not null").drop("_fast", "_slow")
    return ema(both, 9, "signal", "macd").where("signal is not null").withColumn("histogram", F.col("macd") - F.col("signal"))


def statistics(daily: DataFrame) -> DataFrame:
    """Per symbol over its rows: return in per cent, yearly volatility, drawdown, extremes, mean volume, share of gains."""
    from tidewright.operators.rolling import drawdown, simple_return

    rows = daily.withColumn("_r", simple_return()).withColumn("_d", drawdown())
    return rows.groupBy("symbol").agg(
        ((F.max_by("close", "date") / F.min_by("close", "date") - 1) * 100).alias("return_pct"),
        (F.stddev_samp("_r") * F.sqrt(F.lit(252.0)) * 100).alias("volatility_pct"),
        (F.min("_d") * 100).alias("max_drawdown_pct"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.avg("volume").alias("mean_volume"),
        (F.avg(F.when(F.col("_r").isNotNull(), (F.col("_r") > 0).cast("double"))) * 100).alias("positive_pct"),
    )
