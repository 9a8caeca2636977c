"""Panels and reports: compositions of the operators over daily bars (symbol, date, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.clean import infinite
from tidewright.operators import labels
from tidewright.operators import rolling as r


def pooled_labels(daily: DataFrame, bench: str) -> DataFrame:
    """Next session's gap, open to close and close to close, and whether open to close beats the benchmark's."""
    a = daily.select("symbol", "date", "close", labels.lead("open", 1).alias("no"), labels.lead("close", 1).alias("nc")).where("nc is not null")
    b = a.where(F.col("symbol") == bench).select("date", (F.col("nc") / F.col("no")).alias("b"))
    one = lambda x, n: (x > 0).cast("int").alias(n)
    return a.join(b, "date").select("symbol", "date", one(F.col("no") / F.col("close") - 1, "gap_up"), one(F.col("nc") / F.col("no") - 1, "intraday_up"), one(F.col("nc") / F.col("close") - 1, "close_up"), (F.col("nc") / F.col("no") > F.col("b")).cast("int").alias("excess_up"))


def market_dataset(daily: DataFrame, symbol: str, bench: str, warm_up: int = 14) -> DataFrame:
    """One symbol's features and whether the next close is above this one, past the first rows."""
    b = daily.where(F.col("symbol") == bench).select("date", r.simple_return(1).alias("b"))
    a = r.with_returns(daily.where(F.col("symbol") == symbol))
    f = a.select(
        "date", r.simple_return(1).alias("return_1"), r.simple_return(3).alias("return_3"), r.volatility(6).alias("volatility_6"), r.relative_volume("with_current").alias("relative_volume"),
        labels.close_up(1).alias("label"), F.row_number().over(r.order()).alias("i"),
    )
    f = f.join(b, "date").where((F.col("i") > warm_up) & F.col("label").isNotNull() & F.col("b").isNotNull())
    return f.select("date", "return_1", "return_3", "volatility_6", "relative_volume", (F.col("return_1") - F.col("b")).alias("spread"), "label")


# The names and order of the combined panel's columns.
MARKET = "ret_1 ret_3 ret_6 volatility_6 volume_mean_6 rel_volume rsi_14 spy_ret_1 sector_spy_diff".split()
NEWS = (
    "article_count positive_proportion neutral_proportion negative_proportion average_sentiment max_positive_sentiment max_negative_sentiment sentiment_stddev "
    "time_decayed_sentiment entity_weighted_sentiment holding_sentiment abnormal_news_volume article_novelty source_weighted_sentiment cross_article_disagreement "
    "sector_breadth macro_news_count news_coverage news_freshness_hours"
).split()
EMBEDDED = [f"embedding_{i}" for i in range(8)]


def market_vector(daily: DataFrame, symbol: str, bench: str, warm_up: int = 14) -> DataFrame:
    """The nine market columns of a symbol by date, over its whole history; a date needs `warm_up` rows before it and
    the benchmark's closes of its date and of the symbol's date before."""
    b = daily.where(F.col("symbol") == bench).select("date", F.col("close").alias("b"))
    rows = r.with_returns(daily.where(F.col("symbol") == symbol)).join(b, "date", "left")
    mean = r.whole(F.col("volume"), 6, F.avg)
    one, market = r.simple_return(1), r.simple_return(1, "b")
    values = [one, r.simple_return(3), r.simple_return(6), r.volatility(6), mean, F.col("volume") / F.greatest(F.lit(1.0), mean), r.rsi(14), market, one - market]
    found = rows.select("date", *(c.alias(n) for c, n in zip(values, MARKET, strict=True)), F.row_number().over(r.order()).alias("_i"))
    return found.where((F.col("_i") > warm_up) & F.col("volatility_6").isNotNull() & F.col("spy_ret_1").isNotNull()).drop("_i")


def combined(daily: DataFrame, symbol: str, bench: str, articles: DataFrame, start: str, end: str) -> DataFrame:
    """Market and news columns by date from start to end, and whether the next close is above.

    articles: session (the one that they are known before), content_hash, seq (order of arrival), and what
    daily_vector takes. Each content counts once; an article counts for the session before its own. No news is 0.
    """
    from tidewright.operators import news
    from tidewright.session import keep_first

    days = daily.where(F.col("symbol") == symbol)
    prior = days.select(F.col("date").alias("session"), r.lag("date").alias("date")).where("date is not null")
    known = keep_first(articles.where(F.col("session").between(start, end)).join(prior, "session"), ["content_hash"], ["seq"])
    vector = news.daily_vector(known, ["date"], 8).toDF("date", *NEWS, *EMBEDDED)
    label = days.where(F.col("date").between(start, end)).select("date", labels.close_up(1).alias("target_next_close_up"))
    panel = market_vector(daily, symbol, bench).join(label.where("target_next_close_up is not null"), "date")
    return news.zero_filled(panel, vector, ["date"]).select("date", *MARKET, *NEWS, *EMBEDDED, "target_next_close_up")


def repaired(panel: DataFrame, daily: DataFrame, symbol: str, bench: str) -> DataFrame:
    """panel with its market columns computed again; dates without history go, other columns stay as they are."""
    return panel.drop(*MARKET).join(market_vector(daily, symbol, bench), "date").select(*panel.columns)


def ablation_profiles(columns: list[str], volatility: list[str] | None = None) -> dict[str, list[str]]:
    """The columns of each profile of an ablation; combined is the largest market profile and the news without embeddings."""
    market = [c for c in columns if c in MARKET]
    logits = [c for c in columns if c in NEWS]
    wide = market + [c for c in volatility or [] if c in columns]
    found = {"class-prior": [], "market": market}
    if volatility:
        found["market-volatility"] = wide
    return found | {"logits-only": logits, "combined": wide + logits}


def dataset_faults(rows: DataFrame, key: str, target: str, seq: str) -> DataFrame:
    """One row on a dataset to be trained on: rows, keys that are empty or not above all before, targets that are
    neither 0 nor 1, numbers that aren't finite, and whether it may be used, which takes ten rows too. seq: an integer."""
    from tidewright.session import running_max

    missing = [c for c in (key, target) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    numbers = [c for c, kind in rows.dtypes if kind in ("double", "float")]
    bad = F.lit(False)
    for c in numbers:
        bad = bad | infinite(F.col(c))
    before = running_max(rows.withColumn("_one", F.lit(1)), "_one", seq, key, "_largest", 100_000)
    out = before.agg(
        F.count("*").alias("rows"), F.count_if(F.col(key).isNull() | (F.col(key).cast("string") == "") | (F.col(key) <= F.col("_largest"))).alias("bad_keys"),
        F.count_if(F.col(target).isNull() | ~F.col(target).isin(0, 1)).alias("bad_targets"), F.count_if(bad).alias("not_finite"),
    )
    return out.withColumn("usable", (F.col("rows") >= 10) & (F.col("bad_keys") == 0) & (F.col("bad_targets") == 0) & (F.col("not_finite") == 0))


def legacy_features(daily: DataFrame, bench: str, lookback: int = 12, horizon: int = 6) -> DataFrame:
    """The legacy builder's nine features, volatility and strength by its proxies, and the log return over `horizon` rows.

    A row needs lookback + horizon + 1 rows before it and a future. The benchmark's return is that of the same date.
    """
    b = daily.where(F.col("symbol") == bench).select("date", F.coalesce(r.simple_return(1), F.lit(0.0)).alias("spy_ret_1"))
    mean = r.whole(F.col("volume"), 6, F.avg)
    one, six = r.simple_return(1), r.simple_return(6)
    f = daily.select(
        "symbol", "date", one.alias("ret_1"), r.simple_return(3).alias("ret_3"), six.alias("ret_6"), F.sqrt(F.greatest(F.lit(1e-8), F.abs(six) + 1e-8)).alias("volatility_6"),
        mean.alias("volume_mean_6"), (F.col("volume") / F.greatest(F.lit(1e-8), mean)).alias("rel_volume"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + 10 * one)).alias("rsi_14"),
        F.log(labels.lead("close", horizon) / F.col("close")).alias("label"), F.row_number().over(r.order()).alias("i"),
    )
    f = f.where((F.col("i") > lookback + horizon + 1) & F.col("label").isNotNull()).drop("i").join(b, "date")
    return f.withColumns({"sector_spy_diff": F.col("ret_1") - F.col("spy_ret_1"), "log_return": F.col("label")}).drop("label").withColumnRenamed("log_return", "label")
