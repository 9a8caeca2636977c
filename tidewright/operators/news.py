"""Aggregates of articles, filings and embeddings by session and symbol or sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_vector(articles: DataFrame, keys: list[str], embedding_dims: int = 8) -> DataFrame:
    """The daily news vector of eligible articles: positive, negative, score, age_hours, weight, sector_share, macro,
    content_hash, fixture, embedding. Null age counts as no article age."""
    n = F.count("*")
    weighted = F.avg(F.col("score") * F.col("weight"))
    out = articles.groupBy(*keys).agg(
        n.alias("article_count"),
        F.avg("positive").alias("mean_positive"),
        F.greatest(F.lit(0.0), 1 - F.avg("positive") - F.avg("negative")).alias("neutral_proportion"),
        F.avg("negative").alias("mean_negative"),
        F.avg("score").alias("mean_score"),
        F.max("positive").alias("max_positive"),
        F.max("negative").alias("max_negative"),
        F.stddev_pop("score").alias("score_deviation"),
        F.avg(F.col("score") * F.exp(-F.col("age_hours") / 12)).alias("decayed_score"),
        weighted.alias("weighted_score"),
        (weighted * (F.count_if(F.col("weight") > 0) / n)).alias("holding_score"),
        n.alias("abnormal_volume"),
        F.avg((F.col("content_hash") != "").cast("double")).alias("hashed_share"),
        F.avg(F.col("score") * F.when(F.col("fixture"), 0.5).otherwise(1.0)).alias("trusted_score"),
        F.stddev_pop("score").alias("disagreement"),
        F.avg("sector_share").alias("sector_share"),
        F.count_if("macro").alias("macro_count"),
        F.lit(1.0).alias("coverage"),
        F.min("age_hours").alias("freshness_hours"),
        *(F.avg(F.get("embedding", F.lit(i))).alias(f"embedding_{i}") for i in range(embedding_dims)),
    )
    return out


def zero_filled(panel: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """panel with found's columns, 0 where there is no row: in panels no news is 0, not null."""
    values = [c for c in found.columns if c not in keys]
    joined = panel.join(found.withColumn("_has", F.lit(1)), keys, "left")
    return joined.select(*panel.columns, *(F.coalesce(F.col(c), F.lit(0).cast(found.schema[c].dataType)).alias(c) for c in values), F.when(F.col("_has").isNull(), "empty").otherwise("ok").alias("coverage_status"))


def eligible(articles: DataFrame, published: str, start: Column, cutoff: Column) -> DataFrame:
    return articles.where((F.col(published) > 0) & (F.col(published) >= start) & (F.col(published) <= cutoff))


def control_counts(articles: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct content over rows, distinct publishers that have a name."""
    n = F.count("*")
    return articles.groupBy(*keys).agg(n.alias("news_rows"), F.lit(1).cast("long").alias("has_news"), F.try_divide(F.count_distinct("content_hash"), n).alias("distinct_share"), F.count_distinct(F.when(F.trim("publisher") != "", F.col("publisher"))).alias("publishers"))


def filing_counts(filings: DataFrame, keys: list[str], sentiment: str | None = None) -> DataFrame:
    """Filings by form, distinct issuers and, with a sentiment column, its mean (0 where no filing has one)."""
    form = F.col("form")
    known = form.startswith("8-K") | form.startswith("10-Q") | form.startswith("10-K")
    aggs = [
        F.count("*").alias("filings"), F.count_distinct("issuer").alias("issuers"), F.count_if(form.startswith("8-K")).alias("n_8k"),
        F.count_if(form.startswith("10-Q")).alias("n_10q"), F.count_if(form.startswith("10-K")).alias("n_10k"), F.count_if(~known).alias("n_other"),
    ]
    if sentiment:
        aggs.append(F.coalesce(F.avg(sentiment), F.lit(0.0)).alias("mean_sentiment"))
    return filings.groupBy(*keys).agg(*aggs)


def insider_counts(filings: DataFrame, keys: list[str]) -> DataFrame:
    form = F.col("form")
    return filings.groupBy(*keys).agg(F.count_if(form == "4").alias("form4"), F.count_if(form.isin("3", "5")).alias("form3_5"), F.count_if(form.startswith("SCHEDULE 13") | form.startswith("SC 13")).alias("schedule13"), F.count_distinct("issuer").alias("issuers"))


def choose_facts(facts: DataFrame, keys: list[str]) -> DataFrame:
    """One fact for each key: lowest priority of its tag, then one with a frame, then the latest end, then the first."""
    from tidewright.session import keep_first

    return keep_first(facts, keys, [F.asc("priority"), F.desc(F.col("frame").isNotNull()), F.desc("end"), F.asc("seq")])


def snapshot_changes(facts: DataFrame, issuer: str, order: list[str], values: list[str]) -> DataFrame:
    """Clipped change of each value against the issuer's filing before."""
    from pyspark.sql import Window

    from tidewright.functions.clean import clipped_change

    w = Window.partitionBy(issuer).orderBy(*order)
    return facts.select("*", *(clipped_change(F.col(v), F.lag(v).over(w)).alias(f"{v}_change") for v in values))


def embedding_means(rows: DataFrame, keys: list[str], dims: int) -> DataFrame:
    """Means of embeddings, each content once; symbols counted before contents are made distinct."""
    from tidewright.session import keep_first

    symbols = rows.groupBy(*keys).agg(F.count_distinct("symbol").alias("symbols"))
    once = keep_first(rows, [*keys, "content_hash"], ["seq"])
    means = once.groupBy(*keys).agg(F.count("*").alias("contents"), *(F.avg(F.get("embedding", F.lit(i)).cast("double")).alias(f"mean_{i}") for i in range(dims)), F.avg("sentiment").alias("sentiment_mean"), F.stddev_pop("sentiment").alias("sentiment_deviation"), F.min("sentiment").alias("sentiment_min"), F.max("sentiment").alias("sentiment_max"))
    return symbols.join(means, keys)


def coverage_audit(rows: DataFrame) -> DataFrame:
    """One row over (id, date, sector, content_hash): how well sectors and dates are covered."""
    per_date = rows.groupBy("date").agg(F.count_distinct("sector").alias("k")).agg(F.count_if(F.col("k") >= 3).alias("dates_3"), F.count_if(F.col("k") >= 8).alias("dates_8"), F.max("k").alias("most_sectors"))
    spread = rows.groupBy("content_hash").agg(F.count_distinct("date").alias("k")).agg(F.count_if(F.col("k") > 1).alias("hashes_in_many_sessions"))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).crossJoin(per_date).crossJoin(spread)


def sector_map(rows: DataFrame, keys: list[str], sector: str, weight: str) -> DataFrame:
    """Exposures as one string of sector=weight, largest first."""
    pairs = F.sort_array(F.collect_list(F.struct(F.round(weight, 6).alias("w"), F.col(sector).alias("s"))), asc=False)
    return rows.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["s"], p["w"].cast("decimal(20,6)").cast("string"))), ";").alias("exposures"))
