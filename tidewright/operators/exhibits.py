"""Exhibits of filings: links to them in the filings' pages, and the articles that the linked pages make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import resolved, sections, visible_text

LINK = r"""(?is)href\s*=\s*(["'])(.*?)\1"""


def is_exhibit_99(href: Column) -> Column:
    """Whether a link names an exhibit 99: by its words, or by 99, a sign and a digit."""
    low = F.lower(href)
    return low.contains("ex-99") | low.contains("exhibit99") | low.contains("exhibit-99") | low.rlike(r"99[._-][0-9]")


def exhibit_links(filings: DataFrame) -> DataFrame:
    """filings (article_id, published_at, trading_date, sector, symbol, form, url, html) -> a row for each exhibit an 8-K links to.

    A filing counts an address once, where it stands first. exhibit_name is what follows the last slash of the link.
    """
    found = filings.where(F.col("form").startswith("8-K") & F.col("html").isNotNull())
    kept = ["article_id", "published_at", "trading_date", "sector", "symbol", F.col("url").alias("primary_url")]
    each = found.select(*kept, F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(2))).alias("position", "href"))
    each = each.where((F.col("href") != "") & ~F.col("href").startswith("#") & is_exhibit_99(F.col("href")))
    each = each.withColumn("exhibit_url", resolved(F.col("primary_url"), F.col("href")))
    first = F.min_by(F.struct("published_at", "trading_date", "sector", "symbol", "primary_url", "href"), "position")
    once = each.groupBy("article_id", "exhibit_url").agg(first.alias("f")).select("article_id", "exhibit_url", "f.*")
    return once.withColumn("exhibit_name", F.regexp_extract("href", r"([^/]*)$", 1)).drop("href")


def exhibit_articles(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links joined to pages (url, html): an article for each, or why there is none (outcome: written, missing, empty).

    The text is what a page shows, cut as filings' texts are; ids and hashes depend on address and text alone.
    """
    met = links.join(pages.select(F.col("url").alias("exhibit_url"), "html", F.lit(True).alias("there")), "exhibit_url", "left")
    text = met.withColumn("text", F.when(F.col("there"), visible_text(F.col("html"))))
    outcome = F.when(F.col("there").isNull(), "missing").when(~F.col("text").rlike("[A-Za-z0-9]"), "empty").otherwise("written")
    named = text.withColumn("outcome", outcome)
    done = F.col("outcome") == "written"
    return named.select(
        F.concat(F.lit("sec-exhibit:"), F.sha2("exhibit_url", 256)).alias("article_id"), F.col("article_id").alias("filing_id"), "published_at", "trading_date", "sector", "symbol",
        F.col("exhibit_name").alias("title"), F.col("exhibit_url").alias("url"), F.lit("SEC").alias("publisher"), F.when(done, F.col("text")).alias("text"), F.when(done, F.sha2("text", 256)).alias("content_hash"), "outcome",
    )


def filing_articles(filings: DataFrame) -> DataFrame:
    """The text of each 8-K itself: its item sections but for exhibits' lists; filings without text go."""
    found = filings.where(F.col("form").startswith("8-K") & F.col("html").isNotNull())
    texts = found.withColumn("text", sections(visible_text(F.col("html")))).where("text <> ''")
    return texts.select("article_id", "published_at", "trading_date", "sector", "symbol", "form", "url", "text", F.sha2("text", 256).alias("content_hash"))


def outcomes(articles: DataFrame) -> DataFrame:
    """How many links were written, missing and empty: the ledger."""
    return articles.groupBy("outcome").agg(F.count("*").alias("n"), F.count_distinct("filing_id").alias("filings"))
