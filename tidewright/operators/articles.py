"""Articles by sector: from rows of a news archive, and from versions of stories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators import asof

# What is known of an article's instant.
DATE_ONLY, UNVERIFIED, REPAIRED, STORY = "fnspid_date_only", "fnspid_utc_unverified", "fnspid_inverse_est_edt_candidate", "mrn_version_created_utc"


def utc_seconds(c: Column) -> Column:
    """Seconds since 1970 of YYYY-MM-DD or YYYY-MM-DD HH:MM:SS as UTC, whatever the session's zone; null without a date."""
    days = F.datediff(F.substring(c, 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    part = lambda at: F.coalesce(F.substring(c, at, 2).try_cast("long"), F.lit(0))
    return days * 86_400 + part(12) * 3600 + part(15) * 60 + part(18)


def archive_articles(rows: DataFrame, holdings: DataFrame, sessions: DataFrame, start: str, end: str, repair: bool = False) -> DataFrame:
    """rows (published_raw, symbol, title, summary, url, publisher) -> one article for each sector and content.

    An article belongs to the first session after its date. With repair, one that has a time of day is moved by twice
    New York's distance from UTC, eight or ten hours, which undoes a conversion made in the wrong direction, and belongs
    to the first session whose pre-open cutoff it meets. Sectors are those of the latest snapshot of holdings (snapshot,
    symbol, sector) before the article's date; extrapolated says that no later one is known. Of equal contents in a
    sector the earliest session stays, then the earliest date, then the least article_id. Rows without a date, symbol,
    title or sector go, as do those past the calendar or outside start to end.
    """
    raw, text = F.trim("published_raw"), [F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ("symbol", "title", "summary", "url", "publisher")]
    plain = (F.length(raw) < 19) | (F.substring(raw, 11, 1) != " ") | (F.substring(raw, 12, 8) == "00:00:00")
    dated = rows.select(*text, raw.alias("published_raw"), F.substring(raw, 1, 10).try_cast("date").alias("source_date"), utc_seconds(raw).alias("_s"), plain.alias("_plain"))
    dated = dated.where("source_date is not null and symbol <> '' and title <> ''")
    day, mended = F.col("source_date"), ~F.col("_plain") & F.lit(repair)
    dated = dated.withColumn("published_s", F.col("_s") + F.when(mended, clean.new_york_offset(day) * 7200).otherwise(0))
    wanted = F.when(mended & (F.col("published_s") * 1000 <= clean.cutoff_ms(day)), day).otherwise(F.date_add(day, 1))
    quality = F.when(F.col("_plain"), DATE_ONLY).when(mended, REPAIRED).otherwise(UNVERIFIED)
    placed = asof.next_session(dated.withColumn("timestamp_quality", quality), sessions, wanted).withColumnRenamed("session", "trading_date")
    placed = placed.where(F.col("trading_date").between(start, end)).withColumn("content_hash", F.sha2(F.lower(F.concat_ws(" ", "title", "summary")), 256))
    newest = holdings.agg(F.max("snapshot").alias("snapshot")).withColumn("_newest", F.lit(True))
    held = asof.snapshot_members(placed.drop("_s", "_plain", "previous_session"), holdings.select("snapshot", "symbol", "sector").distinct(), "source_date").join(F.broadcast(newest), "snapshot", "left")
    named = held.withColumns({"extrapolated": F.coalesce("_newest", F.lit(False)), "article_id": F.sha2(F.concat_ws("|", "sector", "symbol", "trading_date", "content_hash"), 256)})
    rest = ["article_id", "published_raw", "published_s", "timestamp_quality", "source_date", "trading_date", "symbol", "title", "summary", "url", "publisher", "extrapolated"]
    first = F.min_by(F.struct(*rest), F.struct("trading_date", "source_date", "article_id", "published_raw", "url", "publisher"))
    return named.groupBy("sector", "content_hash").agg(first.alias("_a")).select("_a.*", "sector", "content_hash")


def archive_counts(articles: DataFrame) -> DataFrame:
    """Articles by sector and quality, and how many lie past the last snapshot: an import's ledger."""
    return articles.groupBy("sector", "timestamp_quality").agg(F.count("*").alias("n"), F.count_if("extrapolated").alias("extrapolated"))


def story_articles(versions: DataFrame, entities: DataFrame, holdings: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """versions (as of readers.stories) -> the version of each story, sector, symbol and session that holds in the end.

    A version belongs to its day's session if made at or before the close, else to the next. Versions are ordered by
    versionCreated, then takeSequence; of those equal in both one stays. entities: subject, symbol. A withdrawal erases
    its symbols of the session, or all symbols its story has had if it names none that is known; a later version of the
    session sets them again. Sectors are those of the latest snapshot of holdings before the session. Versions without
    an id or a readable instant go, as do those outside start to end.
    """
    made = F.unix_seconds(clean.iso_instant(F.col("versionCreated")))
    take = F.coalesce(F.col("takeSequence").cast("long"), F.lit(0))
    gone = F.coalesce(clean.withdrawn(F.col("messageType"), F.col("pubStatus")), F.lit(False))
    body = F.struct(gone.alias("withdrawn"), "altId", "firstCreated", "versionCreated", "messageType", "pubStatus", "provider", "headline", "body", "url", "subjects")
    one = versions.select("id", made.alias("published_s"), take.alias("take"), body.alias("v")).where("id <> '' and published_s is not null")
    one = one.groupBy("id", "published_s", "take").agg(F.max("v").alias("v"))
    subjects = one.select("id", "published_s", "take", "v.withdrawn", F.explode_outer("v.subjects").alias("subject"))
    found = subjects.join(entities.select("subject", "symbol").distinct(), "subject", "left").groupBy("id", "published_s", "take", "withdrawn").agg(F.collect_set("symbol").alias("symbols"))
    known = found.where("not withdrawn").select("id", F.explode("symbols").alias("symbol")).distinct()
    named = found.select("id", "published_s", "take", "withdrawn", F.explode("symbols").alias("symbol"))
    broad = found.where("withdrawn and size(symbols) = 0").drop("symbols").join(known, "id")
    day = clean.epoch_date(F.col("published_s"))
    placed = asof.cutoff_session(named.unionByName(broad), sessions, F.col("published_s") * 1000, day, clean.close_ms).drop("previous_session")
    placed = placed.withColumnRenamed("session", "trading_date").where(F.col("trading_date").between(start, end))
    held = asof.snapshot_members(placed, holdings.select("snapshot", "symbol", "sector").distinct(), "trading_date")
    last = held.groupBy("id", "sector", "symbol", "trading_date").agg(F.max(F.struct("published_s", "take", "withdrawn")).alias("_l"))
    kept = last.where("not _l.withdrawn").select("id", "sector", "symbol", "trading_date", "_l.published_s", "_l.take")
    out = kept.join(one, ["id", "published_s", "take"])
    hashed = F.sha2(F.concat_ws("|", "id", "v.versionCreated", F.col("take").cast("string"), F.coalesce("v.headline", F.lit("")), F.coalesce("v.body", F.lit(""))), 256)
    name = F.concat(F.lit("mrn:"), F.concat_ws(":", "id", "take", "symbol"))
    return out.select(name.alias("article_id"), "id", "take", "published_s", F.lit(STORY).alias("timestamp_quality"), "trading_date", "sector", "symbol", F.col("v.headline").alias("title"), F.col("v.body").alias("summary"), "v.url", F.col("v.provider").alias("publisher"), hashed.alias("content_hash"))
