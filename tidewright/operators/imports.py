"""Imports of news and filings: every row gets an outcome, and rows that pass become articles of sectors.

Sessions are assigned by calendars, sectors by holdings that were known before; of articles that are the same, the one
that arrived first stays. An import is two tables: the outcomes of all rows, whose counts are its ledger, and articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators import asof
from tidewright.operators.articles import utc_seconds
from tidewright.session import keep_first

OK = "ok"
# What is known of an article's instant; the forms of filings that count.
DATE_ONLY, PREOPEN, ACCEPTED = "yahoo_report_date_only", "yahoo_date_publish_utc_preopen_verified", "sec_acceptance_utc"
FORMS = ("8-K", "8-K/A", "10-K", "10-K/A", "10-Q", "10-Q/A", "6-K", "20-F", "40-F")


def valid_day(c: Column) -> Column:
    """The date of a text that is exactly YYYY-MM-DD, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def text_of(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def sectors_at(rows: DataFrame, spells: DataFrame, on: str) -> DataFrame:
    """(symbol, on, sectors): the sectors, sorted, in which rows' symbols have a spell that was available before the day and holds on it.

    spells: symbol, sector, available_from, effective_from, effective_to. Each (symbol, day) is settled once.
    """
    days = rows.select("symbol", on).where(F.col(on).isNotNull()).distinct()
    held = days.join(spells, "symbol").where((F.col("available_from") < F.col(on)) & (F.col("effective_from") <= F.col(on)) & (F.col("effective_to") >= F.col(on)))
    return held.groupBy("symbol", on).agg(F.array_sort(F.collect_set("sector")).alias("sectors"))


def with_sectors(rows: DataFrame, spells: DataFrame, on: str) -> DataFrame:
    found = sectors_at(rows, spells, on).select(F.col("symbol").alias("_symbol"), F.col(on).alias("_on"), "sectors")
    return rows.join(found, (F.col("symbol") == F.col("_symbol")) & (F.col(on) == F.col("_on")), "left").drop("_symbol", "_on")


def ledger(settled: DataFrame) -> DataFrame:
    """Rows by outcome."""
    return settled.groupBy("outcome").agg(F.count("*").alias("n"))


def dated_news(rows: DataFrame, spells: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """rows (seq, uuid, symbol, title, publisher, report_date, link, article) with outcome, trading_date and sectors.

    A report has a date without a time, and belongs to the first session after it. Outcomes: invalid_date,
    outside_range, no_session, not_member, empty, ok.
    """
    dated = rows.withColumn("_dated", valid_day(F.col("report_date")))
    placed = asof.next_session(dated, sessions, F.col("_dated"), inclusive=False).withColumnRenamed("session", "trading_date").drop("previous_session")
    held = with_sectors(placed, spells, "trading_date")
    body = F.concat(text_of("title"), text_of("article"))
    outcome = (
        F.when(F.col("_dated").isNull(), "invalid_date").when(~F.col("_dated").between(start, end), "outside_range")
        .when(F.col("trading_date").isNull() | (F.col("trading_date") > F.lit(end).cast("date")), "no_session").when(F.col("sectors").isNull(), "not_member").when(body == "", "empty").otherwise(OK)
    )
    return held.withColumn("outcome", outcome).drop("_dated")


def dated_articles(settled: DataFrame) -> DataFrame:
    """Articles of dated_news: one for each id, symbol, sector and session, the first by seq."""
    good = settled.where(F.col("outcome") == OK)
    named = F.sha2(F.concat_ws("|", "symbol", "report_date", text_of("title"), text_of("link")), 256)
    stable = F.when(text_of("uuid") == "", named).otherwise(F.col("uuid"))
    text = F.when(text_of("article") == "", F.col("title")).otherwise(F.concat(text_of("title"), F.lit("\n\n"), F.col("article")))
    each = good.select("seq", stable.alias("_id"), "symbol", F.explode("sectors").alias("sector"), "trading_date", "report_date", text.alias("text"), "link", "publisher")
    once = keep_first(each, ["_id", "symbol", "sector", "trading_date"], ["seq"])
    return once.select(
        F.concat(F.lit("yahoo:"), "_id", F.lit(":"), "symbol").alias("article_id"), F.concat("report_date", F.lit(" 00:00:00")).alias("published_at"), F.lit(DATE_ONLY).alias("timestamp_quality"),
        "trading_date", "sector", "symbol", "text", F.col("link").alias("url"), "publisher", F.sha2("text", 256).alias("content_hash"),
    )


def timed_news(rows: DataFrame, spells: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """rows (seq, date_publish, date_download, title, maintext, mentioned_companies, url, news_outlet, source_domain), an
    outcome for each, with available_s, trading_date, and found: (symbol, sector) pairs of the companies it mentions.

    News is available when published or downloaded, whichever is later, both as UTC; up to the pre-open cutoff it
    belongs to that day's session, later to the next. Outcomes: invalid_date, outside_range, no_session, empty,
    no_ticker, not_member, ok.
    """
    day = lambda c: valid_day(F.substring(c, 1, 10))
    published = F.when(day("date_publish").isNotNull(), utc_seconds(F.col("date_publish")))
    loaded = F.when(text_of("date_download") == "", published).when(day("date_download").isNotNull(), utc_seconds(F.col("date_download")))
    timed = rows.withColumn("available_s", F.when(published.isNotNull() & loaded.isNotNull(), F.greatest(published, loaded)))
    timed = timed.withColumn("_dated", clean.epoch_date(F.col("available_s")))
    placed = asof.cutoff_session(timed, sessions, F.col("available_s") * 1000, F.col("_dated"), clean.cutoff_ms).withColumnRenamed("session", "trading_date").drop("previous_session")
    named = placed.withColumn("companies", F.array_sort(F.array_distinct(F.filter(F.coalesce("mentioned_companies", F.array().cast("array<string>")), lambda x: x.isNotNull()))))
    pairs = named.select("seq", F.explode("companies").alias("symbol"), "trading_date")
    found = with_sectors(pairs, spells, "trading_date").select("seq", "symbol", F.explode("sectors").alias("sector"))
    found = found.groupBy("seq").agg(F.array_sort(F.collect_set(F.struct("symbol", "sector"))).alias("found"))
    held = named.join(found, "seq", "left")
    empty = (F.trim(text_of("title")) == "") & (F.trim(text_of("maintext")) == "")
    outcome = (
        F.when(F.col("available_s").isNull(), "invalid_date").when(~F.col("_dated").between(start, end), "outside_range")
        .when(F.col("trading_date").isNull() | (F.col("trading_date") > F.lit(end).cast("date")), "no_session").when(empty, "empty").when(F.size("companies") == 0, "no_ticker")
        .when(F.col("found").isNull(), "not_member").otherwise(OK)
    )
    return held.withColumn("outcome", outcome).drop("_dated", "companies")


def timed_articles(settled: DataFrame) -> DataFrame:
    """Articles of timed_news: one for each sector, content and session, the first by seq and then by symbol."""
    title, body = F.trim(text_of("title")), F.trim(text_of("maintext"))
    text = F.when(body == "", title).otherwise(F.concat(title, F.lit("\n\n"), body))
    stable = F.sha2(F.concat_ws("|", text_of("url"), "date_publish", title), 256)
    publisher = F.when(text_of("news_outlet") == "", F.col("source_domain")).otherwise(F.col("news_outlet"))
    good = settled.where(F.col("outcome") == OK)
    each = good.select("seq", stable.alias("_id"), F.inline("found"), "trading_date", "available_s", text.alias("text"), "url", publisher.alias("publisher"))
    once = keep_first(each.withColumn("content_hash", F.sha2("text", 256)), ["sector", "content_hash", "trading_date"], ["seq", "symbol"])
    return once.select(F.concat(F.lit("luckycat:"), "_id", F.lit(":"), "symbol").alias("article_id"), "available_s", F.lit(PREOPEN).alias("timestamp_quality"), "trading_date", "sector", "symbol", "text", "url", "publisher", "content_hash")


def fund_news(rows: DataFrame, holdings: DataFrame, sessions: DataFrame, start: str, end: str) -> DataFrame:
    """rows (seq, published_raw, symbol, title, summary, url, publisher) of one fund's archive, with outcome and provenance.

    An article belongs to the first session whose pre-open cutoff it meets; its symbol has to be in the last snapshot of
    holdings (snapshot, symbol) before that session; a session past the last snapshot is extrapolated. Articles with the
    same address, or content where there is none, count once, the first by seq of those that are members. Outcomes:
    missing_timestamp, skipped, not_member, duplicate, ok.
    """
    raw = F.trim(text_of("published_raw"))
    texts = {c: F.trim(text_of(c)) for c in ("symbol", "title", "summary", "url", "publisher")}
    timed = rows.withColumns(texts).withColumn("published_s", F.when(F.length(raw) >= 10, utc_seconds(raw)))
    day = clean.epoch_date(F.col("published_s"))
    placed = asof.cutoff_session(timed, sessions, F.col("published_s") * 1000, day, clean.cutoff_ms).withColumnRenamed("session", "trading_date").drop("previous_session")
    days = placed.select("trading_date").where("trading_date is not null").distinct()
    governing = asof.asof(days, holdings.select("snapshot").distinct(), "trading_date", "snapshot", [], [], strict=True)
    governed = placed.join(F.broadcast(governing.withColumnRenamed("trading_date", "_dated")), F.col("trading_date") == F.col("_dated"), "left").drop("_dated")
    members = holdings.select(F.col("snapshot").alias("_snapshot"), F.col("symbol").alias("_symbol"), F.lit(True).alias("_held")).distinct()
    held = governed.join(members, (F.col("snapshot") == F.col("_snapshot")) & (F.col("symbol") == F.col("_symbol")), "left").drop("_snapshot", "_symbol")
    content = F.sha2(F.lower(F.concat("title", F.lit(" "), "summary")), 256)
    held = held.withColumn("content_hash", content).withColumn("identity", F.when(F.col("url") == "", F.col("content_hash")).otherwise(F.col("url")))
    skipped = (F.col("symbol") == "") | (F.col("title") == "") | F.col("trading_date").isNull() | ~F.col("trading_date").between(start, end)
    first = F.when(F.col("published_s").isNull(), "missing_timestamp").when(skipped, "skipped").when(F.col("_held").isNull(), "not_member").otherwise(OK)
    held = held.withColumn("outcome", first).drop("_held")
    firsts = held.where(F.col("outcome") == OK).groupBy(F.col("identity").alias("_identity")).agg(F.min("seq").alias("_first"))
    newest = holdings.agg(F.max("snapshot")).first()[0]
    told = held.join(firsts, (F.col("identity") == F.col("_identity")) & (F.col("outcome") == OK), "left")
    told = told.withColumn("outcome", F.when(F.col("seq") > F.col("_first"), "duplicate").otherwise(F.col("outcome"))).drop("_identity", "_first")
    named = F.sha2(F.concat_ws("|", "symbol", F.col("trading_date").cast("string"), "identity"), 256)
    return told.withColumns({"article_id": F.when(F.col("outcome") == OK, named), "cutoff_ms": clean.cutoff_ms(F.col("trading_date")), "extrapolated": F.col("trading_date") > F.lit(newest)})


def filing_events(filings: DataFrame, spells: DataFrame, sessions: DataFrame, start: str, end: str, preopen: bool = False) -> DataFrame:
    """filings (cik, sector, symbol, form, acceptance, accession, document) with outcome, and the event that each becomes.

    By day: a filing belongs to the first session after the date of its acceptance, which is in the range and on which
    the symbol is a member. Pre-open: one that is accepted after a session's close and by the next one's cutoff, which is
    in the range and sees the symbol a member, belongs to the session before. Outcomes: form, date, not_member,
    no_session, ok.
    """
    good = (F.length("acceptance") >= 20) & (F.substring("acceptance", 5, 1) == "-") & (F.substring("acceptance", 8, 1) == "-")
    source = F.when(good, F.substring("acceptance", 1, 10).try_cast("date"))
    dated = filings.withColumn("source_date", source)
    if preopen:
        ms = F.when(F.col("source_date").isNotNull(), utc_seconds(F.regexp_replace(F.substring("acceptance", 1, 19), "T", " "))) * 1000
        timed = dated.withColumn("_ms", ms)
        placed = asof.cutoff_session(timed, sessions, F.col("_ms"), F.col("source_date"), clean.cutoff_ms)
        after_close = F.col("_ms") > clean.close_ms(F.col("previous_session"))
        placed = placed.withColumn("_member_on", F.when(after_close, F.col("session"))).withColumn("trading_date", F.col("previous_session")).drop("_ms", "session", "previous_session")
    else:
        placed = asof.next_session(dated, sessions, F.col("source_date"), inclusive=False).withColumn("_member_on", F.col("source_date")).withColumnRenamed("session", "trading_date").drop("previous_session")
    held = with_sectors(placed, spells, "_member_on")
    member = F.coalesce(F.array_contains("sectors", F.col("sector")), F.lit(False))
    outcome = (
        F.when(~F.coalesce(F.col("form").isin(*FORMS), F.lit(False)), "form").when(F.col("_member_on").isNull() | ~F.col("_member_on").between(start, end), "date")
        .when(~member, "not_member").when(F.col("trading_date").isNull(), "no_session").otherwise(OK)
    )
    key = F.sha2(F.concat_ws("|", "sector", "symbol", "accession"), 256)
    return held.withColumns(
        {
            "outcome": outcome, "article_id": F.concat(F.lit("sec:sha256:"), key), "published_at": F.concat(F.substring("acceptance", 1, 19), F.lit("Z")), "timestamp_quality": F.lit(ACCEPTED),
            "title": F.concat_ws(" ", F.lit("SEC"), "form", "document"), "url": clean.archive_path(F.col("cik"), F.col("accession"), F.col("document")), "content_hash": key,
        }
    ).drop("sectors", "_member_on")
