"""Articles of sectors: the story fixture with its known outcome, and small archives."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import articles
from tidewright.sources import readers


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame([(date(2019, 1, d),) for d in (2, 3, 4, 7, 8)], "session date")


def test_story_versions_corrections_withdrawals_and_membership(spark, sessions):
    def told(story, take, at, subjects, kind="STORY"):
        return f'{{"id":"{story}","takeSequence":{take},"versionCreated":"{at}","messageType":"{kind}","headline":"{story} {take}","body":"b","subjects":[{subjects}]}}'

    lines = [
        told("story-1", 1, "2019-01-02T15:00:00Z", '"A","ZZ"'), told("story-1", 2, "2019-01-02T22:00:00Z", '"A"'), told("story-1", 3, "2019-01-03T15:00:00Z", "", "WITHDRAWN"),
        told("story-2", 1, "2019-01-03T14:00:00Z", '"A"'), told("story-2", 2, "2019-01-03T20:59:00Z", '"A"'), told("story-3", 1, "2019-01-07T15:00:00Z", '"B"'),
        told("", 1, "2019-01-03T14:00:00Z", '"A"'), told("story-4", 1, "yesterday", '"A"'), told("story-5", 1, "2019-01-20T14:00:00Z", '"A"'),
    ]
    entities = spark.createDataFrame([("A", "AAA"), ("B", "BBB")], "subject string, symbol string")
    held = spark.createDataFrame([(date(2018, 12, 31), "AAA", "XLB"), (date(2018, 12, 31), "BBB", "XLB"), (date(2019, 1, 4), "AAA", "XLB")], "snapshot date, symbol string, sector string")
    versions = readers.stories(spark.createDataFrame([(x,) for x in lines], "value string"))
    # a repeated line changes nothing
    found = articles.story_articles(versions.unionByName(versions.limit(2)), entities, held, sessions, "2019-01-02", "2019-01-07").orderBy("article_id").collect()
    assert [(r.article_id, r.trading_date, r.sector, r.title) for r in found] == [("mrn:story-1:1:AAA", date(2019, 1, 2), "XLB", "story-1 1"), ("mrn:story-2:2:AAA", date(2019, 1, 3), "XLB", "story-2 2")]
    assert articles.story_articles(versions.limit(0), entities, held, sessions, "2019-01-02", "2019-01-07").count() == 0


def test_archive_rows_sessions_repair_and_equal_contents(spark, sessions):
    held = spark.createDataFrame([(date(2019, 1, 2), "AAA", "XLB"), (date(2019, 1, 2), "AAA", "XLK")], "snapshot date, symbol string, sector string")
    rows = [
        ("2019-01-03 02:00:00 UTC", "AAA", "early", "s"), ("2019-01-03 12:00:00 UTC", "AAA", "late", "s"), ("2019-01-03", " AAA ", "dated", None), ("2019-01-04", "AAA", "DATED", ""),
        ("2019-01-02", "AAA", "on the day of the snapshot", ""), ("2019-01-03", "CCC", "not held", ""), ("never", "AAA", "no date", ""), (None, "AAA", "null", ""), ("2019-01-03", "AAA", " ", ""), ("2019-02-03", "AAA", "past the calendar", ""),
    ]
    rows = spark.createDataFrame([(*r, None, "p") for r in rows], "published_raw string, symbol string, title string, summary string, url string, publisher string")
    for repair, early in ((False, 4), (True, 3)):
        found = articles.archive_articles(rows, held, sessions, "2019-01-01", "2019-12-31", repair)
        got = {(r.title, r.sector): (r.trading_date.day, r.timestamp_quality) for r in found.collect()}
        timed = articles.REPAIRED if repair else articles.UNVERIFIED
        assert got == {(t, x): v for x in ("XLB", "XLK") for t, v in {"early": (early, timed), "late": (4, timed), "dated": (4, articles.DATE_ONLY)}.items()}
        assert found.where("not extrapolated").isEmpty()
    at = spark.range(1).select(articles.utc_seconds(F.lit("1970-01-02 01:01:01")).alias("a"), articles.utc_seconds(F.lit("x")).alias("b")).first()
    assert (at.a, at.b) == (90061, None)


def test_long_pages_are_not_gathered_in_batches_of_arrow(spark):
    df = spark.createDataFrame([(1, "<p>Item 1 a</p><p>item 9.01 b</p>"), (2, None)], "id int, html string")
    found = df.select("id", text.sections(text.visible_text(F.col("html"))).alias("t"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert {r.id: r.t for r in found.collect()} == {1: "Item 1 a", 2: ""}


def test_only_words_that_make_ids_are_cut_up():
    pieces, seen = text.WordPieces(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "##b"]), []
    pieces.word = lambda w: seen.append(w) or (4, 5)
    assert pieces.encode("ab " * 1000, 7) == ([2, 4, 5, 4, 5, 4, 3], [1] * 7) and len(seen) == 3
    assert pieces.encode(None, 4) == ([2, 3, 0, 0], [1, 1, 0, 0])
