"""Guards and the sector panel on small tables: nulls, broken lines, empty tables, incomplete sessions."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewright.plans import api, panels, sector_panel
from tidewright.sources import readers


def test_lines_without_fields_give_nulls(spark):
    lines = spark.createDataFrame([("a , b",), (None,), ("",)], "value string")
    assert sorted(map(repr, map(tuple, readers.plain_list(lines, ["x", "y"]).collect()))) == sorted(map(repr, [("a", "b"), (None, None), ("", None)]))


def test_broken_metadata_is_incomplete(spark):
    rows = spark.createDataFrame([(1, "{"), (2, None), (3, '{"model_id": "m", "target_symbol": "s", "feature_version": "f"}'), (4, '{"model_id": "m", "target_symbol": "s", "feature_version": "f", "features": ["a"]}')], "id int, value string")
    assert {x.id: x.fault for x in readers.model_metadata(rows).collect()} == {1: "incomplete", 2: "incomplete", 3: "no features", 4: None}


def test_messages_that_are_none(spark):
    rows = spark.createDataFrame([(1, None), (2, "["), (3, '{"type": "heartbeat", "sequence": 1}'), (4, '{"type": "market_update", "sequence": 1}')], "id int, value string")
    assert {x.id: x.kind for x in readers.messages(rows).collect()} == {1: None, 2: None, 3: "heartbeat", 4: None}


def test_requests(spark):
    rows = spark.createDataFrame([("1m", 1, None), (None, 1, None), ("5m", 0, None), ("5m", None, None), ("1m", 2000, "2024-1-1")], "i string, n int, d string")
    found = [x.f for x in rows.select(api.request_fault(F.col("i"), F.col("n"), F.col("d")).alias("f")).collect()]
    assert found == [None, "INVALID_INTERVAL", "INVALID_LIMIT", "INVALID_LIMIT", "INVALID_DATE"]


def test_datasets(spark):
    rows = spark.createDataFrame([(i, f"2024-01-{i + 10}", i % 2, 0.5) for i in range(10)], "seq int, date string, label int, x double")
    assert panels.dataset_faults(rows, "date", "label", "seq").first().usable
    assert not panels.dataset_faults(rows.limit(9), "date", "label", "seq").first().usable
    assert panels.dataset_faults(rows.limit(0), "date", "label", "seq").first().rows == 0
    assert panels.dataset_faults(rows.unionByName(rows.where("seq = 3").withColumn("seq", F.lit(99))), "date", "label", "seq").first().bad_keys == 1
    with pytest.raises(ValueError):
        panels.dataset_faults(rows, "date", "target", "seq")


def bars(spark, days, lost=None):
    first = datetime.date(2024, 1, 1)
    rows = [(c, first + datetime.timedelta(i), 10.0 + (i * (k + 3)) % 7, 20.0, 5.0, 10.0 + (i * (k + 5)) % 11, 1.0 + i) for k, c in enumerate(sector_panel.SECTORS + sector_panel.CONTEXT) for i in range(days) if (c, i) != lost]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_live_rows_need_history_and_every_symbol(spark):
    assert {x.date.isoformat() for x in sector_panel.live_rows(bars(spark, 26)).select("date").collect()} == {"2024-01-25", "2024-01-26"}
    assert {x.date.isoformat() for x in sector_panel.live_rows(bars(spark, 26, ("GLD", 25))).select("date").collect()} == {"2024-01-25"}
    assert sector_panel.live_rows(bars(spark, 26).limit(0)).count() == 0


def test_panels_look_no_further_than_their_label(spark):
    whole = bars(spark, 64)
    rows = {x.date: x for x in sector_panel.panel(whole, "open-gap-direction").collect()}
    assert len(rows) == 3 * 11
    # the session's own close, high, low and volume aren't known at its open
    at = "2024-03-02|XLK"
    changed = whole.withColumns({c: F.when(F.col("date") == "2024-03-02", F.col(c) * 1.5).otherwise(F.col(c)) for c in ("close", "high", "volume")})
    again = {x.date: x for x in sector_panel.panel(changed, "open-gap-direction").collect()}
    assert rows[at][1:-1] == again[at][1:-1]


def test_panel_refuses_what_is_not_finite(spark):
    spoilt = bars(spark, 64).withColumn("close", F.when((F.col("symbol") == "XLK") & (F.col("date") == "2024-02-20"), 0.0).otherwise(F.col("close")))
    with pytest.raises(Exception, match="finite"):
        sector_panel.panel(spoilt).collect()
