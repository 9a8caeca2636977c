"""Queries on tables whose keys run past what the small tables hold, against their SQL."""

import duckdb
import pytest

from tidewright.plans import registry


def compared(spark, name, folder, tables, digits=9):
    """(what the query returns, what its SQL does), sorted, columns by name."""
    con, df = duckdb.connect(), registry.QUERIES[name](spark, str(folder))
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    twin = con.sql(registry.SQL[name])
    columns = sorted(df.columns)
    at = [twin.columns.index(c) for c in columns]
    plain = lambda r: repr(tuple(round(v, digits) if isinstance(v, float) else v for v in r))
    return sorted(plain(r[c] for c in columns) for r in df.collect()), sorted(plain(r[i] for i in at) for r in twin.fetchall())


@pytest.mark.parametrize("name", ["K1", "K2"])
def test_upserts_of_numbers_that_the_shifted_ones_meet(spark, tmp_path, name):
    rows = [(k, f"n{k}", k / 7) for k in (0, 3, 5, 1000, 1003, 1005, 2003, 2500)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    found, wanted = compared(spark, name, tmp_path, ["supplier"])
    assert found == wanted and len(found) == 2 * len(rows)


def test_quantiles_are_exact_and_no_group_is_one_task(spark):
    import random

    from pyspark.sql import functions as F

    from tidewright.operators.ordering import quantiles

    rng = random.Random(5)
    rows = [(g, rng.choice([rng.random(), float(rng.randrange(5))])) for g in ["a", "b", None] for _ in range(400)] + [("one", 2.0), ("nulls", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    found = quantiles(df, ["g"], "v", shares)
    wanted = df.groupBy("g").agg(*(F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()))
    plain = lambda t: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in t.collect())
    assert plain(found) == plain(wanted)


def test_groups_of_prices_do_not_meet_in_one_aggregate(spark, tmp_path):
    spark.createDataFrame([("A", 1.0), ("A", 2.0), ("N", None)], "l_returnflag string, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert "percentile(" not in registry.QUERIES["A13"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    found, wanted = compared(spark, "A13", tmp_path, ["lineitem"])
    assert found == wanted


def test_trades_of_one_place_arrive_by_their_ids(spark):
    from tidewright.operators.bars import live_bars

    rows = [("s", 1.0, 1.0, 120_000, 7, 1), ("s", 2.0, 1.0, 0, 7, 2), ("s", 3.0, 1.0, 60_000, 7, 0)]
    for order in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = spark.createDataFrame(order, "symbol string, price double, volume double, ts_ms long, seq long, event_id long").coalesce(1)
        assert sorted(r.bar_start_ms for r in live_bars(df).collect()) == [60_000, 120_000]


def events(spark, folder, odd):
    """400 events of two symbols, `odd` changing each before it is written."""
    from datetime import datetime, timedelta

    rows = [odd({"event_id": i, "ts": datetime(2024, 1, 1) + timedelta(seconds=i * 977 % 3000), "event_type": "ab"[i % 2], "value": float(i % 17), "props": f'{{"k": {i % 9}}}'}) for i in range(400)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")


ODD = {
    "no symbol": lambda e: e | {"event_type": None if e["event_id"] % 5 == 0 else e["event_type"]},
    "no symbols": lambda e: e | {"event_type": None},
    "one without id": lambda e: e | {"event_id": None if e["event_id"] == 30 else e["event_id"]},
    "negative ids": lambda e: e | {"event_id": e["event_id"] - 200},
}


@pytest.mark.parametrize("broadcast", ["-1", "10m"])
@pytest.mark.parametrize("odd", sorted(ODD))
def test_late_trades_without_symbol_or_with_odd_ids(spark, tmp_path, odd, broadcast):
    events(spark, tmp_path, ODD[odd])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found, wanted = compared(spark, "B4", tmp_path, ["events"])
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found == wanted and found


@pytest.mark.parametrize("odd", ["no price", "instants shared, one without id", *sorted(ODD)])
@pytest.mark.parametrize("name", ["B1", "B8"])
def test_bars_of_odd_trades(spark, tmp_path, name, odd):
    from datetime import datetime, timedelta

    more = {
        "no price": lambda e: e | {"value": None if e["event_id"] % 3 == 0 else e["value"]},
        "instants shared, one without id": lambda e: e | {"ts": datetime(2024, 1, 1) + timedelta(seconds=e["event_id"] * 977 % 3000 // 200 * 200), "event_id": None if e["event_id"] == 30 else e["event_id"], "value": float(e["event_id"])},
    }
    events(spark, tmp_path, (ODD | more)[odd])
    found, wanted = compared(spark, name, tmp_path, ["events"])
    assert found == wanted and found
