"""Streams against their batch twins."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import bars
from tidewright.streaming import live

ROWS = [(str(i), "AB"[i % 2], float(i * 7 % 13 + 1), 1.0, 3_600_000 + i * 4_000, i) for i in range(300)]


@pytest.fixture
def trades(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "event_id string, symbol string, price double, volume double, ts_ms long, seq long")
    df = df.withColumn("ts", F.timestamp_millis("ts_ms"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    return df, stream, str(tmp_path)


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert not q.isActive


def test_minute_bars_equal_batch(spark, trades):
    df, stream, _ = trades
    run(live.minute_bars(stream), "minutes")
    got = {(x.symbol, x.s): (x.open, x.high, x.low, x.close, x.trade_count) for x in spark.sql("select *, unix_millis(window.start) s from minutes").collect()}
    want = {(x.symbol, x.bar_start_ms): (x.open, x.high, x.low, x.close, x.trade_count) for x in bars.bars(df).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    assert len(want) - len(got) <= 4  # the last bars stay open


def test_five_minutes_and_unique(spark, trades):
    df, stream, _ = trades
    run(live.five_minute_bars(live.minute_bars(stream)), "fives")
    got = {(x.symbol, x.s): x.trade_count for x in spark.sql("select *, unix_millis(window.start) s from fives").collect()}
    want = {(x.symbol, x.bar_start_ms): x.trade_count for x in bars.roll_up(bars.bars(df)).collect()}
    assert got and all(want[k] == v for k, v in got.items())
    run(live.unique(stream.union(stream)), "once")
    assert spark.table("once").count() == len(ROWS)


def test_each_symbol_has_its_own_watermark(spark, trades):
    df, stream, _ = trades
    # B stops early: its last bar never ends, A's do
    run(live.per_symbol_bars(stream.where("symbol = 'A' or seq < 100").withColumn("event_id", F.col("event_id").cast("long"))), "own")
    got = {(x.symbol, x.start_ms): (x.open, x.close, x.n) for x in spark.table("own").where("kind = 'bar'").collect()}
    few = df.where("symbol = 'A' or seq < 100")
    want = {(x.symbol, x.bar_start_ms): (x.open, x.close, x.trade_count) for x in bars.finalised(bars.bars(few), few).collect()}
    assert got == want


def test_batches_written_twice(spark, trades):
    _, stream, path = trades
    for i in range(2):
        live.into(stream.select("event_id", "symbol", "seq"), f"{path}/c{i}", live.insert_batches(f"{path}/out", ["event_id"], ["seq"])).awaitTermination(120)
    assert spark.read.parquet(f"{path}/out").count() == len(ROWS)
