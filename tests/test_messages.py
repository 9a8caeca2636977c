"""Wire formats, caches that go on where they stopped, and streams that outlive bad messages."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tidewright.sources import caches, protobuf
from tidewright.streaming import ingest, live

TRADE = {
    "metadata": {"event_id": "e1", "event_time_unix_ms": -5, "produced_time_unix_ms": 0, "producer": "p", "schema_version": "v", "correlation_id": ""},
    "symbol": "ÄB", "price": 1.5, "volume": 0.0, "source_timestamp_unix_ms": 1 << 40, "received_timestamp_unix_ms": 0, "source": "s", "trade_conditions": ["1", "", "x"],
}


def test_known_bytes():
    # written out by hand from the format's rules
    assert protobuf.encode({"symbol": "AB", "price": 1.5, "source_timestamp_unix_ms": 300}, protobuf.TRADE) == b"\x12\x02AB\x19" + struct.pack("<d", 1.5) + b"\x28\xac\x02"
    assert protobuf.encode({"metadata": {"event_id": "x"}}, protobuf.TRADE) == b"\x0a\x03\x0a\x01x"
    assert protobuf.encode({"event_time_unix_ms": -1}, protobuf.METADATA) == b"\x10" + b"\xff" * 9 + b"\x01"
    assert protobuf.encode({"trade_count": 2**64 - 1, "finalized": True}, protobuf.BAR) == b"\x58" + b"\xff" * 9 + b"\x01" + b"\x70\x01"


def test_round_trip_and_unknown_fields():
    data = protobuf.encode(TRADE, protobuf.TRADE)
    assert protobuf.decode(data, protobuf.TRADE) == TRADE
    unknown = b"\xf8\x01\x05" + b"\xfa\x01\x02zz" + b"\xfd\x01abcd" + b"\xf9\x01abcdefgh"
    assert protobuf.decode(unknown + data + unknown, protobuf.TRADE) == TRADE
    assert protobuf.decode(b"\x10\x07" + data, protobuf.TRADE) == TRADE  # the symbol's number with another wire type
    assert protobuf.decode(b"", protobuf.TRADE)["metadata"] is None
    twice = protobuf.decode(data + b"\x12\x01Z" + b"\x0a\x03\x22\x01q", protobuf.TRADE)
    assert (twice["symbol"], twice["metadata"]["producer"], twice["metadata"]["event_id"]) == ("Z", "q", "e1")
    row = ((1, protobuf.Kind("n", "int64", repeated=True)), (2, protobuf.Kind("d", "double", repeated=True)))
    assert protobuf.decode(b"\x0a\x03\x01\xac\x02\x08\x05\x12\x08" + struct.pack("<d", 2.5), row) == {"n": [1, 300, 5], "d": [2.5]}


@pytest.mark.parametrize(
    ("data", "reason"),
    [(b"\x12\x05AB", "truncated"), (b"\x12", "truncated"), (b"\x19abc", "truncated"), (b"\x28\xff", "truncated"), (b"\x28" + b"\xff" * 10 + b"\x01", "bad varint"), (b"\x13", "bad wire type"), (b"\x02\x00", "bad field number"), (b"\x12\x02\xff\xfe", "not utf-8")],
)
def test_faults(data, reason):
    with pytest.raises(protobuf.Fault, match=reason):
        protobuf.decode(data, protobuf.TRADE)


def test_every_cut_of_a_message_is_refused_or_shorter():
    data = protobuf.encode(TRADE, protobuf.TRADE)
    for n in range(len(data)):
        try:
            assert protobuf.decode(data[:n], protobuf.TRADE) != TRADE
        except protobuf.Fault as e:
            assert str(e) == "truncated"


def test_decoded_rows_keep_theirs(spark):
    good = protobuf.encode(TRADE, protobuf.TRADE)
    rows = [(1, good), (2, good[:-1]), (3, None), (4, protobuf.encode(TRADE | {"symbol": ""}, protobuf.TRADE)), (5, protobuf.encode(TRADE | {"metadata": None}, protobuf.TRADE))]
    df = spark.createDataFrame(rows, "message long, `pay.load` binary")
    found = protobuf.decoded(df.withColumnRenamed("message", "id"), "pay.load", protobuf.TRADE, protobuf.trade_fault)
    assert {r.id: r.reject_reason for r in found.collect()} == {1: None, 2: "truncated", 3: "missing identity", 4: "missing identity", 5: "missing identity"}
    assert found.where("id = 1").first().message.asDict(True) == TRADE
    assert found.where("id > 1").where("message is not null").count() == 0
    again = protobuf.encoded(found.where("id = 1"), F.col("message"), protobuf.TRADE, "bytes")
    assert again.first()["bytes"] == good
    bar = {"metadata": {"schema_version": "market-bar-v2"}, "symbol": "A"}
    old = protobuf.decoded(spark.createDataFrame([(protobuf.encode(bar, protobuf.BAR),)], "p binary"), "p", protobuf.BAR, protobuf.bar_fault)
    assert old.first().reject_reason == "unsupported schema version"


SCHEMA = "hash string, score double"


def infer(seen, stop_at=None):
    """A model: the length of a text, counting what it is asked; it fails at a text."""

    def run(rows):
        def one(batches):
            for pdf in batches:
                if stop_at is not None and (pdf["text"] == stop_at).any():
                    raise RuntimeError("stopped")
                seen.add(len(pdf))
                yield pdf.assign(score=pdf["text"].str.len().astype(float))[["hash", "score"]]

        return rows.mapInPandas(one, SCHEMA)

    return run


def test_a_stopped_run_goes_on_where_it_ended(spark, tmp_path):
    texts = [f"text {i * i}" for i in range(200)]
    inputs = spark.createDataFrame([(t,) for t in [*texts, *texts[:50]]], "text string").withColumn("hash", F.sha2("text", 256)).repartition(3)
    inputs = inputs.unionByName(spark.createDataFrame([(None, None)], inputs.schema))
    whole, stopped = str(tmp_path / "whole"), str(tmp_path / "stopped")
    seen = spark.sparkContext.accumulator(0)
    assert caches.extend_cache(inputs, whole, "hash", infer(seen), SCHEMA, 8) == 8 and seen.value == 200
    shards = {r.hash: r.s for r in inputs.where("hash is not null").select("hash", caches.shard_of(F.col("hash"), 8).alias("s")).collect()}
    assert all(int(h[:2], 16) % 8 == s for h, s in shards.items())
    last = next(t for t in texts if shards[inputs.where(F.col("text") == t).first().hash] == 5)
    seen = spark.sparkContext.accumulator(0)
    with pytest.raises(Exception, match="stopped"):
        caches.extend_cache(inputs, stopped, "hash", infer(seen, last), SCHEMA, 8)
    left = caches.read_cache(spark, stopped, SCHEMA)
    assert {shards[r.hash] for r in left.collect()} == {0, 1, 2, 3, 4}
    before = left.count()
    seen = spark.sparkContext.accumulator(0)
    assert caches.extend_cache(inputs, stopped, "hash", infer(seen), SCHEMA, 8) == 3 and seen.value == 200 - before
    rows = lambda p: sorted(map(tuple, caches.read_cache(spark, p, SCHEMA).collect()))
    assert rows(stopped) == rows(whole) and len(rows(whole)) == 200
    assert caches.extend_cache(inputs, stopped, "hash", infer(seen), SCHEMA, 8) == 0
    # two workers at once, one of them over what the other does too
    caches.extend_cache(inputs, str(tmp_path / "shared"), "hash", infer(seen), SCHEMA, 8, only=[0, 1, 2, 3])
    caches.extend_cache(inputs, str(tmp_path / "shared"), "hash", infer(seen), SCHEMA, 8, only=[4, 5, 6, 7])
    assert rows(str(tmp_path / "shared")) == rows(whole)
    caches.read_cache(spark, whole, SCHEMA).write.parquet(f"{tmp_path}/shared/shard=0/part-again")
    assert sorted(map(tuple, caches.read_cache(spark, str(tmp_path / "shared"), SCHEMA, "hash").collect())) == rows(whole)


def message(i):
    good = {"event_id": f"e{i}", "symbol": "AB"[i % 2], "price": 1.0 + i, "volume": 2.0, "ts_ms": 1000 + i, "seq": i}
    bad = {5: "{cut", 6: "[1]", 7: json.dumps(good | {"symbol": " "}), 8: json.dumps(good | {"price": -1}), 9: json.dumps(good | {"volume": None}), 10: json.dumps(good | {"ts_ms": 0}), 11: ""}
    return bad.get(i % 20, json.dumps(good))


REASONS = {5: "malformed", 6: "malformed", 7: "missing identity", 8: "invalid price", 9: "invalid volume", 10: "missing timestamp", 11: "malformed"}
PARSED = f"value string, {ingest.TRADE}, reject_reason string"


def test_a_stream_outlives_poison_and_a_restart(spark, tmp_path):
    for part in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.txt").write_text("\n".join(message(i) for i in range(part * 25, part * 25 + 25)) + "\n")
    stream = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    out, tries = str(tmp_path / "out"), []

    def parse(batch):
        tries.append(1)
        rows = ingest.parsed_trades(batch)
        if len(tries) == 3:  # part of the files are there when it fails
            rows.limit(3).withColumn("dead", F.lit(False)).write.partitionBy("dead").parquet(f"{out}/batch=2")
            spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).delete(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/batch=2/_SUCCESS"), False)
            raise RuntimeError("lost")
        return rows

    with pytest.raises(Exception, match="lost"):
        ingest.ingest(stream, out, str(tmp_path / "c"), parse).awaitTermination(120)
    assert ingest.written_batches(spark, out, PARSED).count() == 50
    ingest.ingest(stream, out, str(tmp_path / "c"), parse).awaitTermination(120)
    rows = ingest.written_batches(spark, out, PARSED).collect()
    assert sorted(r.value for r in rows) == sorted(message(i) for i in range(100))
    want = {message(i): REASONS.get(i % 20) for i in range(100)}
    assert all(r.reject_reason == want[r.value] for r in rows)
    assert len(tries) == 5
    sent = ingest.outbox(ingest.written_batches(spark, out, PARSED).where("reject_reason is null").select("event_id", "symbol", "price"), "symbol", "event_id").collect()
    assert {(r.key, json.loads(r.value)["event_id"]) for r in sent} == {("AB"[i % 2], f"e{i}") for i in range(100) if i % 20 not in REASONS} and all(json.loads(r.value)["event_id"] == r.id for r in sent)


def test_an_idle_symbol_keeps_its_bar_open_over_a_restart(spark, tmp_path):
    schema = "event_id long, symbol string, price double, volume double, ts_ms long, seq long"

    def add(name, rows):
        spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = spark.readStream.schema(f"{schema}, ts timestamp").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        write = live.insert_batches(str(tmp_path / "out"), ["kind", "symbol", "start_ms"], ["start_ms"])
        live.into(live.per_symbol_bars(stream), str(tmp_path / "c"), write).awaitTermination(120)
        return {(r.symbol, r.start_ms): (r.n, r.close) for r in spark.read.parquet(str(tmp_path / "out")).where("kind = 'bar'").collect()}

    add("a", [(1, "IDLE", 5.0, 1.0, 10_000, 1), (2, "BUSY", 7.0, 1.0, 10_000, 2), (3, "BUSY", 8.0, 1.0, 70_000, 3)])
    assert run() == {("BUSY", 0): (1, 7.0)}
    add("b", [(i, "BUSY", float(i), 1.0, i * 60_000, i) for i in range(4, 30)])
    found = run()
    assert ("IDLE", 0) not in found and ("BUSY", 60_000) in found
    add("c", [(90, "IDLE", 6.0, 1.0, 20_000, 90), (91, "IDLE", 9.0, 1.0, 65_000, 91)])  # not late: its own clock stood still
    assert run()["IDLE", 0] == (2, 6.0)
