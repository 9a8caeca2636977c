"""Recent ids, CSV with every odd text, digits, published tables and gates."""

import math
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from tidewright.functions import clean
from tidewright.operators.recent import recent_unique
from tidewright.plans import api, sector_panel
from tidewright.sources import readers, writers


def loop(ids, horizon):
    held, out = deque(), []
    for i, k in enumerate(ids):
        if k is None or k not in held:
            out.append(i)
            if k is not None:
                held.append(k)
                if len(held) > horizon:
                    held.popleft()
    return out


rng = random.Random(3)
STREAMS = [
    [],
    [None, "a", None, "a"],
    [f"k{rng.randrange(12)}" for _ in range(120)],
    [f"k{i % 7}" for i in range(60)],  # as many keys as are held, and one more
    ["hot" if i % 3 else f"k{i}" for i in range(90)],
    [f"k{i}" for i in range(20)] * 2,
]


@pytest.mark.parametrize("ids", STREAMS)
@pytest.mark.parametrize("horizon", [6, 7, 1000])
def test_recent_ids(spark, ids, horizon):
    df = spark.createDataFrame(list(enumerate(ids)), "seq long, id string").repartition(3)
    assert sorted(r.seq for r in recent_unique(df, "id", "seq", horizon).collect()) == loop(ids, horizon)


TEXTS = [None, "", " ", " a ", '"', '""', "a,b", "a\nb", "\r\n", "\ra\r", 'say "x"\r\n', "\\", "\\n", "null", "é🙂", "'", "#c", ","]


@pytest.mark.parametrize("parts", [1, 3])
def test_csv_keeps_every_text_but_carriage_returns(spark, tmp_path, parts):
    df = spark.createDataFrame([(i, t, "end") for i, t in enumerate(TEXTS)], "i long, t string, last string").repartition(parts)
    writers.write_csv(df, str(tmp_path / "c"))
    found = readers.read_csv(spark, str(tmp_path / "c"), "i long, t string, last string").collect()
    assert {r.i: r.t for r in found} == {i: None if t is None else t.replace("\r", "") for i, t in enumerate(TEXTS)}
    assert {r["last"] for r in found} == {"end"}


def test_csv_with_windows_line_ends(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes(b'a,b\r\n"x\r\ny",1\r\n,""\r\n"",z\r\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "w.csv"), "a string, b string").collect()] == [("x\ny", "1"), (None, ""), ("", "z")]


def test_significant_digits(spark):
    numbers = [1 / 3, 2e-7, 123456789012345680.0, 1e21, 0.1, -0.0, 100.0, 5e-324, float("inf")]
    for digits in (12, 15, 17):
        found = spark.createDataFrame([(v,) for v in numbers], "v double").select("v", writers.significant(F.col("v"), digits).alias("t"))
        assert {r.t for r in found.collect()} == {f"{v:.{digits}g}" for v in numbers}
    assert spark.createDataFrame([(None,)], "v double").select(writers.significant(F.col("v"), 12).alias("t")).first().t is None


def test_published_tables_replace_and_prune(spark):
    one = spark.createDataFrame([(1, "2024-01-01", "x", 1), (2, "2023-01-01", "x", 2), (3, "2024-02-01", "x", 3)], "k long, date string, body string, v long").withColumn("date", F.to_date("date"))
    first = writers.published(None, one, ["k"], "a", 10_000, "2024-03-01")
    assert "body" not in first.columns
    second = writers.published(first, one.where("k > 1").withColumn("v", F.col("v") * 10), ["k"], "b", 365, "2024-03-01")
    assert sorted((r.k, r.v, r.run) for r in second.collect()) == [(1, 1, "a"), (3, 30, "b")]
    again = writers.published(second, one.where("k > 1").withColumn("v", F.col("v") * 10), ["k"], "b", 365, "2024-03-01")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, second.collect()))


def test_file_hashes(spark, tmp_path):
    import hashlib

    for n, b in (("a", b"x"), ("b.bin", b"\x00\xff" * 9), ("_x", b"hidden"), ("empty", b"")):
        (tmp_path / n).write_bytes(b)
    assert {(r.file, r.bytes, r.sha256) for r in writers.file_hashes(spark, str(tmp_path)).collect()} == {("a", 1, hashlib.sha256(b"x").hexdigest()), ("b.bin", 18, hashlib.sha256(b"\x00\xff" * 9).hexdigest())}


def test_gate(spark):
    ok = ("T", "v1", "h", ["a", "b"], [1.0, 2.0])
    rows = [ok, ("U", *ok[1:]), ("T", "v2", *ok[2:]), ("T", "v1", None, *ok[3:]), (*ok[:3], ["b", "a"], [1.0, 2.0]), (*ok[:3], None, [1.0, 2.0]), (*ok[:4], [1.0]), (*ok[:4], None), (*ok[:4], [1.0, math.inf]), (*ok[:4], [1.0, None]), (*ok[:4], [math.nan, 1.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, target_symbol string, feature_version string, schema_hash string, names array<string>, values array<double>")
    found = {r.i: r.reject_reason for r in api.gated(df, "T", "v1", "h", ["a", "b"]).collect()}
    assert [found[i] for i in range(len(rows))] == [None, "schema", "schema", "schema", "order", "order", "count", "count", "finite", "finite", "finite"]


def test_hashes_of_schemas(spark):
    texts = ["", "a", "foobar", "é|ü", None, "x" * 1000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    found = {r.i: r.h for r in rows.select("i", clean.fnv_hash(F.col("t")).alias("h")).collect()}
    assert [found[i] for i in range(3)] == ["cbf29ce484222325", "af63dc4c8601ec8c", "85944171f73967e8"] and found[4] is None
    for i in (3, 5):
        h = 0xCBF29CE484222325
        for b in texts[i].encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        assert found[i] == f"{h:016x}"
    names = F.array(*map(F.lit, sector_panel.LIVE))
    assert spark.range(1).select(clean.names_hash(names)).first()[0] == sector_panel.live_schema_hash()


def test_windows_of_spans(spark):
    rows = [("a", "2024-01-01", "2024-03-01"), ("b", "2024-01-01", "2024-01-31"), ("c", "2024-01-02", "2024-01-02"), ("d", None, "2024-01-02"), ("e", "2024-01-01", "2024-02-01")]
    spans = spark.createDataFrame(rows, "k string, start string, end string").withColumns({c: F.col(c).cast("date") for c in ("start", "end")})
    found = sorted((r.k, r.nth, str(r.window_start), str(r.window_end)) for r in readers.planned_windows(spans).collect())
    assert found == [("a", 0, "2024-01-01", "2024-01-31"), ("a", 1, "2024-01-31", "2024-03-01"), ("b", 0, "2024-01-01", "2024-01-31"), ("e", 0, "2024-01-01", "2024-01-31"), ("e", 1, "2024-01-31", "2024-02-01")]
    bars = spark.createDataFrame([("a", "2024-01-30"), ("a", "2024-01-31"), ("a", "2024-02-29"), ("e", "2024-01-01")], "k string, date string").withColumn("date", F.col("date").cast("date"))
    counted = readers.window_counts(bars, readers.planned_windows(spans), ["k"], "date", spans)
    assert {(r.k, r.nth): r.n for r in counted.collect()} == {("a", 0): 1, ("a", 1): 2, ("b", 0): 0, ("e", 0): 1, ("e", 1): 0}
