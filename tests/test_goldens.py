"""Inputs with known outcomes."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewright.functions import clean, text
from tidewright.operators import arrivals, asof, bars, dedup, indicators, metrics
from tidewright.operators import rolling as r
from tidewright.plans import registry
from tidewright.sources import readers, writers

TRADE = "event_id string, symbol string, price double, volume double, ts_ms long, seq long"


def trades(spark, rows):
    return spark.createDataFrame([(*x, i) for i, x in enumerate(rows)], TRADE)


def test_one_minute_bar_opens_and_closes_by_time(spark):
    t = trades(spark, [("b", "SPY", 521.10, 2.0, 1721577104209), ("a", "SPY", 520.75, 3.0, 1721577104208)])
    (b,) = bars.bars(t).collect()
    assert (b.open, b.high, b.low, b.close, b.volume, b.trade_count) == (520.75, 521.10, 520.75, 521.10, 5.0, 2)


def test_equal_instants_first_or_last_arrival_closes(spark):
    t = trades(spark, [("a", "S", 1.0, 1.0, 60_000), ("b", "S", 2.0, 1.0, 60_000)])
    assert bars.bars(t).first().close == 1.0
    assert bars.bars(t, tie="last").first().close == 2.0


def test_five_minutes_from_minutes(spark):
    t = trades(spark, [(str(i), "S", 100.0 + i, 2.0 + i, 1 + 60_000 * i) for i in range(5)])
    (b,) = bars.roll_up(bars.bars(t)).collect()
    assert (b.bar_start_ms, b.open, b.high, b.low, b.close, b.volume, b.trade_count) == (0, 100.0, 104.0, 100.0, 104.0, 20.0, 5)


def test_late_trade_of_a_final_bar(spark):
    t = trades(spark, [("a", "S", 1.0, 1.0, 60_000), ("b", "S", 1.0, 1.0, 125_000), ("c", "S", 9.0, 1.0, 60_001)])
    (late,) = bars.late_trades(t).collect()
    assert (late.event_id, late.reason) == ("c", "bar already finalized")


def test_live_store_ignores_older_bars_and_repeats(spark):
    t = trades(spark, [("a", "S", 100.0, 5.0, 0), ("b", "S", 102.0, 3.0, 10_000), ("a", "S", 1.0, 1.0, 0), ("c", "S", 105.0, 1.0, 61_000), ("d", "S", 7.0, 1.0, 2)])
    found = {b.bar_start_ms: b for b in bars.live_bars(bars.first_seen(t)).collect()}
    assert (found[0].close, found[0].volume, found[0].trade_count, found[60_000].close) == (102.0, 8.0, 2, 105.0)


def test_live_store_builds_five_minutes_from_trades_that_the_minute_ignores(spark, tmp_path):
    t = trades(spark, [("a", "S", 100.0, 5.0, 0), ("b", "S", 105.0, 1.0, 61_000), ("c", "S", 7.0, 1.0, 2), ("d", "S", 9.0, 1.0, 300_000), ("e", "S", 1.0, 1.0, 62_000)])
    found = {(b.interval, b.bar_start_ms): (b.bar_end_ms, b.open, b.high, b.low, b.close, b.volume, b.trade_count) for b in bars.live_store(t).collect()}
    assert found == {
        ("1m", 0): (60_000, 100.0, 100.0, 100.0, 100.0, 5.0, 1), ("1m", 60_000): (120_000, 105.0, 105.0, 105.0, 105.0, 1.0, 1), ("1m", 300_000): (360_000, 9.0, 9.0, 9.0, 9.0, 1.0, 1),
        ("5m", 0): (300_000, 100.0, 105.0, 7.0, 105.0, 7.0, 3), ("5m", 300_000): (600_000, 9.0, 9.0, 9.0, 9.0, 1.0, 1),
    }
    t.selectExpr("cast(seq as long) event_id", "cast(timestamp_millis(ts_ms) as timestamp_ntz) ts", "symbol event_type", "price value", "'{}' props").write.parquet(f"{tmp_path}/events.parquet")
    assert {b.bar_end_ms - b.bar_start_ms for b in registry.QUERIES["B8"](spark, str(tmp_path)).collect()} == {60_000, 300_000}


def test_bars_do_not_depend_on_how_rows_are_dealt(spark):
    t = trades(spark, [(str(i), "AB"[i % 2], float(i * 7 % 13 + 1), 1.0, i * 9_000 % 600_000) for i in range(200)])
    assert sorted(bars.bars(t).collect()) == sorted(bars.bars(t.repartition(7)).collect())


def daily(spark, closes, symbol="S"):
    return spark.createDataFrame([(symbol, date.fromordinal(730_000 + i), c, c + 1, c - 1, c, 10.0) for i, c in enumerate(closes)], "symbol string, date date, open double, high double, low double, close double, volume double")


def test_volatility_and_rsi(spark):
    d = r.with_returns(daily(spark, [100.0] * 14 + [110.0]))
    last = d.select("date", r.volatility(6).alias("v"), r.rsi(14).alias("rsi")).orderBy(F.desc("date")).first()
    one = math.log(1.1)
    m = one / 6
    assert last.v == pytest.approx(math.sqrt(((one - m) ** 2 + 5 * m * m) / 5)) and last.rsi == 100.0
    flat = r.with_returns(daily(spark, [100.0] * 15)).select("date", r.volatility(6).alias("v"), r.rsi(14).alias("rsi")).orderBy(F.desc("date")).first()
    assert (flat.v, flat.rsi) == (0.0, 50.0)


def test_no_look_ahead(spark):
    d = r.with_returns(daily(spark, [100.0 + i * 7 % 11 for i in range(60)]))
    f = lambda x: {q.date: q for q in x.select("date", r.volatility(6).alias("a"), r.over_average(6).alias("b"), r.rsi().alias("c")).collect()}
    cut = d.where(F.col("date") < F.lit(date.fromordinal(730_040)))
    whole, part = f(d), f(cut)
    assert all(whole[k] == v for k, v in part.items())


def test_macd_and_ema_seed(spark):
    d = daily(spark, [float(i) for i in range(1, 41)])
    e = {x.date: x.e for x in indicators.ema(d, 3, "e").collect()}
    assert e[date.fromordinal(730_001)] is None and e[date.fromordinal(730_002)] == 2.0 and e[date.fromordinal(730_003)] == 3.0
    assert indicators.macd(d).count() == 40 - 25 - 8


@pytest.mark.parametrize(("day", "ms"), [("2021-07-01", 1625169600000), ("2021-01-04", 1609794000000), ("2016-07-28", 1469736000000), ("2016-12-06", 1481058000000)])
def test_close_of_session(spark, day, ms):
    assert spark.sql(f"select date'{day}' d").select(clean.close_ms(F.col("d")).alias("x")).first().x == ms


@pytest.mark.parametrize(("day", "hour"), [("2021-03-12", 21), ("2021-03-15", 20), ("2021-11-05", 20), ("2021-11-08", 21)])
def test_daylight_saving(spark, day, hour):
    x = spark.sql(f"select date'{day}' d").select((clean.close_ms(F.col("d")) / 3_600_000 % 24).alias("x")).first().x
    assert x == hour


def test_epoch_dates(spark):
    found = spark.createDataFrame([(1469712600,), (1609770600,)], "s long").select(clean.epoch_date(F.col("s")).alias("d")).collect()
    assert [str(x.d) for x in found] == ["2016-07-28", "2021-01-04"]


def test_pollable(spark):
    rows = spark.createDataFrame([("MSFT",), ("NVDA",), ("HPE-PC",), ("ORCL-PD",), ("",)], "s string")
    assert [x.p for x in rows.select(clean.pollable(F.col("s")).alias("p")).collect()] == [True, True, False, False, False]


SNAPSHOTS = [("2019-09-30", "AAPL", 17.5), ("2019-09-30", "ZZZ", 1.0), ("2019-09-30", "GAPCO", 1.0), ("2019-12-31", "AAPL", 19.7), ("2019-12-31", "ZZZ", 1.0), ("2020-03-31", "AAPL", 20.0), ("2020-03-31", "GAPCO", 1.0)]


def test_membership_is_of_the_whole_latest_snapshot(spark):
    h = spark.createDataFrame(SNAPSHOTS, "snapshot string, symbol string, weight double")
    asks = [(d, s) for d in ("2019-09-29", "2019-09-30", "2019-12-31", "2020-03-30", "2020-03-31", "2021-01-01") for s in ("AAPL", "ZZZ", "GAPCO")]
    rows = spark.createDataFrame(asks, "date string, symbol string")
    held = {(x.date, x.symbol): x.weight for x in asof.snapshot_members(rows, h, "date", strict=False).collect()}
    assert ("2019-09-29", "AAPL") not in held and held["2019-09-30", "AAPL"] == 17.5 and held["2019-12-31", "AAPL"] == 19.7
    assert ("2020-03-30", "ZZZ") in held and ("2020-03-31", "ZZZ") not in held
    assert ("2019-12-31", "GAPCO") not in held and ("2021-01-01", "GAPCO") in held
    strict = {(x.date, x.symbol) for x in asof.snapshot_members(rows, h, "date").collect()}
    assert ("2019-09-30", "AAPL") not in strict and ("2020-03-31", "ZZZ") in strict


def test_forward_strict_asof(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "id int, t int")
    right = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c")], "at int, v string")
    go = lambda **k: {x.id: x.v for x in asof.asof(left, right, "t", "at", [], ["v"], **k).collect()}
    assert go() == {1: "a", 2: "b"} and go(strict=True) == {1: None, 2: "a"}
    assert go(forward=True) == {1: "a", 2: "b"} and go(forward=True, strict=True) == {1: "b", 2: "c"}


def test_versions_and_withdrawals(spark):
    v = spark.createDataFrame([("1", "S", "A", 1, False, 1), ("1", "S", "A", 2, False, 2), ("1", None, None, 2, True, 3), ("2", "S", "A", 2, False, 1), ("2", "S", "A", 2, False, 2)], "story string, sector string, symbol string, session int, withdrawn boolean, take int")
    assert sorted((x.story, x.session, x["take"]) for x in dedup.select_versions(v, ["take"]).collect()) == [("1", 1, 1), ("2", 2, 2)]


def test_completed_days_win(spark):
    c = spark.createDataFrame([("S", "d1", 1.0)], "symbol string, date string, close double")
    t = spark.createDataFrame([("S", "d1", 9.0), ("S", "d2", 2.0)], "symbol string, date string, close double")
    assert sorted(x.close for x in bars.completed_and_today(c, t).collect()) == [1.0, 2.0]


def test_duplicates_and_windows(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, -1.0)], "ts int, close double")
    x = dedup.duplicate_counts(rows, "ts", F.col("close") > 0).first()
    assert (x.kept, x.duplicates, x.invalid) == (3, 1, 1)
    assert readers.request_windows(spark, "2024-01-01", "2024-03-01").count() == 2


def test_metrics_of_four(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.6, 1), (0.9, 1)], "p double, label int")
    m = metrics.binary(rows, []).first()
    assert (m.accuracy, m.auc, m.positive_rate) == (1.0, 1.0, 0.5)
    assert metrics.auc(rows.where("label = 1"), []).first().auc is None


def test_visible_text():
    html = "<html><!-- no --><script>no<b>no</b></script><p>one</p><div style='display:none'>no<div>no</div>no</div><ix:header>no</ix:header>two<br>three<style>no</style></html>"
    assert text.visible(html) == "one two three"
    assert text.visible(None) == "" and text.visible("<p>a", 1) == ""
    assert text.item_sections("x Item 1.01 a Item 9.01 b item 2 c") == "Item 1.01 a item 2 c"


def test_absent_keys_conflict_with_nothing(spark):
    rows = [(1, "", "a"), (2, "", "b"), (3, None, "c"), (4, " ", "b"), (5, "u", None), (6, "u", "d"), (7, None, None), (8, "v", "a")]
    found = arrivals.first_of_any(spark.createDataFrame(rows, "id long, url string, hash string"), ["url", "hash"], ["id"])
    assert sorted(r.id for r in found.collect()) == [1, 2, 3, 5, 7]


def test_texts_without_item_sections_stay_whole():
    assert text.item_sections("no sections, one item, items 2") == "no sections, one item, items 2"
    assert text.item_sections("a Item 9.01 exhibits") == "a Item 9.01 exhibits"
    assert text.item_sections("abcdef", 4) == "abcd" and text.item_sections(None) == ""
    assert text.item_sections("see item  1 and _item 2 b") == "item 2 b"


def test_word_pieces():
    w = text.WordPieces(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "."])
    assert w.encode("Unaffable. zzz", 8) == ([2, 4, 5, 6, 7, 1, 3, 0], [1] * 7 + [0])
    assert w.encode("un un un un", 4)[0] == [2, 4, 4, 3]


def test_different_texts_are_different_inputs(spark, tmp_path):
    from tidewright.plans import registry

    same = "the price rose " * 12
    texts = ["prices rose", "prices fell", same + "today", same + "yesterday", "word " * 90 + "a", "word " * 90 + "b", "prices rose"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((r.doc_id, r.occurrences, r.texts) for r in registry.QUERIES["D11"](spark, str(tmp_path)).collect())
    assert found == [(0, 2, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 2), (5, 1, 2)]  # 4 and 5 differ behind the last piece
    assert all(len(r.ids.split()) == 64 and "1" not in r.ids.split() for r in registry.QUERIES["F22"](spark, str(tmp_path)).collect())


def test_legacy_features(spark):
    from tidewright.plans import panels

    closes = {"A": [100 + (i * 7) % 11 for i in range(12)], "SPY": [50 + (i * 5) % 7 for i in range(12)]}
    daily = spark.createDataFrame([(k, date(2024, 1, i + 1), float(c), 10.0 + i) for k, v in closes.items() for i, c in enumerate(v)], "symbol string, date date, close double, volume double")
    found = {x.date.day - 1: x for x in panels.legacy_features(daily, "SPY", 5, 2).where("symbol = 'A'").collect()}
    assert sorted(found) == [8, 9]
    a, b, x = closes["A"], closes["SPY"], found[8]
    want = [a[8] / a[7] - 1, a[8] / a[5] - 1, a[8] / a[2] - 1, math.sqrt(abs(a[8] / a[2] - 1) + 1e-8), 15.5, 18 / 15.5, 50 + 10 * (a[8] / a[7] - 1), b[8] / b[7] - 1, a[8] / a[7] - b[8] / b[7], math.log(a[10] / a[8])]
    names = "ret_1 ret_3 ret_6 volatility_6 volume_mean_6 rel_volume rsi_14 spy_ret_1 sector_spy_diff label".split()
    assert [x[n] for n in names] == pytest.approx(want)


def test_fits_are_aggregates_of_all_rows(spark):
    from tidewright.operators import models

    rows = [(f, i, ("train", "validate", "test")[i % 3], float(i * (f + 3) % 17), int((i * 7 + f) % 5 > 1 or i % 17 > 12), ((i * 13 + f) % 97 + 1) / 99) for f in range(3) for i in range(120)]
    rows = [r if r[0] < 2 else (*r[:4], 1, r[5]) for r in rows]  # the last fold has one outcome
    df = spark.createDataFrame(rows, "fold long, i long, part string, x double, label int, p double").repartition(5)
    mapped, platt = models.logistic_map(df.drop("p"), "fold", "x"), models.platt(df, "fold")
    for plan in (mapped, platt):
        assert "InPandas" not in plan._jdf.queryExecution().toString()

    def steps(part, f, g, rounds, whole):  # Newton's, kept within +-20, over one fold's rows in memory
        import numpy as np

        x, y = np.array([(g(r), r[4]) for r in rows if r[0] == f and r[2] == part]).T
        mean, sd = (x.mean(), x.std()) if whole else (0.0, 1.0)
        x, at = (x - mean) / sd, np.array([0.0, 1.0])
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(at[0] + at[1] * x, -20, 20)))
            w = q * (1 - q)
            at = np.clip(at + np.linalg.solve([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-6]], [(y - q).sum(), ((y - q) * x).sum()]), -20, 20)
        return at[0] - at[1] * mean / sd, at[1] / sd

    got, fits = {(r.fold, r.i): r.p for r in mapped.collect()}, {f: steps("train", f, lambda r: r[3], 25, True) for f in (0, 1)} | {2: (0.0, 0.0)}
    assert len(got) == len(rows)
    for f, i, _, x, *_ in rows:
        assert got[f, i] == pytest.approx(1 / (1 + math.exp(-fits[f][0] - fits[f][1] * x)), abs=1e-8)
    found = {r.fold: (r.intercept, r.slope) for r in platt.collect()}
    assert sorted(found) == [0, 1, 2]
    for f, at in found.items():
        b, m = steps("validate", f, lambda r: math.log(r[5] / (1 - r[5])), 30, False) if f < 2 else (0.0, 1.0)
        assert at == pytest.approx((max(-2, min(2, b)), max(0.75, min(1.25, m))), abs=1e-8)


def test_rows_are_numbered_without_one_window(spark):
    from tidewright.operators.ordering import numbered

    at = numbered(spark.range(1000).selectExpr("id * 7 % 1000 AS o", "id * 7 % 1000 AS v").repartition(6), [], ["o"])
    assert all(r.nth == r.v and r.size == 1000 for r in at.collect()) and at.count() == 1000
    assert "Window" not in at._jdf.queryExecution().toString()


def test_frames_and_rejects(spark):
    lines = spark.createDataFrame([('{"type":"trade","data":[{"s":"SPY","p":1.5,"v":2,"t":5,"c":["1"]}]}',), ('{"type":"ping"}',), ("{bad",)], "value string")
    found = readers.trade_frames(lines)
    assert found.where("reject_reason is null").select("symbol", "price").collect() == [("SPY", 1.5)]
    assert {x.reject_reason for x in found.where("reject_reason is not null").collect()} == {"control frame", "malformed"}


def test_parallel_arrays_are_cut_to_the_shortest(spark):
    j = '{"cik":"12","tickers":["A"],"filings":{"recent":{"accessionNumber":["1","2","3"],"form":["8-K","4"],"acceptanceDateTime":["a","b","c"],"filingDate":["a","b","c"],"primaryDocument":["a","b","c"]}}}'
    found = readers.submissions(spark.createDataFrame([(j,)], "value string")).collect()
    assert [(x.cik, x.accession, x.form) for x in found] == [("0000000012", "1", "8-K"), ("0000000012", "2", "4")]


def test_facts_and_stories(spark):
    f = '{"cik":1,"entityName":"E","facts":{"us-gaap":{"Assets":{"units":{"USD":[{"accn":"x","val":5,"end":"2020-01-01","form":"10-K"}]}}}}}'
    assert readers.company_facts(spark.createDataFrame([(f,)], "value string")).select("tag", "unit", "val").collect() == [("Assets", "USD", 5.0)]
    s = ['{"id":"1","subjects":["A",{"ric":"B.N"}]}', '{"payload":{"id":"2","takeSequence":2}}']
    found = {x.id: x.subjects for x in readers.stories(spark.createDataFrame([(x,) for x in s], "value string")).collect()}
    assert found == {"1": ["A", "B.N"], "2": None}


def test_writers_run_twice_leave_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, seq int")
    for _ in range(2):
        writers.insert_new(rows, str(tmp_path / "t"), ["k"], ["seq"])
        writers.upsert(rows, str(tmp_path / "u"), ["k"], [F.desc("seq")])
    assert sorted(x.v for x in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "c"]
    assert sorted(x.v for x in writers.read_upserted(spark, str(tmp_path / "u")).collect()) == ["b", "c"]
    assert '"rows": 3' in writers.manifest(rows, source="x")


def test_schema_hash_tells_order():
    assert clean.schema_hash(["a", "b"]) != clean.schema_hash(["b", "a"])


def test_csv_quotes(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('a,b\n"1,\n2","say ""x"""\n')
    assert readers.read_csv(spark, str(p), "a string, b string").collect() == [("1,\n2", 'say "x"')]


def test_equal_rows_keep_their_number_in_spells(spark):
    from tidewright.operators import asof

    rows = spark.createDataFrame([("A", "2020-01-05", 1), ("A", "2020-01-05", 1), ("B", "2020-01-05", 2)], "symbol string, date string, n int").withColumn("date", F.to_date("date"))
    spells = spark.createDataFrame([("A", "2020-01-01", "2020-01-01", "2020-12-31", 7), ("A", "2020-01-03", "2020-01-02", "2020-12-31", 8)], "symbol string, available_from string, effective_from string, effective_to string, weight int")
    spells = spells.select("symbol", *(F.to_date(c).alias(c) for c in ("available_from", "effective_from", "effective_to")), "weight")
    assert [(r.symbol, r.weight) for r in asof.interval_members(rows, spells, "date").collect()] == [("A", 8), ("A", 8)]


def test_nan_inside_strings_stays(spark, tmp_path):
    from tidewright.sources import readers

    (tmp_path / "a.json").write_text(r'[{"headline": "NaNcy wins, \"NaN\" said", "x": NaN}, {"headline": "b", "x": 1.5}]')
    assert [tuple(r) for r in readers.json_array_files(spark, str(tmp_path), "headline string, x double").collect()] == [('NaNcy wins, "NaN" said', None), ("b", 1.5)]


def test_recursions_go_on_over_batches(spark):
    from tidewright.operators import indicators

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.createDataFrame([(s, i, float(i * i % 17 + k)) for k, s in enumerate("AB") for i in range(40)], "symbol string, date int, close double")
        found = {(r.symbol, r.date): r.e for r in indicators.ema(rows, 5, "e").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, s in enumerate("AB"):
        x, e = [i * i % 17 + k for i in range(40)], None
        for i in range(40):
            e = None if i < 4 else sum(x[:5]) / 5 if i == 4 else e + (x[i] - e) / 3
            assert found[s, i] == (e if e is None else pytest.approx(e))
