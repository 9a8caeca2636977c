"""Matrices, fund reports, databases and exhibits on small tables with every odd row."""

import hashlib
import struct
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewright.functions import text
from tidewright.operators import exhibits
from tidewright.sources import database, matrix, nport


def test_matrix_round_trip_and_faults(spark, tmp_path):
    rows = [(f"h{i}", [float(i), i / 3, -1.0]) for i in range(200)]
    path = f"file:{tmp_path}/m"
    df = spark.createDataFrame(rows, "key string, v array<double>")
    index = matrix.write_matrix(df.repartition(5), "key", "v", path, 3)
    more = [("gone", "none.f32", 0), ("before", index.first().file, -1), ("after", index.first().file, 10**6), ("null", index.first().file, None)]
    found = matrix.read_matrix(index.unionByName(spark.createDataFrame(more, matrix.INDEX)), path, 3, stretch=7).collect()
    assert {r.input_hash: r.fault for r in found if r.fault} == {"gone": "no such file", "before": "out of range", "after": "out of range", "null": "out of range"}
    want = {k: list(struct.unpack("<3f", struct.pack("<3f", *v))) for k, v in rows}
    assert {r.input_hash: r["values"] for r in found if not r.fault} == want
    # two inputs may share a row
    assert matrix.read_matrix(index.unionByName(index), path, 3).count() == 400
    with pytest.raises(Exception, match="3 finite numbers"):
        matrix.write_matrix(df.withColumn("v", F.slice("v", 1, 2)), "key", "v", f"{tmp_path}/short", 3)
    with pytest.raises(Exception, match="3 finite numbers"):
        matrix.write_matrix(df.withColumn("v", F.transform("v", lambda x: x / 0.0 if False else F.when(x == 5, float("nan")).otherwise(x))), "key", "v", f"{tmp_path}/nan", 3)
    (tmp_path / "m" / "x.f32").write_bytes(b"12345")
    with pytest.raises(ValueError, match="multiple"):
        matrix.read_matrix(index, path, 3)
    assert matrix.write_matrix(df.limit(0), "key", "v", f"{tmp_path}/none", 3).count() == 0


def test_matrix_of_an_outside_file(spark, tmp_path):
    (tmp_path / "a.f32").write_bytes(struct.pack("<6f", *range(6)))
    index = spark.createDataFrame([("x", "a.f32", 1), ("y", "a.f32", 2)], matrix.INDEX)
    assert {r.input_hash: (r["values"], r.fault) for r in matrix.read_matrix(index, str(tmp_path), 3).collect()} == {"x": ([3.0, 4.0, 5.0], None), "y": (None, "out of range")}


def test_fund_rules_and_dates(spark):
    names = ["Energy Select Sector SPDR Fund", "ENERGY SELECT SECTOR SPDR PREMIUM INCOME FUND", "The Technology select sector spdr", "Real Estate Fund", None, "Financial Select Sector SPDR and Energy Select Sector SPDR"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert {r.i: r.s for r in df.select("i", nport.sector_of(F.col("n")).alias("s")).collect()} == {0: "XLE", 1: None, 2: "XLK", 3: None, 4: None, 5: "XLE"}
    days = {"31-DEC-2023": date(2023, 12, 31), "1-jan-2024": date(2024, 1, 1), "29-Feb-2023": None, "": None, "5-XXX-2020": None, "2023-12-31": None, None: None}
    found = spark.createDataFrame([(k,) for k in days], "c string").select("c", nport.written_date(F.col("c")).alias("d"))
    assert {r.c: r.d for r in found.collect()} == days


def test_fund_reports(spark, tmp_path):
    (tmp_path / "f").write_text("ACCESSION\tNAME\n1\tEnergy Select Sector SPDR\n2\tother\n3\tUtilities select sector spdr\n4\tUtilities select sector spdr\n5\tMaterials Select Sector SPDR\n")
    (tmp_path / "s").write_text("1\t15-JAN-2024\t\t\t\t31-DEC-2023\n1\t16-JAN-2024\t\t\t\t31-DEC-2023\n3\t\t\t\t\t31-DEC-2023\n4\t1-FEB-2024\t\t\t\t30-NOV-2023\n5\t1-FEB-2024\n")
    cell = lambda a, n, w: "\t".join([a, "h", n, *[""] * 9, w])
    (tmp_path / "h").write_text("\n".join([cell("1", "Exxon Mobil Corp.", "5"), cell("1", "EXXON, MOBIL CORP", "5"), cell("1", "unknown", "1"), cell("1", "Chevron", ""), cell("2", "Chevron", "1"), cell("3", "Chevron", "1"), "1\tshort"]))
    names = spark.createDataFrame([("exxonmobilcorp", "XOM"), ("Chevron", "CVX")], "issuer string, symbol string")
    read = lambda n, places: nport.read_tsv(spark, str(tmp_path / n), places)
    held, ledger = nport.sector_holdings(read("f", nport.FUND), read("s", nport.SUBMISSION), read("h", nport.HOLDING), names, "q")
    assert [tuple(r) for r in held.collect()] == [("XLE", "XOM", date(2023, 12, 31), date(2024, 1, 15), date(2099, 12, 31), "5", "SEC-NPORT-q")]
    assert sorted(map(tuple, ledger.collect())) == [("XLE", "q", date(2023, 12, 31), date(2024, 1, 15), "1", 3, 1), ("XLU", "q", date(2023, 11, 30), date(2024, 2, 1), "4", 0, 0)]


@pytest.fixture
def base(spark):
    return f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"


TYPES = {"id": "BIGINT NOT NULL", "url": "VARCHAR(50)", "hash": "VARCHAR(50)"}


def rows_in(spark, url, table="articles"):
    return sorted(tuple(r) for r in database.read_table(spark, url, table).collect())


def test_database_conflicts_replays_and_rollbacks(spark, base):
    database.create(spark, base, "articles", TYPES, [["id"]])
    keys = [["id"], ["url"], ["hash"]]
    one = spark.createDataFrame([(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h3"), (4, None, "h4"), (5, None, None)], "id long, url string, hash string").repartition(3)
    assert database.insert_new(one, base, "articles", TYPES, keys, ["id"], "a")
    want = [(1, "u1", "h1"), (3, "u2", "h3"), (4, None, "h4"), (5, None, None)]
    assert sorted(rows_in(spark, base), key=lambda r: r[0]) == want
    assert not database.insert_new(one.withColumn("id", F.col("id") + 100), base, "articles", TYPES, keys, ["id"], "a")  # a batch that comes again
    # 6 is refused by what is stored, so it can't refuse 7
    two = spark.createDataFrame([(6, "u9", "h3"), (7, "u9", "h7"), (8, "u8", "h8")], "id long, url string, hash string")
    assert database.insert_new(two, base, "articles", TYPES, keys, ["id"], "it's b")
    assert sorted(rows_in(spark, base), key=lambda r: r[0]) == [*want, (7, "u9", "h7"), (8, "u8", "h8")]
    with pytest.raises(Exception, match="(?i)null|constraint"):
        database.in_transaction(spark, base, ["INSERT INTO articles VALUES (50, 'x', 'y')", "INSERT INTO articles VALUES (NULL, 'x', 'y')"])
    assert len(rows_in(spark, base)) == 6
    assert database.table_names(spark, base) >= {"articles", database.LEDGER} and not any(n.startswith("stage") for n in database.table_names(spark, base))


def test_database_upsert_reads_in_parts_and_pushes_down(spark, base):
    types = {"k": "BIGINT NOT NULL", "v": "DOUBLE"}
    database.create(spark, base, "bars", types, [["k"]])
    first = spark.range(100).selectExpr("id AS k", "CAST(id AS DOUBLE) AS v")
    database.upsert(first, base, "bars", types, ["k"], ["v"], "1")
    database.upsert(first.where("k >= 90").selectExpr("k + 5 AS k", "-v AS v").unionByName(first.limit(0)), base, "bars", types, ["k"], ["v"], "2")
    found = database.read_table(spark, base, "bars", "k", 4)
    assert found.rdd.getNumPartitions() == 4
    assert {r.k: r.v for r in found.collect()} == {**{k: float(k) for k in range(95)}, **{k + 5: -float(k) for k in range(90, 100)}}
    plan = database.read_table(spark, base, "bars").where("k > 3").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(k), *GreaterThan(k,3)]" in plan and "ReadSchema: struct<v:double>" in plan
    assert database.read_table(spark, base, "bars", "k").where("k < 0").count() == 0
    assert [r.v for r in database.latest(spark, base, "bars", ["v"], ["k"]).where("v = 0").collect()] == [0.0]


HREFS = ["ex-99.htm", "EXHIBIT99.htm", "x/Exhibit-99a.htm", "d99.1.htm", "d99_2", "d99-3.htm", "99.htm", "d991.htm", "#ex-99", "", "http://o.org/ex-99", "/root/ex-99.1", "ex99.htm"]


def test_exhibit_links(spark):
    html = "".join(f"<a {k} = {q}{h}{q}>" for h, k, q in zip(HREFS, ["href", "HREF"] * 7, ["'", '"'] * 7, strict=False)) + "<a href=\"ex-99.htm\"><a href='it\"s-ex-99'>"
    rows = [("f1", "2024-01-02", "d", "s", "A", "8-K/A", "https://h.org/a/b?x", html), ("f2", "2024-01-02", "d", "s", "A", "10-K", "https://h.org/a/b", html), ("f3", "2024-01-02", "d", "s", "A", "8-K", "u", None)]
    df = spark.createDataFrame(rows, "article_id string, published_at string, trading_date string, sector string, symbol string, form string, url string, html string")
    found = {r.exhibit_url: r.exhibit_name for r in exhibits.exhibit_links(df).collect()}
    base = "https://h.org/a/"
    assert found == {
        f"{base}ex-99.htm": "ex-99.htm", f"{base}EXHIBIT99.htm": "EXHIBIT99.htm", f"{base}x/Exhibit-99a.htm": "Exhibit-99a.htm", f"{base}d99.1.htm": "d99.1.htm", f"{base}d99_2": "d99_2",
        f"{base}d99-3.htm": "d99-3.htm", "http://o.org/ex-99": "ex-99", "https://h.org/root/ex-99.1": "ex-99.1", f'{base}it"s-ex-99': 'it"s-ex-99',
    }
    pages = spark.createDataFrame([(f"{base}ex-99.htm", "<p>One<script>x</script> two"), (f"{base}d99_2", "<img>--"), ("elsewhere", "x"), ("http://o.org/ex-99", None)], "url string, html string")
    made = exhibits.exhibit_articles(exhibits.exhibit_links(df), pages)
    assert {r.outcome: (r.n, r.filings) for r in exhibits.outcomes(made).collect()} == {"written": (1, 1), "empty": (2, 1), "missing": (6, 1)}
    r = made.where("outcome = 'written'").first()
    assert (r.article_id, r.filing_id, r.text, r.content_hash, r.title) == ("sec-exhibit:" + hashlib.sha256(f"{base}ex-99.htm".encode()).hexdigest(), "f1", "One two", hashlib.sha256(b"One two").hexdigest(), "ex-99.htm")


def test_filing_articles(spark):
    rows = [("f1", "8-K", "<p>Cover Item 1.01 deal<br>Item 9.01 list</p>"), ("f2", "8-K", "<style>x</style>"), ("f3", "10-Q", "text"), ("f4", "8-K/A", None)]
    df = spark.createDataFrame([(i, "p", "d", "s", "A", f, "u", h) for i, f, h in rows], "article_id string, published_at string, trading_date string, sector string, symbol string, form string, url string, html string")
    assert [(r.article_id, r.text) for r in exhibits.filing_articles(df).collect()] == [("f1", text.item_sections(text.visible(rows[0][2])))]
