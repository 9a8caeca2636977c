"""Ranked search, Merkle manifests and decontamination: small tables with every odd row, against DuckDB and brute force."""

import os
import re
import zlib
from collections import Counter
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewright.llm import decontaminate as dc
from tidewright.llm import lexical, merkle, queries

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, h long, `w.x` string, tree string, path string, n int"
ITEMS = "item_id long, text string, ids string, n int"
ITEM = "What is the capital city of the small country that lies between the two seas in the far north?"
PASSAGE = "the capital city of the small country that lies between the two seas"
MANY = " ".join(f"w{i * i % 977}" for i in range(9000))
TEXTS = [
    (1, f"Before it {ITEM.upper()} after it", "en", "b"),
    (2, f"Only ten: {PASSAGE.replace(' ', ' -- ')} and no more", "en", "b"),
    (3, "nine words: the capital city of the small country that lies, but not ten", "en", None),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t ", None, "a"),
    (7, "Änderung ÄNDERUNG änderung İ Σίσυφος straße naïve 日本語 🙂", "de", "é"),
    (8, f"{MANY} {ITEM} {MANY} {ITEM} {ITEM}", "en", "b"),
    (9, "yes", "en", "b"),
    (10, "YES, no. yes", "en", "b"),
    (11, "x y x y x y x y x y x y x y", "en", "b"),
    (None, "yes", "en", None),
    (None, "yes", "en", None),
    (12, "the same id", "en", "b"),
    (12, "the same id", "en", "b"),
    (12, "another Text of one id", "fr", "a"),
    (-3, "q-1 9_9 a`b{c@d[e/f:g" + chr(0) + "h\x7fi", "en", "b"),
    *((100 + i, f"Common words of group {i % 3}", "en", "c") for i in range(40)),
]
QUESTIONS = [
    (1, ITEM),
    (2, "yes"),
    (3, "yes"),
    (3, f"another item holds {PASSAGE} too"),
    (4, None),
    (5, " ?! "),
    (6, "Änderung straße"),
    (7, "x y x y x y x y x y"),
    (8, "common words of group 1 common common"),
    (None, "naïve 日本語 🙂"),
    (9, "not there at all in any of the documents nor anywhere else"),
    (10, "w0 w1 w4 w9 w16"),
]


def docs_of(spark, rows=TEXTS, parts=3):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, "x", "y", "z", 1) for i, t, lang, s in rows], DOCS).repartition(parts)


def items_of(spark, rows=QUESTIONS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], ITEMS)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables as files, for queries and DuckDB alike."""
    out = str(tmp_path_factory.mktemp("tables"))
    docs_of(spark).coalesce(1).write.parquet(f"{out}/documents.parquet")
    items_of(spark).coalesce(1).write.parquet(f"{out}/benchmark.parquet")
    return out


def ordered(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("where", ["small", "data"])
@pytest.mark.parametrize("name", ["op11_ranked_search", "op12_merkle_manifest", "op13_decontaminate"])
def test_queries_equal_their_twins(spark, folder, name, where):
    if where == "data" and not os.path.isdir(DATA):
        pytest.skip("no data")
    at = folder if where == "small" else DATA
    found, con = queries.QUERIES[name](spark, at), duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet{'/*.parquet' if where == 'small' else ''}'")
    twin = con.sql(queries.SQL[name])
    assert ordered(map(tuple, found.collect())) == ordered(tuple(r[twin.columns.index(c)] for c in found.columns) for r in twin.fetchall())


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_words_are_those_of_the_pattern(spark):
    found = {r.text: r.w for r in docs_of(spark).select("text", dc.words(F.coalesce("text", F.lit(""))).alias("w")).collect()}
    assert all(found[t] == words(t) for _, t, _, _ in TEXTS)
    assert [[x.decode() for x in lexical.terms(t or "")] for _, t, _, _ in TEXTS] == [words(t) for _, t, _, _ in TEXTS]


def windows(item, n=10):
    w = words(item)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_contamination(texts, items):
    out = []
    for doc_id, text, *_ in texts:
        w, at, ids = words(text), set(), set()
        for item_id, item in items:
            for x in windows(item):
                for i in range(len(w) - len(x) + 1):
                    if tuple(w[i : i + len(x)]) == x:
                        at.add((i, len(x)))
                        ids.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(w), sorted(at), sorted(ids)))
    return out


def contamination(df):
    return [(r.doc_id, r.n_words, [tuple(x) for x in r.occurrences], r["items"]) for r in df.collect()]


def test_decontamination_against_brute_force(spark, monkeypatch):
    short = [(i, t if len(t or "") < 5000 else f"{ITEM} {t[:3000]} {PASSAGE}", lang, s) for i, t, lang, s in TEXTS]
    whole = brute_contamination(short, QUESTIONS)
    assert ordered(contamination(dc.decontaminate(docs_of(spark, short), items_of(spark)))) == ordered(whole)
    # dictionaries in several blocks, and repeated rows a few at a time
    monkeypatch.setattr(dc, "MOST_WINDOWS", 3)
    monkeypatch.setattr(dc, "MOST_SHINGLES", 5)
    monkeypatch.setattr(dc, "REPEATS", 1)
    assert ordered(contamination(dc.decontaminate(docs_of(spark, short), items_of(spark)))) == ordered(whole)


def test_decontamination_of_empty_tables(spark):
    none, no_items = docs_of(spark).limit(0), items_of(spark).limit(0)
    assert contamination(dc.decontaminate(none, items_of(spark))) == []
    assert ordered(contamination(dc.decontaminate(docs_of(spark), no_items))) == ordered((i, len(words(t)), [], []) for i, t, *_ in TEXTS)
    assert ordered(contamination(dc.decontaminate(docs_of(spark), items_of(spark, [(1, None), (2, "..")])))) == ordered((i, len(words(t)), [], []) for i, t, *_ in TEXTS)


def test_decontamination_is_native_and_never_shuffles_texts(spark, folder):
    plan = queries.op13_decontaminate(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def brute_search(texts, items, k=10):
    import math

    held = [(d, Counter(words(t)), len(words(t))) for d, t, *_ in texts if words(t)]
    n_docs, n_terms = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("k", [1, 3, 10])
def test_search_against_brute_force(spark, monkeypatch, k):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 4)
    monkeypatch.setattr(lexical, "QUERY_BYTES", 60)
    monkeypatch.setattr(lexical, "FAN_IN", 2)
    found = lexical.search(docs_of(spark, parts=5), items_of(spark), k)
    assert ordered(map(tuple, found.collect())) == ordered(brute_search(TEXTS, QUESTIONS, k))


def test_search_of_empty_tables(spark):
    docs, items = docs_of(spark), items_of(spark)
    assert lexical.search(docs.limit(0), items).collect() == []
    assert lexical.search(docs, items.limit(0)).collect() == []
    assert lexical.search(docs.where("doc_id in (4, 5, 6)"), items).collect() == []


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def h(x):
    return sha256(x.encode()).hexdigest()


def fold(nodes):
    """Levels of a tree, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, path as (place, run)) of each row."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0], h("".join(map(field, row)))))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: fold([x for _, x in sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]) for s in sources}
    top, out = fold([trees[s][-1][0] for s in sources]), []

    def path(levels, i):
        return [(i // 16**k % 16, "".join(level[i // 16 ** (k + 1) * 16 :][:16])) for k, level in enumerate(levels[:-1])]

    for at, s in enumerate(sources):
        for i, (doc_id, leaf) in enumerate(sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], path(trees[s], i) + path(top, at)))
    return out


def table(n, sources):
    return [(i * 7 % n, f"s{i * i % sources}", None if i % 5 else "en", i % 11, f"Text {i}") for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(1, 1), (2, 2), (16, 1), (17, 1), (300, 1), (300, 20), (700, 400)])
def test_manifest_against_brute_force(spark, n, sources):
    rows = table(n, sources)
    found = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3), most=1)  # blocks of 16: several rounds up and down
    assert ordered((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in found.collect()) == ordered(brute_manifest(rows))


def test_manifest_of_blocks_of_full_height(spark):
    rows = table(4400, 1)
    found = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string"))
    assert ordered((r.doc_id, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in found.collect()) == ordered(brute_manifest(rows))


def test_manifest_of_no_rows(spark):
    assert merkle.manifest(docs_of(spark).limit(0)).collect() == []


def test_only_changed_rows_fail(spark, folder):
    rows = queries.op12_merkle_manifest(spark, folder).collect()
    texts = {i: t for i, t, *_ in TEXTS}
    for r in rows:
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and bool(re.search("[A-Z]", texts[r.doc_id] or ""))
        assert r.verified is not changed or r.doc_id == 12  # 12 has two texts


def test_traversal_holds_a_run_or_two_a_level():
    levels, nodes = 3, [h(str(i)) for i in range(16**3)]
    held = 0
    for path in merkle.traverse(nodes, levels):
        held = max(held, sum(len(run) // merkle.DIGITS for _, run in path))
    assert held == 16 * levels
