"""Operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup, jaccard_join, langid, licenses, mixing, mixing_lm, packing, token_store, tokens, unigram_counts
from tidewright.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, digest string, rep int, part string"
LONG = " ".join(f"w{i * i % 977}" for i in range(9000))
TEXTS = [
    (1, "The cat sat on the mat and looked at the moon over the sea.", "en", "a"),
    (2, "the cat sat on the mat and looked at the moon over the sea.", "en", "a"),
    (3, "Le chat est sur la table avec le chien et la souris.", "fr", None),
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, "   \n\t ", None, "b"),
    (7, "12345 !!! ###", "en", "c"),
    (8, LONG, "en", "c"),
    (9, LONG, "en", "c"),
    (10, "Licensed under CC BY-NC 4.0. MIT License\nSPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0+)", "en", "a"),
    (11, "\tTab first \t then.  Double  space\n\n two lines naïve é 日本語 🙂\x1c\x85 end ", "en", "é"),
    (None, "no id here at all", "en", "a"),
    (None, "no id here at all", "en", "a"),
    (12, "same id", "en", "a"),
    (12, "same id", "en", "a"),
    (12, "another text of one id", "fr", "b"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), 1, "x", 2, "y") for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(t):
    return t or ""


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize(("name", "units"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaced")])
def test_units_encode_as_whole_texts(name, units):
    whole, own = tokenizer(name), tokens.Encoder(public_tokenizers.path(name), units, size=50)
    rng = np.random.default_rng(1)
    odd = ["a", "B", "é", " ", " ", "\n", ".", ",", "'s", "\t", "\x1c", "\xa0", "ß", "1", "日", "🙂", "é", "word", "Word.", "\nLine,"]
    for t in [*(text_of(t) for _, t, _, _ in TEXTS), *("".join(rng.choice(odd, rng.integers(0, 30))) for _ in range(1500))]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_segments_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 5000):
        for most in (1, 2, 300, 50_000, 1 << 32):
            ids = rng.integers(0, most, n, dtype=np.uint64).astype(np.uint32)
            if n > 5:
                ids[rng.integers(0, n, 5)] = (1 << 32) - 1
            lengths = np.array([n], np.int64)
            got, doc_ids, ls = token_store.unpack_segment(token_store.pack_segment(ids, np.array([7]), lengths))
            assert (got == ids).all() and doc_ids.tolist() == [7] and ls.tolist() == [n]
            if n > 300:
                part, _, _ = token_store.unpack_segment(token_store.pack_segment(ids, np.array([7]), lengths), 1, 2)
                assert (part == ids[128:256]).all()


def test_token_store(docs, none):
    whole = tokenizer("word_bpe_49k.json")
    found = sorted(token_store.token_store(docs, public_tokenizers.path("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    want, at = [], 0
    for i, t in sorted(((i, text_of(t)) for i, t, _, _ in TEXTS), key=lambda r: (-1 if r[0] is None else r[0], r[1])):
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found] == want
    assert token_store.token_store(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_unigram_counts(docs, none):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    whole = Tokenizer(models.Unigram(unigram_counts.unigram_vocabulary(path), 0, True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    found = sorted((r.n_tokens) for r in unigram_counts.count_tokens(docs, path).collect())
    assert found == sorted(len(whole.encode(text_of(t), add_special_tokens=False).ids) for _, t, _, _ in TEXTS)
    assert unigram_counts.count_tokens(none, path).count() == 0


def test_unigram_ties():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = np.random.default_rng(3)
    for _ in range(60):
        words = {"".join(rng.choice(list("ab▁"), rng.integers(1, 4))) for _ in range(8)}
        vocabulary = [("<unk>", -5.0), *((w, float(-rng.integers(1, 4))) for w in sorted(words))]
        whole, own = Tokenizer(models.Unigram(vocabulary, 0, False)), unigram_counts.Counter(vocabulary, False)
        whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        for _ in range(20):
            t = "".join(rng.choice(list("aabbc "), rng.integers(0, 12)))
            assert own.count(t)[0] == len(whole.encode(t, add_special_tokens=False).ids), (vocabulary, t)


def test_packing(spark, docs, none):
    whole = tokenizer("byte_bpe_50k.json")
    found = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), leaf_items=3).collect()
    want = []
    for i, t, _, _ in TEXTS:
        ids = np.array([*whole.encode(text_of(t), add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(want, key=key)
    in_order(found)
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def in_order(found):
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in sequences.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_packing_tree_is_nearly_full(spark):
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 1024, 3000).tolist()
    items = spark.createDataFrame(list(enumerate(sizes)), "item long, length long")
    placed = packing.pack_items(items, 3000, leaf_items=500).join(items, "item").selectExpr("bin sequence_id", "offset", "length").collect()
    assert len(placed) == 3000
    assert in_order(placed) <= 1.04 * sum(sizes) / 1024 + 1
    same = spark.range(400).selectExpr("id item", "600L length")
    assert packing.pack_items(same, 400, leaf_items=50).select("bin").distinct().count() == 400


def test_licenses(docs, none):
    found = {(r.doc_id, r.n_words): r for r in licenses.scan_licenses(docs).collect()}
    for i, t, _, _ in TEXTS:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text_of(t))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = sorted((k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())
        r = found[i, len(words)]
        assert (r.n_base, r.first_word, r.last_word) == (len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
    r = next(r for r in found.values() if r.doc_id == 10)
    assert r.labels == "apache-2.0,cc-by,cc-by-nc,gpl-2.0+,mit" and r.permissive is True and r.score == 1.0
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize(("e", "want"), [("MIT", True), ("GPL-2.0", False), ("MIT AND GPL-2.0", False), ("MIT AND GPL-2.0 OR ISC", True), ("MIT AND (GPL-2.0 OR ISC)", True), ("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", True), ("MIT or", None), ("(MIT", None), ("", None), ("MIT */ more", True), ("(MIT OR GPL-2.0) WITH foo", None), ("MIT WITH (foo)", None), ("GPL-2.0 WITH foo", False), ("MIT/Apache-2.0", True), ("MIT/GPL-2.0", True)])
def test_expressions(e, want):
    parsed = licenses.postfix(e)
    assert (licenses.evaluate(parsed)[0] if parsed else None) == want


def test_language(spark, none):
    rng = np.random.default_rng(5)
    vocabulary = {"en": "the of and to in that is was for with".split(), "fr": "le la de et les des est une dans pour".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 30)), lang, "s", 1, 1, "", 1, "") for i in range(300) for lang in [("en", "fr")[i % 2]]]
    rows += [(1000, None, "en", "s", 1, 1, "", 1, ""), (1001, "123 !", "fr", "s", 1, 1, "", 1, ""), (None, "the of and", None, "s", 1, 1, "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(docs)
    found = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(found[i].held_out and found[i].lang_pred == ("en", "fr")[i % 2] for i in held)
    assert found[1000].lang_pred == found[1001].lang_pred == "und" and found[None].lang_pred == "en" and found[None].held_out
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.keep_identified(docs, model, 0.35).count() == 301
    empty = langid.train(none)
    assert langid.identify(none, empty).count() == 0 and {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_grams_of_pieces_are_those_of_the_whole(monkeypatch):
    text = "Äpfel und Birnen 12 " * 50
    whole = Counter(np.concatenate(list(langid.grams(text))).tolist())
    monkeypatch.setattr(langid, "PIECE", 37)
    assert Counter(np.concatenate(list(langid.grams(text))).tolist()) == whole


def test_exact_dedup(docs, none):
    for counters in (1, 2, 1024):
        found = exact_dedup.exact_dedup(docs, counters=counters).collect()
        assert len(found) == len(TEXTS)
        sizes = Counter(text_of(t) for _, t, _, _ in TEXTS)
        assert sorted(r.group_size for r in found) == sorted(sizes[text_of(t)] for _, t, _, _ in TEXTS)
        assert sum(r.kept for r in found) == len(sizes)
        assert all(r.doc_id == r.keep_id for r in found if r.kept)
        assert {r.keep_id for r in found if r.doc_id == 4} == {5}
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and sorted(text_of(r.text) for r in kept.collect()) == sorted(sizes)
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.kept_rows(none).count() == 0


def test_misra_gries_finds_every_frequent_key(spark):
    rows = [("hot",)] * 500 + [(f"k{i % 300}",) for i in range(600)] + [("warm",)] * 200
    found = {r.k for r in exact_dedup.misra_gries(spark.createDataFrame(rows, "k string").repartition(90), "k", 8).collect()}
    assert {"hot", "warm"} <= found and len(found) <= 8


def near_texts():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words, 200).tolist() for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for g in (0, 1):  # a large group of near copies, and a small one
        for k in range(90 if g == 0 else 5):
            t = list(base[g])
            t[int(rng.integers(0, 200))] = f"x{k}"
            rows.append((100 * (g + 1) + k, " ".join(t)))
    rows += [(400 + k, " ".join(base[3])) for k in range(20)]
    passage = base[5][:70]
    rows += [(500 + k, " ".join(passage + rng.choice(words, 110).tolist())) for k in range(40)]
    return rows + [(600, ""), (601, None), (602, "one two"), (603, "One  two"), (None, "one two")]


def test_jaccard_join(spark, none, monkeypatch):
    rows = near_texts()
    known = jaccard_join.hasher()
    sets = [set(jaccard_join.shingles(text_of(t), known).tolist()) for _, t in rows]
    n, group = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x == y or len(x & y) / len(x | y) >= 0.8:
                n[a], n[b] = n[a] + 1, n[b] + 1
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    want = sorted((str(rows[i][0]), str(least[group[i]]), n[i]) for i in range(len(rows)))
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 1, "", 1, "") for i, t in rows], SCHEMA).repartition(5)
    for small, task, block in ((48, 2048, 384), (8, 30, 16)):  # also with buckets and groups that are split on
        monkeypatch.setattr(jaccard_join, "SMALL", small)
        monkeypatch.setattr(jaccard_join, "TASK_ROWS", task)
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in jaccard_join.jaccard_join(docs).collect()) == want
    kept = jaccard_join.first_of_each_class(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert jaccard_join.jaccard_join(none).count() == 0


def test_jaccard_recall_does_not_fall_with_depth(spark, monkeypatch):
    runs = jaccard_join.runs_for(jaccard_join.TARGET)
    assert all(jaccard_join.recall(0.8, levels, runs) >= jaccard_join.TARGET for levels in range(jaccard_join.MOST_LEVELS + 1))
    assert jaccard_join.recall(0.8, jaccard_join.MOST_LEVELS, runs - 1) < jaccard_join.TARGET
    assert jaccard_join.runs_for(0.9) < runs < jaccard_join.runs_for(0.998)
    with pytest.raises(ValueError, match="no number of runs"):
        jaccard_join.runs_for(1.0)
    rng = np.random.default_rng(3)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
    boilerplate, texts = words(150), []
    for _ in range(400):  # pairs alike by 0.80 to 0.85, unlike all others but for the boilerplate
        own, k = words(104), int(rng.integers(21, 28))
        texts += [" ".join(boilerplate + own), " ".join(boilerplate + own[:-k] + words(k))]
    known = jaccard_join.hasher()
    sets = [set(jaccard_join.shingles(t, known).tolist()) for t in texts]
    want = [sum(len(x & y) >= 0.8 * len(x | y) for y in sets) - 1 for x in sets]
    assert sum(want) == len(texts)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(jaccard_join, "TASK_ROWS", 1)  # as deep as it gets
    found = {r.doc_id: r.n_links for r in jaccard_join.jaccard_join(docs).collect()}
    assert all(found[i] <= n for i, n in enumerate(want)) and sum(found.values()) >= 0.985 * len(texts)


def test_bucket_edges_join_all_that_look_alike():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 1 << 32, (60, 64), dtype=np.uint64).astype(np.uint32)[rng.integers(0, 60, 300)]
    tokens[rng.random(tokens.shape) < 0.1] += np.uint32(1)
    for n in (2, 40, 300):
        t, forest = tokens[:n], jaccard_join.Forest(n)
        for a, b in jaccard_join.bucket_edges(t):
            assert forest.join(a, b)
        alike = (t[:, None] == t[None]).sum(2) >= jaccard_join.LOOKS_ALIKE * 64
        assert all(forest.find(a) == forest.find(b) for a, b in zip(*np.nonzero(alike), strict=True))


def test_search(spark):
    from tidewright.llm import ann

    rng = np.random.default_rng(11)
    x = np.repeat(rng.normal(size=(200, 8)), 5, axis=0)  # many equal vectors
    x[-300:] = x[0]
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    for k, wanted, least in ((20, 0.96, 0.9), (150, 0.01, 0.0)):  # also with more than a part holds
        got: dict = {}
        for r in ann.search(vectors, k=k, wanted=wanted).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
        assert sorted(got) == list(range(0, 1000, 20))
        hits = 0
        for q, found in got.items():
            score = x @ x[q]
            assert sorted(found) == list(range(1, k + 1)) and q not in {v for v, _ in found.values()}
            assert all(s == pytest.approx(score[v]) for v, s in found.values())
            best = np.sort(np.delete(score, q))[-k]
            hits += sum(s >= best - 1e-9 for _, s in found.values())
        assert hits >= least * k * len(got)


def test_sketch_shares_of_equal_tokens():
    rng = np.random.default_rng(7)
    x = jaccard_join.mix(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    alike = [(jaccard_join.sketch(np.sort(x[a : a + 900])) == jaccard_join.sketch(np.sort(x[a + 100 : a + 1000]))).mean() for a in range(0, 2000, 100)]
    assert abs(np.mean(alike) - 0.8) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (102, 101), (101, 101), (None, 5), (3, 3), (200, 200)] + [(300, 300 + i) for i in range(40)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and {found[i] for i in (100, 101, 102)} == {100} and found[339] == 300 and 200 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_mixing(spark, docs, none):
    found = mixing.mix_sources(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", text_of(t)))
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in found) == sorted((str(i), size(t), str(s)) for i, t, _, s in TEXTS)
    assert all(r.taken == r.copies * r.size <= 3 * r.size for r in found)
    goals = {r.source: (r.source_size, r.target) for r in found}
    left = dict.fromkeys(sorted((s for s in goals if s is not None), key=lambda s: s.encode()) + ([None] if None in goals else []))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(left)}
    total, capped = sum(g[0] for g in goals.values()), set()
    while True:  # water filling, one cap after another
        rest = total - sum(3 * goals[s][0] for s in capped)
        level = rest / sum(weight[s] for s in left if s not in capped)
        over = {s for s in left if s not in capped and weight[s] * level > 3 * goals[s][0] + 1e-9}
        if not over:
            break
        capped |= over
    for s, (n, goal) in goals.items():
        assert goal == pytest.approx(3 * n if s in capped else weight[s] * level)
    assert mixing.mix_sources(none).count() == 0
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in found)
    # each name of a row as often as its rows are taken, under names with dots and names that the operator uses itself
    odd = docs.withColumn("x.y", F.lit(1)).withColumn("copies", F.lit("c")).withColumn("nth", F.lit(None).cast("string")).withColumn("whole", F.lit(2))
    mixed = mixing.mixed_rows(odd)
    assert mixed.columns == odd.columns
    taken = Counter()
    for r in found:
        taken[r.doc_id, r.source, r.size] += r.copies
    assert Counter((r.doc_id, r.source, size(r.text)) for r in mixed.collect()) == +taken
    assert mixing.mixed_rows(none).count() == 0


def test_mixing_is_near_its_targets_and_fair(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(1, 60)), "en", "abcd"[i % 7 % 4], 1, 1, "", 1, "") for i in range(4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix_sources(docs, block=64).toPandas()
    taken = found.groupby("source").agg(t=("target", "first"), n=("taken", "sum"), m=("size", "max"))
    assert ((taken.n - taken.t).abs() <= taken.m).all()
    few = docs.where("doc_id < 400")
    draws = [{r.doc_id: (r.copies, r.target / r.source_size) for r in mixing.mix_sources(few, seed=s).collect()} for s in range(6)]
    assert all(math.floor(rate) <= c <= math.ceil(rate) for d in draws for c, rate in d.values())
    for source in range(4):  # every document is as likely as another: means over documents and seeds are near the rate
        of = [d[i] for d in draws for i in d if i % 7 % 4 == source]
        assert np.mean([c for c, _ in of]) == pytest.approx(of[0][1], abs=0.06)
    fractional = [i for i in draws[0] if 0.2 < draws[0][i][1] % 1 < 0.8]
    assert fractional and np.mean([len({d[i][0] for d in draws}) == 2 for i in fractional]) > 0.5


def test_language_model(spark, none):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in "ab cd ef gh ij kl mn op".split() for b in "q rs tu vw".split()]
    rows = []
    for i in range(400):
        t, w = [], int(rng.integers(0, 32))
        for _ in range(60):
            w = (w * 5 + int(rng.integers(0, 2))) % 32  # the next word depends on the last
            t.append(words[w])
        rows.append((i, " ".join(t), "en", "s", 1, 1, "", 1, ""))
    rows += [(1000, None, "en", "s", 1, 1, "", 1, ""), (1001, "Unseen WORDS ünd 日本", "en", "s", 1, 1, "", 1, ""), (None, "abq", "en", "s", 1, 1, "", 1, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing_lm.score_texts(docs).collect()
    assert len(found) == len(rows)
    texts = {r[0]: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")), None] for r in rows}
    learn = Counter(w for i, t in texts.items() for w in t if i is not None and zlib.crc32(str(i).encode()) % 7 != 2)
    total, distinct = sum(learn.values()), len(learn)
    for r in found:
        t = texts[r.doc_id]
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(learn[w] > 0 for w in t), total)
        assert r.base_score == pytest.approx(sum(math.log10((learn[w] + 1) / (total + distinct + 1)) for w in t))
        assert r.score < 0
    held = [r for r in found if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)
    assert mixing_lm.score_texts(none).count() == 0


def test_model_probabilities_add_up():
    """Over all symbols of the tree, a context's probabilities are one."""
    weights = np.array([5, 3, 2, 1, 1, 1, 7])
    tree = mixing_lm.Tree.of(weights)
    p = 1 / (1 + np.exp(-tree.prior.astype(float)))
    total = 0.0
    for k in range(len(weights)):
        at = slice(tree.start[k], tree.start[k] + tree.length[k])
        q = p[tree.node[at]]
        total += np.prod(np.where(tree.bit[at] == 1, q, 1 - q))
    assert total == pytest.approx(1)


@pytest.mark.parametrize(("name", "units"), [("byte_bpe_50k.json", "spaced"), ("word_bpe_49k.json", "words")])
def test_ids_equal_the_librarys(name, units):
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path(name), np.random.default_rng(5)
    ours, whole = tokens.Encoder(path, units, 500), Tokenizer.from_file(path)
    bits = ["a", "The", "WORD", "é", "É", "İ", "ß", "ǆ", "क़", "你好", " ", "  ", "\n", "\t", "\r\n", "\xa0", ".", ",", "'s", "12", "-", "Ġ", "<|endoftext|>"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(5000)] + ["", " ", "a" * 5000, "A b, " * 3000]
    for text in texts:
        assert ours.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
