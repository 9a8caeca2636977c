"""The pipeline's run() against brute force on a small corpus with nulls, empty texts, copies, near copies and clashing columns."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from tidewright.llm import jaccard_join, langid, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, digest string, __id string, whole string"
WORDS = {"en": "the of and to in that is was for with on as by at from", "fr": "le la de et les des est une dans pour qui sur par plus au"}


def corpus():
    rng, rows = np.random.default_rng(3), []
    for i in range(150):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 60)), lang, "abc"[i % 3]))
    rows += [(200 + i, rows[i][1], rows[i][2], "a") for i in range(12)]  # exact copies
    rows += [(300 + i, rows[i][1].replace(" ", "  ", 1) + " end", rows[i][2], None) for i in range(20, 26)]  # near copies
    rows += [(400, None, "en", "a"), (401, "", "en", "b"), (402, "123 !?", "fr", "c"), (None, rows[40][1], "en", "a"), (None, None, None, None), (7, rows[7][1], "fr", "b")]
    return [(*r, 1, 2, "d", "x", "y") for r in rows]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows given, what each stage kept, what run() returns)."""
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(folder))
        assert out.columns == docs.columns
        kept.append([tuple(r) for r in out.collect()])
        docs = spark.createDataFrame(kept[-1], SCHEMA)
    return docs, kept, corpus_pipeline.run(spark, str(folder)).collect()


def test_language_keeps_what_its_model_is_sure_of(spark, stages):
    given = spark.createDataFrame(corpus(), SCHEMA)
    model = langid.train(given)
    want = [r for r in corpus() if model.predict(r[1])[0] != "und" and model.predict(r[1])[1] >= corpus_pipeline.LEAST_SCORE]
    assert Counter(stages[1][0]) == Counter(want)
    assert {r[0] for r in corpus() if r[1] and r[1][0].isalpha()} == {r[0] for r in stages[1][0]}


def test_of_equal_texts_the_largest_id_stays(stages):
    best = {}
    for r in stages[1][0]:
        best[r[1]] = max(best.get(r[1], (-1,)), (-1 if r[0] is None else r[0],))
    assert Counter((r[0] if r[0] is not None else -1, r[1]) for r in stages[1][1]) == Counter((v[0], k) for k, v in best.items())


def test_one_of_each_group_of_near_copies_stays(stages):
    rows, known = stages[1][1], jaccard_join.hasher()
    sets = [set(jaccard_join.shingles(r[1] or "", known).tolist()) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    want = {min((i for i in range(len(rows)) if group[i] == g), key=order) for g in set(group)}
    assert Counter(stages[1][2]) == Counter(rows[i] for i in want)
    assert len(stages[1][2]) < len(rows)


def test_the_mix_and_the_packing_of_what_is_left(spark, stages):
    docs, kept, found = stages
    taken = Counter()
    for r in mixing.mix_sources(spark.createDataFrame(kept[2], SCHEMA)).collect():
        taken[r.doc_id] += r.copies
    assert Counter(r[0] for r in kept[3]) == +taken
    from tokenizers import Tokenizer

    code, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for r in kept[3]:
        ids = np.array([*code.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)]
        want.update((r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= sum(r.length for r in found) / 1024 * 1.1 + 1


def test_an_empty_table_gives_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
