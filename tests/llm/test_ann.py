"""Learned partitions against brute force: ties, repeated ids and vectors, unusable vectors, empty and small tables."""

import numpy as np
import pytest

from tidewright.llm import ann

SCHEMA = "vec_id long, embedding array<float>, part long, v string, shard int, rank int, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3, 4.0) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, every, k):
    """{query: [(vec_id, score)]} over all pairs; of a repeated query id the least vector asks."""
    fine = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    fine = [(i, v) for i, v in fine if len(v) == len(fine[0][1])]
    out = {}
    for q in {i for i, _ in fine if i % every == 0}:
        asks = min((v.tolist() for i, v in fine if i == q))
        scored = sorted((-(np.array(asks) * v).sum(), i) for i, v in fine if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def agree(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12, atol=1e-12)


def odd_rows():
    rng = np.random.default_rng(1)
    grid = rng.integers(-1, 2, (160, 4)).astype(float)  # many ties and many equal vectors
    rows = [(i, v.tolist()) for i, v in enumerate(grid)]
    rows += [(1000 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(60)]
    rows += [(20, [9.0, 1.0, 0.0, 0.0]), (20, [9.0, 1.0, 0.0, 0.0]), (7, [3.0, 3.0, 3.0, 3.0]), (-40, [1.0, 2.0, 3.0, 4.0])]
    bad = [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0]]
    return rows + [(2000 + 20 * i, v) for i, v in enumerate(bad)] + [(None, [1.0, 1.0, 1.0, 1.0])]


def test_all_parts_give_what_brute_force_gives(spark):
    """With every part asked, what is left of the method is exact: ties, repeats and unusable vectors come out right."""
    rows = odd_rows()
    agree(found(ann.search(table(spark, rows), wanted=1.0)), brute(rows, 20, 20))


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [1.0, 1.0])]])
def test_tiny_tables(spark, rows):
    got = ann.search(table(spark, rows))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    agree(found(got), {q: v for q, v in (brute(rows, 20, 20) if any(v for _, v in rows) else {}).items() if v})


def test_clustered_vectors_ask_few_parts(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (60, 24))
    x = centres[rng.integers(0, 60, 4000)] + rng.normal(0, 0.25, (4000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))]
    df, index = ann.search_with_index(table(spark, rows), 20, 20, "vec_id", "embedding", ann.SAMPLE, ann.WANTED)
    got, want = found(df), brute(rows, 20, 20)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert index.parts == ann.parts_for_rows(4000) and index.probes <= 0.15 * index.parts
    assert recall >= 0.9 and abs(recall - index.recall) < 0.04


def test_random_vectors_reach_the_wanted_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (1500, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = found(ann.search(table(spark, rows))), brute(rows, 20, 20)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    again = found(ann.search(table(spark, rows).repartition(5)))
    assert again == got


def test_parts_grow_with_the_table():
    assert [ann.parts_for_rows(n) for n in (1, 100, 10_000, 50_000, 10**9)] == [1, 12, 400, 894, ann.MOST_PARTS]


def test_cut_keeps_parts_near_their_share():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (900, 8))
    part = ann.cut_graph(ann.nearest(x, 10), ann.halve(x, 37), 37)
    sizes = np.bincount(part, minlength=37)
    assert sizes.sum() == 900 and sizes.min() >= 15 and sizes.max() <= 36


def test_copies_grow_as_queries_times_parts():
    """Rows that the comparison is given, at two sizes: vectors for each block of queries and queries for each block of vectors."""

    def copies(n):
        queries = n / 20
        return n * max(1, queries / ann.block_of(ann.QUERY_BLOCK, n)) + queries * max(1, n / ann.block_of(ann.VECTOR_BLOCK, n))

    for n in (10**6, 10**7):
        assert copies(4 * n) / copies(n) < 8.1  # 4 times the rows and twice the parts, not 16 times


def test_small_blocks_give_the_same(spark, monkeypatch):
    rows = odd_rows()
    monkeypatch.setattr(ann, "VECTOR_BLOCK", (16, 0, 16))
    monkeypatch.setattr(ann, "QUERY_BLOCK", (4, 0, 4))
    monkeypatch.setattr(ann, "SCORES", 64)
    agree(found(ann.search(table(spark, rows), wanted=1.0)), brute(rows, 20, 20))
