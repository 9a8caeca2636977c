"""Conflicts in order of arrival, places and running totals, bootstraps: against loops in memory."""

import random

import numpy as np
import pytest

from tidewright.operators import bootstrap, ordering
from tidewright.operators.arrivals import first_of_any


def loop(rows, blanks):
    """Rows (id, url, hash, story) one after another into a table with three unique columns."""
    seen, kept = set(), []
    for i, *values in sorted(rows):
        keys = {(k, v) for k, v in enumerate(values) if v is not None and (blanks or v.strip())}
        if not keys & seen:
            seen |= keys
            kept.append(i)
    return kept


CHAIN = [(i, f"u{(i + 1) // 2}", f"h{i // 2}", None) for i in range(30)]
rng = random.Random(5)
MIXED = [(i, rng.choice(["", " ", None, *(f"u{k}" for k in range(40))]), rng.choice([None, "h", *(f"h{k}" for k in range(90))]), f"s{rng.randrange(150)}") for i in range(300)]
HOT = [(i, "one", f"h{i // 2}", None) for i in range(50)] + [(100 + i, None, f"h{i}", "") for i in range(60)]


@pytest.mark.parametrize("rows", [CHAIN, MIXED, HOT, [(1, "u1", "h1", None), (2, "u2", "h1", None), (3, "u2", "h3", None)], []])
@pytest.mark.parametrize("blanks", [False, True])
def test_conflicts_in_order_of_arrival(spark, rows, blanks):
    df = spark.createDataFrame(rows, "id long, url string, `content.hash` string, story string").repartition(3)
    found = first_of_any(df, ["url", "content.hash", "story"], ["id"], blanks)
    assert found.columns == df.columns
    assert sorted(r.id for r in found.collect()) == loop(rows, blanks)


def test_places_and_running_totals(spark):
    rows = [("a" if i % 3 else None, i * 7 % 500, i % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o long, v long").repartition(5)
    want = {}
    for g in ("a", None):
        total = 0
        for nth, (_, o, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1])):
            want[g, o] = nth, total
            total += v
        want[g] = nth + 1, total
    assert {(r.g, r.o): (r.nth, r.size) for r in ordering.numbered(df, ["g"], ["o"]).collect()} == {k: (v[0], want[k[0]][0]) for k, v in want.items() if isinstance(k, tuple)}
    assert {(r.g, r.o): (r.before, r.total) for r in ordering.running(df, ["g"], ["o"], "v").collect()} == {k: (v[1], want[k[0]][1]) for k, v in want.items() if isinstance(k, tuple)}
    assert sorted(r.nth for r in ordering.numbered(df, [], ["o"]).collect()) == list(range(500))
    assert ordering.numbered(df.limit(0), [], ["o"]).collect() == []


def drawn(n, seed, replicate, block):
    """The places that a replicate draws, one by one."""
    out = []
    for s in bootstrap.starts(seed, replicate, -(-n // block), n):
        out += [(int(s) + k) % n for k in range(block)]
    return out[:n]


@pytest.mark.parametrize(("n", "block"), [(1, 20), (7, 20), (20, 20), (21, 20), (100, 7), (99, 1)])
def test_weights_count_the_draws(n, block):
    for r in range(5):
        want = np.bincount(drawn(n, 3, r, block), minlength=n)
        assert (bootstrap.weights(np.arange(n), n, 3, r, block) == want).all() and want.sum() == n


def area(x, y):
    pos, neg = x[y == 1], x[y == 0]
    return ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg)) if len(pos) and len(neg) else None


@pytest.mark.parametrize("batch", [1 << 18, 16])
def test_bounds_equal_a_loop_with_the_same_draws(spark, monkeypatch, batch):
    monkeypatch.setattr(bootstrap, "BATCH", batch)
    monkeypatch.setitem(bootstrap.batches_of.__globals__, "BATCH", batch)
    g = np.random.default_rng(1)
    rows, want = [], {}
    for s, n in ((0, 90), (1, 45), (4, 3)):
        x, y = np.round(g.random(n) * 12), (g.random(n) < (0.4 if s < 4 else 0)).astype(int)
        rows += [(s, i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
        picks = [drawn(n, 7 + s, r, 8) for r in range(60)]
        means, areas = sorted(x[p].mean() for p in picks), sorted(a for p in picks if (a := area(x[p], y[p])) is not None)
        want[s] = means[int(0.025 * 59)], areas[int(0.025 * (len(areas) - 1))] if areas else 0.5, len(areas)
    df = spark.createDataFrame(rows, "s long, i long, x double, y int").repartition(4)
    means = bootstrap.mean_lower_bound(df, "i", "x", "s", block=8, replicates=60)
    assert {r.series: (r.lower, r.replicates) for r in means.collect()} == {s: (pytest.approx(m), 60) for s, (m, _, _) in want.items()}
    areas = bootstrap.auc_lower_bound(df, "i", "x", "y", "s", block=8, replicates=60)
    assert {r.series: (r.lower, r.replicates) for r in areas.collect()} == {s: (pytest.approx(a), k) for s, (_, a, k) in want.items()}
