"""Boosted trees by histograms against a plain version that looks at every row of every node."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import boosted
from tidewright.operators.boosted import Setting

FEATURES = ["a", "b.c", "d"]


def table(spark, n=260, seed=2):
    g = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, d = g.normal(), float(g.integers(0, 6)), g.normal()
        y = int(g.random() < 1 / (1 + math.exp(-(1.5 * a - 0.8 * (b > 3) + (d if d == d else 0) * a))))
        rows.append((i, i // 11, "validate" if i % 4 == 3 else "beyond" if i % 29 == 5 else "train", y, a, None if i % 9 == 0 else b, float("nan") if i % 13 == 0 else d))
    df = spark.createDataFrame(rows, "id long, day long, part string, label int, a double, `b.c` double, d double")
    return df.repartition(3), rows


def soft(g, a):
    return math.copysign(max(abs(g) - a, 0), g)


def plain(x, y, ids, checked, days, s: Setting, rounds, seed, objective):
    """(losses, sums by round) of trees grown row by row; x holds bins, 0 for missing."""
    n, unit = len(y), boosted.UNIT
    sums, losses, history = [0.0] * n, [], []
    for turn in range(rounds):
        if objective == "logistic":
            p = [1 / (1 + math.exp(-v)) for v in sums]
            g, h = [p[i] - y[i] for i in range(n)], [p[i] * (1 - p[i]) for i in range(n)]
        else:
            g, h = [0.0] * n, [0.0] * n
            for i in range(n):
                for j in range(n):
                    if days[i] == days[j] and y[i] > y[j]:
                        r = 1 / (1 + math.exp(sums[i] - sums[j]))
                        for k, sign in ((i, -1), (j, 1)):
                            g[k] += sign * r
                            h[k] += r * (1 - r)
        g, h = [round(v * unit) for v in g], [round(v * unit) for v in h]
        drawn = boosted.uniform(np.array(ids), seed, turn)
        used = [i for i in range(n) if not checked[i] and drawn[i] < s.rows]
        columns = boosted.chosen(len(x[0]), s.columns, seed, turn)

        def value(rows):
            return -soft(sum(g[i] for i in rows) / unit, s.absolutes) / (sum(h[i] for i in rows) / unit + s.squares) * s.rate

        def score(rows):
            return soft(sum(g[i] for i in rows) / unit, s.absolutes) ** 2 / (sum(h[i] for i in rows) / unit + s.squares)

        def grown(rows, everyone, depth):
            best = None
            for f in columns if depth else []:
                for cut in range(1, boosted.BINS - 1):
                    for lost in (False, True):
                        goes = lambda i, f=f, cut=cut, lost=lost: lost if x[i][f] == 0 else x[i][f] <= cut
                        left, right = [i for i in rows if goes(i)], [i for i in rows if not goes(i)]
                        if min(sum(h[i] for i in left), sum(h[i] for i in right)) / unit >= s.least_weight:
                            gain = round(score(left) + score(right) - score(rows), 9)
                            if gain > boosted.LEAST_GAIN and (best is None or gain > best[0]):
                                best = gain, left, right, goes
            if best is None:
                for i in everyone:
                    sums[i] += value(rows)
                return
            grown(best[1], [i for i in everyone if best[3](i)], depth - 1)
            grown(best[2], [i for i in everyone if not best[3](i)], depth - 1)

        grown(used, range(n), s.depth)
        if objective == "logistic":
            losses.append(-np.mean([math.log(1 / (1 + math.exp(-sums[i] if y[i] else sums[i]))) for i in range(n) if checked[i]]))
        else:
            losses.append(np.mean([math.log1p(math.exp(sums[j] - sums[i])) for i in range(n) if checked[i] for j in range(n) if days[i] == days[j] and y[i] > y[j]]))
        history.append(list(sums))
    return losses, history


SETTINGS = [Setting(2, 0.3, 1.0, 0.0, 1.0, 1.0), Setting(3, 0.2, 10.0, 1.0, 0.8, 0.8), Setting(1, 0.5, 25.0, 5.0, 1.0, 1.0, 3.0)]


@pytest.mark.parametrize("objective", ["logistic", "pairwise"])
def test_trees_equal_those_of_a_plain_loop(spark, objective, monkeypatch):
    monkeypatch.setattr(boosted, "BINS", 12)
    df, rows = table(spark, 150 if objective == "pairwise" else 260)
    if objective == "pairwise":  # a day is in one part
        df = df.withColumn("part", F.when(F.col("day") % 4 == 3, "validate").otherwise("train"))
        rows = [(*r[:2], "validate" if r[1] % 4 == 3 else "train", *r[3:]) for r in rows]
    model = boosted.train(df, FEATURES, SETTINGS, ["id"], rounds=4, patience=0, objective=objective, session="day" if objective == "pairwise" else None, bins=12, block=40)
    rows = [r for r in rows if r[2] != "beyond"]
    ids = {r.id: r.h for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    x = np.stack([boosted.binned(np.array([np.nan if r[4 + k] is None else r[4 + k] for r in rows]), c) for k, c in enumerate(model.cuts)], 1)
    for k, s in enumerate(SETTINGS):
        losses, history = plain(x, [r[3] for r in rows], [ids[r[0]] for r in rows], [r[2] == "validate" for r in rows], [r[1] for r in rows], s, 4, 42, objective)
        assert model.fits[k].losses == pytest.approx(losses, abs=1e-7)
        sums = history[model.fits[k].best_rounds - 1]
        found = {r.id: r.p for r in boosted.scored(df, model, k).collect()}
        assert len(found) == df.count()
        for r, v in zip(rows, sums, strict=True):
            assert found[r[0]] == pytest.approx(1 / (1 + math.exp(-v)) if objective == "logistic" else v, abs=1e-7)


def test_trees_do_not_depend_on_the_layout(spark):
    df, _ = table(spark)
    a = boosted.train(df.repartition(1), FEATURES, SETTINGS, ["id"], rounds=3, block=300)
    b = boosted.train(df.repartition(7), FEATURES, SETTINGS, ["id"], rounds=3, block=20)
    for x, y in zip(a.fits, b.fits, strict=True):
        assert x.losses == pytest.approx(y.losses, abs=1e-9)
        assert all((s.feature == t.feature).all() and (s.value == t.value).all() for s, t in zip(x.trees, y.trees, strict=True))


def test_search_stops_early_and_every_setting_differs(spark):
    df, _ = table(spark, 400)
    settings = [s for s in boosted.grid() if s.depth in (2, 3) and s.rate > 0.01]
    found = boosted.search(df, FEATURES, ["id"], settings, rounds=12, patience=3).collect()
    assert len(boosted.grid()) == 72 and len(set(boosted.grid())) == 72
    assert [r.log_loss for r in found] == sorted(r.log_loss for r in found) and len(found) == len(settings)
    by_penalty = {(r.depth, r.rate, r.rows, r.squares): r.log_loss for r in found}
    assert len(set(by_penalty.values())) > len(by_penalty) * 0.9
    assert all(r.best_rounds == r.rounds or r.rounds - r.best_rounds <= 3 for r in found)


def test_rows_that_say_nothing(spark):
    df, _ = table(spark, 60)
    one = boosted.train(df.withColumn("label", F.lit(1)), FEATURES, [Setting()], ["id"], rounds=2)
    assert all(r.p > 0.5 for r in boosted.scored(df, one).collect())
    flat = boosted.train(df.withColumns({"a": F.lit(1.0), "d": F.lit(None).cast("double")}).select("id", "part", "label", "a", "d"), ["a", "d"], [Setting()], ["id"], rounds=2)
    assert len({r.p for r in boosted.scored(df.select("id", F.lit(1.0).alias("a"), F.lit(None).cast("double").alias("d")), flat).collect()}) == 1
    with pytest.raises(ValueError, match="session"):
        boosted.train(df, FEATURES, [Setting()], ["id"], objective="pairwise")
