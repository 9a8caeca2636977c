"""Temporal networks over blocks of rows against a plain version over written-down sequences, a number at a time."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.operators import temporal
from tidewright.operators.temporal import Course, Shape

SMALL = {"length": 6, "channels": 3, "kernel": 3, "dilations": (1, 2)}
FEATURES = ["a", "b.c"]


def table(spark, n=60, groups=3, seed=1):
    """Rows of some groups; the label follows the last three values of a."""
    g, rows = np.random.default_rng(seed), []
    for k in range(groups):
        a, b = g.normal(size=n - 9 * k), g.normal(size=n - 9 * k)
        for i in range(len(a)):
            label = None if i % 17 == 4 else int(a[max(0, i - 2) : i + 1].sum() > 0)
            rows.append((f"g{k}", i * 3, "train" if i < n * 0.6 else "validate" if i < n * 0.8 else "test", label, float(a[i]), float(b[i]) * 5 + 2))
    return spark.createDataFrame(rows, "name string, day long, part string, label int, a double, `b.c` double").repartition(3), rows


def plain_logit(shape, weights, x):
    """One sequence (a list of steps) by loops."""
    at = 0

    def take(*size):
        nonlocal at
        n = math.prod(size)
        at += n
        return np.array(weights[at - n : at]).reshape(size).tolist()

    def layer(z):
        out = []
        for step in z:
            a = [max(v, 0.0) for v in step]
            if shape.normalised:
                mean = sum(a) / len(a)
                scale = math.sqrt(sum((v - mean) ** 2 for v in a) / len(a) + 1e-5)
                a = [(v - mean) / scale for v in a]
            out.append(a)
        return out

    c = range(shape.channels)
    w, b = take(shape.features, shape.channels), take(shape.channels)
    h = layer([[b[o] + sum(step[i] * w[i][o] for i in range(shape.features)) for o in c] for step in x])
    for dilation in shape.dilations:
        w, b = take(shape.kernel, shape.channels, shape.channels), take(shape.channels)
        z = []
        for s in range(len(h)):
            row = [h[s][o] + b[o] for o in c]
            for t in range(shape.kernel):
                before = s - dilation * (shape.kernel - 1 - t)
                if before >= 0:
                    row = [row[o] + sum(h[before][i] * w[t][i][o] for i in c) for o in c]
            z.append(row)
        h = layer(z)
    w, b = take(shape.channels), take(1)
    return b[0] + sum(h[-1][i] * w[i] for i in c)


def plain_loss(z, y):
    return math.log1p(math.exp(-z)) if y else math.log1p(math.exp(z))


@pytest.mark.parametrize("normalised", [True, False])
@pytest.mark.parametrize("length", [6, 3])
def test_logits_and_gradients_equal_loops_and_differences(normalised, length):
    shape = Shape(2, length, 3, 3, (1, 2), normalised)
    g = np.random.default_rng(5)
    weights, x, y = temporal.first_weights(shape, 3) + g.normal(size=shape.size) * 0.05, g.normal(size=(4, length, 2)), np.array([0.0, 1, 1, 0])
    want = [plain_logit(shape, weights, s.tolist()) for s in x]
    assert temporal.logits(shape, weights, x) == pytest.approx(want, abs=1e-12)
    found, loss = temporal.gradient(shape, weights, x, y)
    assert loss == pytest.approx([plain_loss(z, v) for z, v in zip(want, y, strict=True)], abs=1e-12)
    total = lambda w: sum(plain_loss(plain_logit(shape, w, s.tolist()), v) for s, v in zip(x, y, strict=True))
    for k in range(shape.size):
        up, down = weights.copy(), weights.copy()
        up[k] += 1e-6
        down[k] -= 1e-6
        assert found[k] == pytest.approx((total(up) - total(down)) / 2e-6, abs=2e-6)


def test_steps_see_nothing_later():
    shape = Shape(2, 30)
    x = np.random.default_rng(0).normal(size=(1, 30, 2))
    kept, other = [], []
    weights = temporal.first_weights(shape, 1)
    temporal.logits(shape, weights, x, kept)
    x[0, 20:] += 1
    temporal.logits(shape, weights, x, other)
    for a, b in zip(kept, other, strict=True):
        assert (a[1][0, :20] == b[1][0, :20]).all() and (a[1][0, 20:] != b[1][0, 20:]).any()


def sequences(rows, length):
    """Plain: (name, day, part, label, sequence) of every labelled row with enough rows before it; scaled by training rows."""
    values = np.array([[r[4], r[5]] for r in rows])
    train = values[[r[2] == "train" for r in rows]]
    scaled = (values - train.mean(0)) / train.std(0)
    out = []
    for k, r in enumerate(rows):
        before = [j for j, o in enumerate(rows) if o[0] == r[0] and o[1] <= r[1]][-length:]
        if len(before) == length:
            out.append((*r[:4], scaled[sorted(before, key=lambda j: rows[j][1])].tolist()))
    return out


def plain_course(shape, rows, course):
    """Every epoch's validation loss and the weights of the best, stepping number by number."""
    each = [s for s in sequences(rows, shape.length) if s[3] is not None]
    train, checked = ([s for s in each if s[2] == part] for part in ("train", "validate"))
    weights, m, v = temporal.first_weights(shape, course.seed).tolist(), [0.0] * shape.size, [0.0] * shape.size
    told, best = [], (math.inf, 0, weights)
    for epoch in range(1, course.epochs + 1):
        g = np.sum([temporal.gradient(shape, np.array(weights), np.array([s[4]]), np.array([float(s[3])]))[0] for s in train], 0) / len(train)
        norm = math.sqrt(sum(x * x for x in g))
        if course.clip and norm > course.clip:
            g = [x * course.clip / norm for x in g]
        rate = course.rate * (epoch / course.warm_up if epoch <= course.warm_up else 0.5 * (1 + math.cos(math.pi * (epoch - course.warm_up) / (course.epochs - course.warm_up))))
        for k in range(shape.size):
            m[k] = course.beta1 * m[k] + (1 - course.beta1) * g[k]
            v[k] = course.beta2 * v[k] + (1 - course.beta2) * g[k] ** 2
            mean, square = m[k] / (1 - course.beta1**epoch), v[k] / (1 - course.beta2**epoch)
            weights[k] -= rate * mean / (math.sqrt(square) + course.epsilon / math.sqrt(1 - course.beta2**epoch)) + rate * course.decay * weights[k]
        told.append(np.mean([plain_loss(plain_logit(shape, weights, s[4]), s[3]) for s in checked]))
        if told[-1] + 1e-7 < best[0]:
            best = told[-1], epoch, list(weights)
        elif epoch - best[1] >= course.patience:
            break
    return told, best


@pytest.mark.parametrize("course", [Course(6, 6, 0.02, seed=4), Course(8, 2, 0.9, decay=0.01, clip=0.05, warm_up=2, seed=7)])
def test_training_equals_a_plain_loop(spark, course):
    df, rows = table(spark)
    model = temporal.train(df, FEATURES, ["name"], "day", course, span=8, **SMALL)
    told, best = plain_course(model.shape, rows, course)
    assert model.losses == pytest.approx(told, abs=1e-6) and model.best_epoch == best[1]
    assert model.weights == pytest.approx(best[2], abs=1e-5)
    found = {(r.name, r.day): r.p for r in temporal.scored(df, model, ["name"], "day", span=9).collect()}
    assert set(found) == {r[:2] for r in rows}
    want = {s[:2]: 1 / (1 + math.exp(-plain_logit(model.shape, model.weights, s[4]))) for s in sequences(rows, 6)}
    assert {k for k, p in found.items() if p is not None} == set(want)
    assert all(found[k] == pytest.approx(p, abs=1e-9) for k, p in want.items())


def test_networks_do_not_depend_on_the_layout(spark):
    df, _ = table(spark)
    a = temporal.train(df.repartition(1), FEATURES, ["name"], "day", Course(4, 4, 0.02), span=16, **SMALL)
    b = temporal.train(df.repartition(7, "a"), FEATURES, ["name"], "day", Course(4, 4, 0.02), span=16, **SMALL)
    assert a.losses == pytest.approx(b.losses, abs=1e-9) and a.weights == pytest.approx(b.weights, abs=1e-9)


def test_what_the_label_follows_is_learnt(spark):
    df, _ = table(spark, 500, 2)
    model = temporal.train(df, FEATURES, ["name"], "day", Course(60, 60, 0.03), **SMALL | {"channels": 8, "normalised": False})  # normal channels hide how large a sum is
    test = temporal.scored(df, model, ["name"], "day").where("part = 'test' and label is not null")
    right = test.agg(F.avg(((F.col("p") > 0.5) == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.9 and model.losses[-1] < model.losses[0]


def test_tables_that_say_nothing(spark):
    df, _ = table(spark, 20, 1)
    with pytest.raises(ValueError, match=r"b\.c"):
        temporal.train(df.withColumn("b.c", F.when(F.col("day") == 3, float("nan")).otherwise(F.col("`b.c`"))), FEATURES, [], "day", Course(1), **SMALL)
    with pytest.raises(ValueError, match="no sequence"):
        temporal.train(df.where("day < 9"), FEATURES, [], "day", Course(1), **SMALL)
    with pytest.raises(ValueError, match="no sequence"):
        temporal.train(df.limit(0), FEATURES, [], "day", Course(1), **SMALL)
    one = temporal.train(df.where("part = 'train'"), FEATURES, [], "day", Course(2), **SMALL)
    assert one.losses == [] and one.best_epoch == 2
    odd = df.withColumns({"a": F.when(F.col("day") == 30, F.lit(None)).otherwise(F.col("a")), "_nth": F.lit(1), "p": F.lit("mine")})
    found = {r[1]: r[-1] for r in temporal.scored(odd, one, ["name"], "day", out="told").collect()}
    assert [k for k, p in sorted(found.items()) if p is None] == [0, 3, 6, 9, 12, 30, 33, 36, 39, 42, 45]
    assert temporal.scored(odd.limit(0), one, ["name"], "day").collect() == []
