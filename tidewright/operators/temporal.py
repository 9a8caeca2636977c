"""Causal convolutional networks over the last rows of each group, trained by one aggregate an epoch.

A row's sequence is its group's last `length` rows up to it. Sequences are never written down: rows are numbered along
their groups, dealt into blocks of SPAN places, and each block also gets the length - 1 rows before its first, so that
a block is a bounded piece of a group of whatever size and holds every sequence that ends in it.

An epoch is one job over the blocks: tasks add up gradients and losses, which are whole numbers (units of 1 / UNIT), so
that their sums don't depend on how blocks are dealt out; the sums, a row for each parameter, go to the driver, which takes
the step. The network is a few thousand numbers and goes out with the job.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.boosted import dropped
from tidewright.operators.ordering import numbered, saved

SPAN, UNIT = 512, float(1 << 44)
#: Sequences that a task looks at in one go.
AT_ONCE = 128
TRAIN, VALIDATE = 1, 2


@dataclass(frozen=True)
class Shape:
    """The defaults are those of the surveyed network."""

    features: int
    length: int = 30
    channels: int = 16
    kernel: int = 3
    dilations: tuple[int, ...] = (1, 2, 4, 8)
    normalised: bool = True

    def parts(self) -> list[tuple[int, ...]]:
        c = self.channels
        return [(self.features, c), (c,), *(p for _ in self.dilations for p in ((self.kernel, c, c), (c,))), (c,), (1,)]

    @property
    def size(self) -> int:
        return sum(math.prod(p) for p in self.parts())


@dataclass(frozen=True)
class Course:
    """How a network is trained: rates rise over `warm_up` epochs, then fall along half a cosine to 0 at the last epoch."""

    epochs: int = 300
    patience: int = 35
    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    epsilon: float = 1e-8
    decay: float = 0.0
    clip: float = 0.0
    warm_up: int = 0
    seed: int = 42

    def rate_at(self, epoch: int) -> float:
        if epoch <= self.warm_up:
            return self.rate * epoch / self.warm_up
        done = min(1.0, (epoch - self.warm_up) / (self.epochs - self.warm_up)) if self.epochs > self.warm_up else 0.0
        return self.rate * 0.5 * (1 + math.cos(math.pi * done))


@dataclass
class Network:
    features: list[str]
    means: np.ndarray
    scales: np.ndarray
    shape: Shape
    weights: np.ndarray
    losses: list[float] = field(default_factory=list)
    best_epoch: int = 0


def cut(weights: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """The flat weights as the arrays they are: first layer, blocks, head; each with its offsets behind it."""
    ends = np.cumsum([math.prod(p) for p in shape.parts()])
    return [w.reshape(p) for w, p in zip(np.split(weights, ends[:-1]), shape.parts(), strict=True)]


def first_weights(shape: Shape, seed: int) -> np.ndarray:
    """Normal draws with variance 2 / inputs; offsets start at 0."""
    draw, c = np.random.default_rng(seed), shape.channels
    inputs = [shape.features, 0, *(n for _ in shape.dilations for n in (shape.kernel * c, 0)), c, 0]
    return np.concatenate([draw.normal(size=math.prod(p)) * math.sqrt(2 / n) if n else np.zeros(math.prod(p)) for p, n in zip(shape.parts(), inputs, strict=True)])


def moved(h: np.ndarray, steps: int) -> np.ndarray:
    """h (sequence, step, channel) so many steps later (or earlier, below 0), zeros where nothing comes."""
    out, n = np.zeros_like(h), h.shape[1]
    if abs(steps) < n:
        out[:, max(steps, 0) : n + min(steps, 0)] = h[:, max(-steps, 0) : n - max(steps, 0)]
    return out


def activated(z: np.ndarray, normalised: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(what a layer gives, where it is positive, the scale): the positive part, each step's channels with mean 0 and variance 1."""
    a = np.maximum(z, 0.0)
    if not normalised:
        return a, z > 0, None
    scale = np.sqrt(a.var(axis=2, keepdims=True) + 1e-5)
    return (a - a.mean(axis=2, keepdims=True)) / scale, z > 0, scale


def activated_back(g: np.ndarray, out: np.ndarray, positive: np.ndarray, scale: np.ndarray | None) -> np.ndarray:
    if scale is not None:
        g = (g - g.mean(axis=2, keepdims=True) - out * (g * out).mean(axis=2, keepdims=True)) / scale
    return np.where(positive, g, 0.0)


def logits(shape: Shape, weights: np.ndarray, x: np.ndarray, kept: list | None = None) -> np.ndarray:
    """x (sequence, step, feature) -> a logit for each sequence. kept: gets every layer's (inputs, outputs, ...) for `gradient`."""
    w = cut(weights, shape)
    h, positive, scale = activated(x @ w[0] + w[1], shape.normalised)
    layers = [(None, h, positive, scale)]
    for k, dilation in enumerate(shape.dilations):
        taps = [moved(h, dilation * (shape.kernel - 1 - t)) for t in range(shape.kernel)]
        z = h + w[3 + 2 * k] + sum(tap @ w[2 + 2 * k][t] for t, tap in enumerate(taps))
        h, positive, scale = activated(z, shape.normalised)
        layers.append((taps, h, positive, scale))
    if kept is not None:
        kept.extend(layers)
    return h[:, -1] @ w[-2] + w[-1][0]


def gradient(shape: Shape, weights: np.ndarray, x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the sum of the sequences' gradients, flat; their losses): logistic loss."""
    w, layers = cut(weights, shape), []
    z = logits(shape, weights, x, layers)
    out = [np.zeros(p) for p in shape.parts()]
    error = 1 / (1 + np.exp(-z)) - labels
    out[-2], out[-1] = error @ layers[-1][1][:, -1], np.array([error.sum()])
    g = np.zeros_like(layers[-1][1])
    g[:, -1] = error[:, None] * w[-2]
    for k in reversed(range(len(shape.dilations))):
        taps, h, positive, scale = layers[k + 1]
        g = activated_back(g, h, positive, scale)
        out[3 + 2 * k] = g.sum(axis=(0, 1))
        before = g
        for t, tap in enumerate(taps):
            out[2 + 2 * k][t] = np.einsum("nsi,nso->io", tap, g, optimize=True)
            before = before + moved(g @ w[2 + 2 * k][t].T, -shape.dilations[k] * (shape.kernel - 1 - t))
        g = before
    g = activated_back(g, *layers[0][1:])
    out[0], out[1] = np.einsum("nsi,nso->io", x, g, optimize=True), g.sum(axis=(0, 1))
    return np.concatenate([o.ravel() for o in out]), losses(z, labels)


def losses(z: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) - z * labels + np.log1p(np.exp(-np.abs(z)))


def standard(rows: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the training rows; 1 for a deviation up to 1e-6. ValueError where any row's feature isn't finite."""
    each = [F.col(f"`{c}`").cast("double") for c in features]
    train = F.col("part") == "train"
    bad = [F.count_if(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) for c in each]
    found = rows.agg(*bad, *(F.avg(F.when(train, c)) for c in each), *(F.stddev_pop(F.when(train, c)) for c in each)).first()
    n = len(features)
    wrong = [c for c, k in zip(features, found[:n], strict=True) if k]
    if wrong:
        raise ValueError(f"features that aren't finite: {', '.join(wrong)}")
    scales = np.array([v or 0.0 for v in found[2 * n :]])
    return np.array([v or 0.0 for v in found[n : 2 * n]]), np.where(scales > 1e-6, scales, 1.0)


def spread(rows: DataFrame, features: list[str], by: list[str], order: str, length: int, span: int, carried: list) -> DataFrame:
    """A row for each row and each block that sees it: the group, _block, _nth, _own (whether it ends a sequence there), x0, x1, ..."""
    span = max(span, length)
    slim = rows.select(*(F.col(f"`{c}`").alias(f"_g{k}") for k, c in enumerate(by)), F.col(f"`{order}`").alias("_at"), *carried, *(F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(features)))
    groups = [f"_g{k}" for k in range(len(by))]
    placed = numbered(slim, groups, ["_at"], "_nth", "_size")
    home = F.expr(f"_nth div {span}")
    blocks = F.when(F.col("_nth") % span > span - length, F.array(home, home + 1)).otherwise(F.array(home))
    return placed.withColumn("_home", home).withColumn("_block", F.explode(blocks)).withColumn("_own", F.col("_home") == F.col("_block")).drop("_home", "_size", "_at")


def matrix(table, n_features: int, means: np.ndarray, scales: np.ndarray) -> np.ndarray:
    get = lambda k: table.column(f"x{k}").to_numpy(zero_copy_only=False).astype(float)
    return (np.stack([get(k) for k in range(n_features)], 1) - means) / scales


def packed(rows: DataFrame, features: list[str], means: np.ndarray, scales: np.ndarray, by: list[str], order: str, length: int, span: int) -> DataFrame:
    """Blocks (trained, checked: how many sequences; x, ends, labels, parts as bytes); sequences end in labelled rows."""
    import pyarrow as pa

    n = len(features)
    kind = F.when(F.col("label").isNull(), 0).when(F.col("part") == "train", TRAIN).when(F.col("part") == "validate", VALIDATE).otherwise(0)
    dealt = spread(rows, features, by, order, length, span, [kind.cast("int").alias("_kind"), F.coalesce(F.col("label").cast("double"), F.lit(0.0)).alias("_label")])
    schema = "trained long, checked long, x binary, ends binary, labels binary, parts binary"

    def pack(table):
        table = table.sort_by("_nth")
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero(get("_own").astype(bool) & (get("_kind") > 0) & (np.arange(table.num_rows) >= length - 1))
        parts = get("_kind")[ends].astype(np.uint8)
        row = [int((parts == TRAIN).sum()), int((parts == VALIDATE).sum()), matrix(table, n, means, scales).tobytes(), ends.astype("<i8").tobytes(), get("_label")[ends].astype("<f8").tobytes(), parts.tobytes()]
        return pa.table({c.split()[0]: pa.array([v], pa.int64() if c.endswith("long") else pa.binary()) for c, v in zip(schema.split(", "), row, strict=True)})

    groups = [f"_g{k}" for k in range(len(by))]
    return saved(dealt.groupBy(*groups, "_block").applyInArrow(pack, schema).where("trained + checked > 0"), "sequences")


def summed(blocks: DataFrame, shape: Shape, weights: np.ndarray, trained: int, checked: int) -> tuple[np.ndarray, float, float]:
    """(gradient of the mean loss of train sequences, that loss, the mean loss of validate sequences) in one pass."""
    import pyarrow as pa

    def partial(batches):
        total = np.zeros(shape.size + 2, np.int64)
        whole = lambda v, n: np.rint(v / max(n, 1) * UNIT).astype(np.int64)
        for b in batches:
            for row in b.to_pylist():
                x = np.frombuffer(row["x"]).reshape(-1, shape.features)
                ends, labels, parts = np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["labels"], "<f8"), np.frombuffer(row["parts"], np.uint8)
                windows = np.lib.stride_tricks.sliding_window_view(x, shape.length, axis=0).swapaxes(1, 2)
                for part in (TRAIN, VALIDATE):
                    of = np.flatnonzero(parts == part)
                    for at in range(0, len(of), AT_ONCE):
                        some = of[at : at + AT_ONCE]
                        seen, y = np.ascontiguousarray(windows[ends[some] - (shape.length - 1)]), labels[some]
                        if part == TRAIN:
                            g, loss = gradient(shape, weights, seen, y)
                            total[:-2] += whole(g, trained)
                            total[-2] += whole(loss.sum(), trained)
                        else:
                            total[-1] += whole(losses(logits(shape, weights, seen), y).sum(), checked)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["at", "value"])

    found = np.zeros(shape.size + 2)
    for r in blocks.mapInArrow(partial, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect():
        found[r.at] = r.value / UNIT
    return found[:-2], float(found[-2]) if trained else math.nan, float(found[-1]) if checked else math.nan


def stepped(weights: np.ndarray, g: np.ndarray, moments: tuple[np.ndarray, np.ndarray], epoch: int, course: Course) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Weights and moments after an epoch: adaptive moments, with a decay of the weights that the moments don't see."""
    norm = math.sqrt(float((g * g).sum()))
    if 0 < course.clip < norm:
        g = g * (course.clip / norm)
    one, two = (b * m + (1 - b) * v for b, m, v in zip((course.beta1, course.beta2), moments, (g, g * g), strict=True))
    rate = course.rate_at(epoch)
    size = rate * math.sqrt(1 - course.beta2**epoch) / (1 - course.beta1**epoch)
    return weights - size * one / (np.sqrt(two) + course.epsilon) - rate * course.decay * weights, (one, two)


def train(rows: DataFrame, features: list[str], by: list[str], order: str, course: Course | None = None, span: int = SPAN, **shape) -> Network:
    """A network that tells a row's label from its sequence, kept as it was after the epoch of the least validation loss.

    rows: part (sequences that end in `train` rows are learnt, those in `validate` rows checked; rows of any part are
    read as what came before), label (0, 1 or null: no sequence ends there), features (finite, else ValueError, and
    scaled by the training rows), the group's columns `by`, and `order`, unique in a group. Training stops where
    `patience` epochs have not lowered the validation loss; without validate sequences it runs to its end. Rows with
    fewer than length - 1 rows before them end no sequence. Without train sequences: ValueError.
    """
    course, form = course or Course(), Shape(len(features), **shape)
    means, scales = standard(rows, features)
    blocks = packed(rows, features, means, scales, by, order, form.length, span)
    trained, checked = (int(v or 0) for v in blocks.agg(F.sum("trained"), F.sum("checked")).first())
    if not trained:
        raise ValueError("no sequence to train on")
    weights = first_weights(form, course.seed)
    found, best, moments = Network(features, means, scales, form, weights), math.inf, (np.zeros(form.size), np.zeros(form.size))
    for epoch in range(1, course.epochs + 2):  # a pass tells the loss of the weights before it: one more pass than steps
        g, _, loss = summed(blocks, form, weights, trained, checked)
        if epoch > 1 and checked:
            found.losses.append(loss)
            if loss + 1e-7 < best:
                best, found.best_epoch, found.weights = loss, epoch - 1, weights
            elif epoch - 1 - found.best_epoch >= course.patience:
                break
        if epoch <= course.epochs:
            weights, moments = stepped(weights, g, moments, epoch, course)
    if not checked:
        found.best_epoch, found.weights = course.epochs, weights
    dropped(blocks)
    return found


def scored(rows: DataFrame, model: Network, by: list[str], order: str, out: str = "p", span: int = SPAN) -> DataFrame:
    """rows with the network's probability; null where a row has too few before it, or a value that isn't finite among them."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    shape, means, scales, weights, n = model.shape, model.means, model.scales, model.weights, len(model.features)
    dealt = spread(rows, model.features, by, order, shape.length, span, [F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("whole")])

    def run(table):
        import pyarrow as pa

        table = table.sort_by("_nth")
        x, own = matrix(table, n, means, scales), table.column("_own").to_numpy(zero_copy_only=False).astype(bool)
        p = np.full(len(x), np.nan)
        if len(x) >= shape.length:
            windows = np.lib.stride_tricks.sliding_window_view(x, shape.length, axis=0).swapaxes(1, 2)
            ends = np.flatnonzero(own[shape.length - 1 :] & np.isfinite(windows).all(axis=(1, 2)))
            for at in range(0, len(ends), AT_ONCE):
                some = ends[at : at + AT_ONCE]
                p[some + shape.length - 1] = 1 / (1 + np.exp(-logits(shape, weights, np.ascontiguousarray(windows[some]))))
        return pa.table({"whole": table.column("whole").filter(pa.array(own)), out: pa.array(p[own], pa.float64(), mask=np.isnan(p[own]))})

    schema = StructType([dealt.schema["whole"], StructField(out, DoubleType())])
    return dealt.groupBy(*(f"_g{k}" for k in range(len(by))), "_block").applyInArrow(run, schema).select("whole.*", out)
