"""Boosted trees with penalties on squared and absolute leaf values, early stop, and pairwise ranking inside sessions.

Features are cut into bins once. Rows are packed into blocks that carry, for each setting, the sum of its trees so
far; a level of all settings' trees is one aggregate: tasks add gradients and curvatures by node, feature and bin,
partial sums meet by setting in groups of bounded size, and the best split of each node goes to the driver, a row for
each node. A round ends with a table of new sums, which cuts the lineage. Gradients are whole numbers (units of
2 ** -30), so that sums, and with them trees, don't depend on how rows are dealt out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import saved

BINS, BLOCK, FAN_IN = 64, 4096, 64
UNIT = float(1 << 30)
#: A split has to gain more than this.
LEAST_GAIN = 1e-6
PACKED = "rows long, ids binary, labels binary, checked binary, ends binary, bins binary, sums binary"


@dataclass(frozen=True)
class Setting:
    depth: int = 3
    rate: float = 0.05
    squares: float = 1.0
    absolutes: float = 0.0
    rows: float = 0.8
    columns: float = 0.8
    least_weight: float = 1.0


@dataclass
class Tree:
    """Nodes as in a heap: the children of node k are 2k + 1 and 2k + 2. feature -1: a leaf. Rows go left up to cut; lost: where missing values go."""

    feature: np.ndarray
    cut: np.ndarray
    lost_left: np.ndarray
    value: np.ndarray

    @staticmethod
    def of_depth(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(n))

    def walk(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row (bins by feature, 0 for missing) ends in."""
        at = np.zeros(len(bins), np.int32)
        for _ in range(len(self.feature).bit_length() - 1):
            f = self.feature[at]
            b = bins[np.arange(len(bins)), np.maximum(f, 0)]
            left = np.where(b == 0, self.lost_left[at], b <= self.cut[at])
            at = np.where(f < 0, at, 2 * at + np.where(left, 1, 2))
        return at


@dataclass
class Fit:
    setting: Setting
    trees: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def best_rounds(self) -> int:
        """Trees up to the first round with the least loss."""
        return int(np.argmin(self.losses)) + 1 if self.losses else 0


@dataclass
class Boosted:
    features: list[str]
    cuts: list[list[float]]
    fits: list[Fit]
    objective: str


def uniform(ids: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """A number in [0, 1) for each id, by seed and turn."""
    x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + (turn + 1) * 0xD1B54A32D192ED03) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


def chosen(n: int, share: float, seed: int, turn: int) -> np.ndarray:
    """The features that a tree may split on."""
    return np.sort(np.random.default_rng([seed, turn]).permutation(n)[: max(1, int(n * share))])


def gradients(objective: str, sums: np.ndarray, labels: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gradient, curvature, loss, and what it counts for) of each row; of pairs, a loss is told to the better row."""
    if objective == "logistic":
        p = 1 / (1 + np.exp(-sums))
        q = np.clip(p, 1e-16, 1 - 1e-16)
        return p - labels, np.maximum(p * (1 - p), 1e-16), -np.where(labels == 1, np.log(q), np.log1p(-q)), np.ones(len(sums))
    g, h, loss, count = (np.zeros(len(sums)) for _ in range(4))
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        s, y = sums[a:b], labels[a:b]
        better = y[:, None] > y[None, :]
        d = np.where(better, s[:, None] - s[None, :], 0.0)
        rho = np.where(better, 1 / (1 + np.exp(d)), 0.0)
        curve = rho * (1 - rho)
        g[a:b] = rho.sum(0) - rho.sum(1)
        h[a:b] = curve.sum(0) + curve.sum(1)
        loss[a:b], count[a:b] = np.where(better, np.log1p(np.exp(-d)), 0.0).sum(1), better.sum(1)
    return g, np.maximum(h, 1e-16), loss, count


def soft(g, absolutes: float):
    return np.sign(g) * np.maximum(np.abs(g) - absolutes, 0.0)


def leaf_value(g: float, h: float, s: Setting) -> float:
    return float(-soft(g, s.absolutes) / (h + s.squares) * s.rate)


def best_split(g: np.ndarray, h: np.ndarray, columns: np.ndarray, s: Setting):
    """g, h (features, bins; whole numbers, bin 0 for missing) -> (gain, feature, cut, lost_left, gl, hl, gr, hr) or None.

    Of equal gains the first feature, the lowest cut, and missing values to the right win.
    """
    g, h = g[columns] / UNIT, h[columns] / UNIT
    all_g, all_h = g.sum(1, keepdims=True)[:, :, None], h.sum(1, keepdims=True)[:, :, None]
    up = lambda x: np.stack([np.cumsum(x[:, 1:], 1)[:, :-1], np.cumsum(x[:, 1:], 1)[:, :-1] + x[:, :1]], 2)
    gl, hl = up(g), up(h)
    gr, hr = all_g - gl, all_h - hl
    score = lambda a, b: soft(a, s.absolutes) ** 2 / (b + s.squares)
    gain = np.where((hl >= s.least_weight) & (hr >= s.least_weight), score(gl, hl) + score(gr, hr) - score(all_g, all_h), -np.inf)
    if not gain.size:
        return None
    at = np.unravel_index(np.argmax(np.round(gain, 9)), gain.shape)
    if not gain[at] > LEAST_GAIN:
        return None
    return float(gain[at]), int(columns[at[0]]), int(at[1]) + 1, bool(at[2]), float(gl[at]), float(hl[at]), float(gr[at]), float(hr[at])


def cut_points(rows: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """For each feature at most bins - 2 values of training rows that values go left of or up to."""
    shares = [k / (bins - 1) for k in range(1, bins - 1)]
    value = lambda c: F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None).cast("double"))
    found = rows.where("part = 'train'").agg(*(F.percentile_approx(value(c), shares, 10_000).alias(f"c{k}") for k, c in enumerate(features))).first()
    return [sorted(set(x or [])) for x in found]


def binned(values: np.ndarray, cuts: list[float]) -> np.ndarray:
    """1 for values up to the first cut, and so on; 0 for missing ones."""
    return np.where(np.isnan(values), 0, np.searchsorted(np.array(cuts, float), values, "left") + 1).astype(np.uint8)


def packed(rows: DataFrame, features: list[str], cuts: list[list[float]], key: list[str], session: str | None, n_settings: int, block: int) -> DataFrame:
    """Blocks of about `block` rows; a session's rows are next to each other in one block."""
    import pyarrow as pa

    blocks = max(1, -(-rows.count() // block))
    picked = rows.where("part in ('train', 'validate') and label is not null").select(
        F.xxhash64(*key).alias("id"), F.xxhash64(session).alias("session") if session else F.lit(0).cast("long").alias("session"), F.col("label").cast("double").alias("label"),
        (F.col("part") == "validate").alias("checked"), *(F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(features)),
    )

    def pack(table):
        table = table.sort_by([("session", "ascending"), ("id", "ascending")])
        get = lambda c: table.column(c).to_numpy(zero_copy_only=False)
        bins = np.stack([binned(get(f"x{k}").astype(float), c) for k, c in enumerate(cuts)], 1)
        ends = np.concatenate([np.flatnonzero(np.diff(get("session"))) + 1, [table.num_rows]])
        row = [table.num_rows, get("id").astype("<i8").tobytes(), get("label").astype("<f8").tobytes(), get("checked").astype(np.uint8).tobytes(), ends.astype("<i8").tobytes(), bins.tobytes(), np.zeros((n_settings, table.num_rows)).tobytes()]
        return pa.table({n: pa.array([v], pa.int64() if n == "rows" else pa.binary()) for n, v in zip([c.split()[0] for c in PACKED.split(", ")], row, strict=True)})

    dealt = picked.withColumn("block", F.pmod(F.xxhash64("session" if session else "id", F.lit(3)), F.lit(blocks)))
    return saved(dealt.groupBy("block").applyInArrow(pack, PACKED), "blocks")


def unpacked(batches, n_features: int, n_settings: int):
    """(row as a dict, ids, labels, checked, ends, bins, sums) of each block."""
    for b in batches:
        for row in b.to_pylist():
            n = row["rows"]
            yield row, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<f8"), np.frombuffer(row["checked"], np.uint8) == 1, np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["bins"], np.uint8).reshape(n, n_features), np.frombuffer(row["sums"]).reshape(n_settings, n)


def level(blocks: DataFrame, growing: dict[int, Tree], fits: list[Fit], n_features: int, turn: int, depth: int, objective: str, seed: int, bins: int):
    """Of each growing setting: its loss on validate rows, and the best split (or None), g and h of each node of a level."""
    import pyarrow as pa

    n_settings, first, nodes = len(fits), 2**depth - 1, 2**depth
    settings = {k: fits[k].setting for k in growing}
    schema = "part long, setting long, g binary, h binary, loss long, n long"
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in schema.split(", ")]

    def partial(batches):
        from pyspark import TaskContext

        totals = {k: [np.zeros((nodes, n_features, bins), np.int64), np.zeros((nodes, n_features, bins), np.int64), 0, 0] for k in growing}
        for _, ids, labels, checked, ends, x, sums in unpacked(batches, n_features, n_settings):
            drawn = uniform(ids, seed, turn)
            for k, tree in growing.items():
                g, h, loss, count = gradients(objective, sums[k], labels, ends)
                if depth == 0:
                    totals[k][2] += int(np.rint(loss[checked] * UNIT).sum())
                    totals[k][3] += int(count[checked].sum())
                here = tree.walk(x) - first
                used = np.flatnonzero(~checked & (drawn < settings[k].rows) & (here >= 0) & (here < nodes))
                for total, v in ((totals[k][0], g), (totals[k][1], h)):
                    whole = np.rint(v[used] * UNIT)
                    for f in range(n_features):
                        total[:, f, :] += np.bincount(here[used] * bins + x[used, f], whole, nodes * bins).astype(np.int64).reshape(nodes, bins)
        part = TaskContext.get().partitionId()
        rows = [(part, k, g.tobytes(), h.tobytes(), loss, n) for k, (g, h, loss, n) in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def added(table):
        def total(c):
            return np.sum([np.frombuffer(v, np.int64) for v in table.column(c).to_pylist()], 0)

        return total("g"), total("h"), sum(table.column("loss").to_pylist()), sum(table.column("n").to_pylist())

    def merge(table):
        g, h, loss, n = added(table)
        row = (table.column("part")[0].as_py(), table.column("setting")[0].as_py(), g.tobytes(), h.tobytes(), loss, n)
        return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    found = "setting long, loss long, n long, node long, g double, h double, gain double, feature long, cut long, lost_left boolean, gl double, hl double, gr double, hr double"

    def splits(table):
        k = table.column("setting")[0].as_py()
        g, h, loss, n = added(table)
        g, h = (v.reshape(nodes, n_features, bins) for v in (g, h))
        columns, rows = chosen(n_features, settings[k].columns, seed, turn), []
        for node in range(nodes):
            if not h[node].any():
                continue
            split = best_split(g[node], h[node], columns, settings[k]) or (None,) * 8
            rows.append((k, loss, n, node, float(g[node, 0].sum() / UNIT), float(h[node, 0].sum() / UNIT), *split))
        rows = rows or [(k, loss, n, -1, 0.0, 0.0, *(None,) * 8)]
        kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        return pa.table([pa.array(c, kinds[f.split()[1]]) for c, f in zip(zip(*rows, strict=True), found.split(", "), strict=True)], names=[f.split()[0] for f in found.split(", ")])

    sums, parts = blocks.mapInArrow(partial, schema), max(1, blocks.rdd.getNumPartitions())
    while parts > FAN_IN:
        sums = sums.withColumn("part", F.expr(f"part div {FAN_IN}")).groupBy("setting", "part").applyInArrow(merge, schema)
        parts = -(-parts // FAN_IN)
    return sums.groupBy("setting").applyInArrow(splits, found).collect()


def grow(blocks: DataFrame, fits: list[Fit], active: list[int], n_features: int, turn: int, objective: str, seed: int, bins: int) -> tuple[dict[int, Tree], dict[int, float]]:
    """(a tree more for each active setting, its loss before that tree)."""
    trees, losses = {k: Tree.of_depth(fits[k].setting.depth) for k in active}, {}
    open_nodes = {k: {0} for k in active}
    for depth in range(max((fits[k].setting.depth for k in active), default=0)):
        growing = {k: trees[k] for k in active if depth < fits[k].setting.depth and open_nodes[k]}
        if not growing:
            break
        now = {k: set() for k in growing}
        for r in level(blocks, growing, fits, n_features, turn, depth, objective, seed, bins):
            s, tree = fits[r.setting].setting, trees[r.setting]
            if depth == 0:
                losses[r.setting] = r.loss / UNIT / r.n if r.n else math.nan
            node = 2**depth - 1 + r.node
            if r.node < 0 or node not in open_nodes[r.setting]:
                continue
            if r.gain is None:
                tree.value[node] = leaf_value(r.g, r.h, s)
                continue
            tree.feature[node], tree.cut[node], tree.lost_left[node] = r.feature, r.cut, r.lost_left
            tree.value[2 * node + 1], tree.value[2 * node + 2] = leaf_value(r.gl, r.hl, s), leaf_value(r.gr, r.hr, s)
            now[r.setting] |= {2 * node + 1, 2 * node + 2}
        open_nodes |= now
    return trees, losses


def with_trees(blocks: DataFrame, trees: dict[int, Tree], n_features: int, n_settings: int) -> DataFrame:
    """The blocks with a tree's values added to each setting's sums."""
    import pyarrow as pa

    def run(batches):
        for row, _, _, _, _, x, sums in unpacked(batches, n_features, n_settings):
            sums = sums.copy()
            for k, tree in trees.items():
                sums[k] += tree.value[tree.walk(x)]
            yield pa.RecordBatch.from_pylist([row | {"sums": sums.tobytes()}], pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in PACKED.split(", ")]))

    return saved(blocks.mapInArrow(run, PACKED), "blocks")


def dropped(blocks: DataFrame) -> None:
    """Deletes the files of a saved table that nothing reads again."""
    files = blocks.inputFiles()
    if files:
        spark = blocks.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def train(rows: DataFrame, features: list[str], settings: list[Setting], key: list[str], rounds: int = 75, patience: int = 20, objective: str = "logistic", session: str | None = None, seed: int = 42, bins: int = BINS, block: int = BLOCK) -> Boosted:
    """Trees for every setting, all at once, each stopped where `patience` rounds have not lowered its loss on validate rows.

    rows: part (train or validate; others are not read), label (0 or 1), features (numbers; null or NaN is missing),
    and key, which names a row. objective: logistic, or pairwise, which compares rows of a `session` (so many that
    they fit in a task). Row and column samples depend on seed, round and key alone. At most 256 bins.
    """
    if objective not in ("logistic", "pairwise") or (objective == "pairwise") != (session is not None) or not 3 <= bins <= 256:
        raise ValueError("logistic without or pairwise with a session, and 3 to 256 bins")
    cuts = cut_points(rows, features, bins)
    fits, active = [Fit(s) for s in settings], list(range(len(settings)))
    blocks = packed(rows, features, cuts, key, session, len(fits), block)
    for turn in range(rounds + 1):
        trees, losses = grow(blocks, fits, active, len(features), turn, objective, seed, bins)
        if turn:
            for k in active:
                fits[k].losses.append(losses[k])
            active = [k for k in active if not (patience and len(fits[k].losses) - fits[k].best_rounds >= patience)]
        if turn == rounds or not active:
            break
        for k in active:
            fits[k].trees.append(trees[k])
        before, blocks = blocks, with_trees(blocks, {k: trees[k] for k in active}, len(features), len(fits))
        dropped(before)
    dropped(blocks)
    return Boosted(features, cuts, fits, objective)


def scored(rows: DataFrame, model: Boosted, setting: int = 0, out: str = "p") -> DataFrame:
    """rows with the model's probability (or, of ranks, its sum of trees), by the trees of the best round."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    fit, cuts, names = model.fits[setting], model.cuts, model.features
    trees, logistic = fit.trees[: fit.best_rounds], model.objective == "logistic"
    # rows in a struct, so that no name of theirs matters
    needed = rows.select(F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("whole"), *(F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(names)))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = np.stack([binned(b.column(f"x{k}").to_numpy(zero_copy_only=False).astype(float), c) for k, c in enumerate(cuts)], 1)
            total = np.zeros(b.num_rows)
            for tree in trees:
                total += tree.value[tree.walk(x)]
            yield pa.RecordBatch.from_arrays([b.column("whole"), pa.array(1 / (1 + np.exp(-total)) if logistic else total)], names=["whole", out])

    schema = StructType([needed.schema["whole"], StructField(out, DoubleType())])
    return needed.mapInArrow(run, schema).select("whole.*", out)


def grid() -> list[Setting]:
    """The 72 settings of the search. Depths, rates, pairs of penalties (squares, absolutes), pairs of shares (rows, columns)."""
    penalties, shares = ((1.0, 0.0), (10.0, 1.0), (25.0, 5.0)), ((0.8, 0.8), (1.0, 1.0))
    return [Setting(d, r, a, b, m, n) for d in (2, 3, 4, 5) for r in (0.01, 0.05, 0.1) for a, b in penalties for m, n in shares]


#: The setting of the ranker.
RANKER = Setting(depth=2, rate=0.03, squares=10.0, absolutes=0.0, rows=0.8, columns=0.8, least_weight=10.0)


def search(rows: DataFrame, features: list[str], key: list[str], settings: list[Setting] | None = None, **options) -> DataFrame:
    """A row for each setting, the least validation loss first: its values, log_loss, best_rounds, and rounds run."""
    model = train(rows, features, settings or grid(), key, **options)
    found = [(s.depth, s.rate, s.squares, s.absolutes, s.rows, s.columns, min(f.losses, default=None), f.best_rounds, len(f.losses)) for f in model.fits for s in [f.setting]]
    schema = "depth long, rate double, squares double, absolutes double, rows double, columns double, log_loss double, best_rounds long, rounds long"
    return rows.sparkSession.createDataFrame(found, schema).orderBy("log_loss", "depth", "rate", "squares", F.desc("rows"))
