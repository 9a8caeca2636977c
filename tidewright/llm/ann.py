"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into balanced parts that few edges cross. Two softmax
classifiers are fitted to it: one places a vector in a part, the other tells from a query in which parts its neighbours
lie. Every vector is placed; queries go to their most probable parts and are compared with all vectors there on the
original numbers. How many parts is measured: some vectors of the sample, which the classifier of queries has not seen,
are searched exactly over the whole table, and as many parts are asked as hold the wanted share of what they find.

Parts grow with the square root of the table, up to MOST_PARTS, which the sample bounds. Tasks hold a shard of
neighbouring parts and yield one list of k for each query and shard, however many of its parts the query asks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import written

#: Vectors of the sample for each part, and the most parts: SAMPLE = ROWS_A_PART * MOST_PARTS bounds the sample.
ROWS_A_PART, MOST_PARTS = 16, 2048
SAMPLE = ROWS_A_PART * MOST_PARTS
GRAPH_K, EPOCHS, RATE = 10, 6, 0.02
WANTED, CHECKED = 0.93, 500
SHARDS = 16
#: Vectors and queries of a shard that meet in one task: at least, for each root of the rows, and at most (some 100 MB).
VECTOR_BLOCK, QUERY_BLOCK = (8192, 32, 1 << 18), (2048, 8, 1 << 16)
#: Scores that a task holds at a time.
SCORES = 1 << 21


def parts_for_rows(n: int) -> int:
    """Four times the square root of the rows, of eight rows or more each."""
    return int(max(1, min(MOST_PARTS, 4 * n**0.5, n // 8)))


def block_of(bounds: tuple[int, int, int], rows: int) -> int:
    """Blocks grow with the root of the table, as parts do: so copies of vectors, one for each block of queries, and of
    queries, one for each block of vectors, grow as queries times parts asked do, not with the square of the rows."""
    least, each, most = bounds
    return int(min(most, max(least, each * rows**0.5)))


def nearest(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each row's k largest inner products with other rows."""
    out = []
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out)


def halve(x: np.ndarray, parts: int) -> np.ndarray:
    """Balanced first parts: split along the line between two means, again and again; neighbouring numbers are near."""
    part, todo = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while todo:
        i, low, n = todo.pop()
        part[i] = low
        if n == 1 or not len(i):
            continue
        a, b = x[i[0]], x[i[((x[i] - x[i[0]]) ** 2).sum(1).argmax()]]
        for _ in range(5):
            near = ((x[i] - a) ** 2).sum(1) <= ((x[i] - b) ** 2).sum(1)
            a, b = (x[i][near].mean(0) if near.any() else a), (x[i][~near].mean(0) if not near.all() else b)
        order, left = i[np.argsort(x[i] @ (b - a), kind="stable")], n // 2
        cut = round(len(i) * left / n)
        todo += [(order[:cut], low, left), (order[cut:], low + left, n - left)]
    return part


def cut_graph(neighbours: np.ndarray, part: np.ndarray, parts: int, sweeps: int = 6, spare: float = 0.15) -> np.ndarray:
    """Moves vertices to the part that most of their neighbours are in, while both parts stay near their share."""
    n, _ = neighbours.shape
    near = [[] for _ in range(n)]
    for v, row in enumerate(neighbours.tolist()):
        for u in row:
            near[v].append(u)
            near[u].append(v)
    part, size = part.tolist(), np.bincount(part, minlength=parts).tolist()
    share = n / parts
    most, least = max(share * (1 + spare), share + 1), min(share * (1 - spare), share - 1)
    for _ in range(sweeps):
        moved = 0
        for v in range(n):
            own, votes = part[v], {}
            for u in near[v]:
                votes[part[u]] = votes.get(part[u], 0) + 1
            best = max((p for p in votes if size[p] < most or p == own), key=lambda p: (votes[p], p == own, -p), default=own)
            if votes.get(best, 0) > votes.get(own, 0) and size[own] > least:
                size[own] -= 1
                size[best] += 1
                part[v], moved = best, moved + 1
        if not moved:
            break
    return np.array(part)


@dataclass
class Softmax:
    """A linear classifier of parts."""

    w: np.ndarray
    b: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w + self.b


def fit(x: np.ndarray, targets: np.ndarray, parts: int, start: np.ndarray, seed: int) -> Softmax:
    """targets: the parts of each row, all as probable. Adam on the cross entropy, from the parts' means."""
    rng, n, m = np.random.default_rng(seed), len(x), targets.shape[1]
    x, spread = x.astype(np.float32), float(np.sqrt((x**2).sum(1).mean())) or 1.0
    x = x / spread
    model = Softmax((20 / spread * start.T).astype(np.float32), np.zeros(parts, np.float32))
    moments, step = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.w, model.b)], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            i, step = order[at : at + 256], step + 1
            p = model(x[i])
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            np.subtract.at(p, (np.repeat(np.arange(len(i)), m), targets[i].ravel()), np.float32(1 / m))
            p /= len(i)
            for k, (value, grad) in enumerate(((model.w, x[i].T @ p), (model.b, p.sum(0)))):
                a, b = moments[k]
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                value -= RATE * (1 - epoch / EPOCHS) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-9)
    return Softmax(model.w.astype(np.float64) / spread, model.b.astype(np.float64))


@dataclass
class Index:
    """Where vectors go (place) and where queries go (route); recall is what `probes` parts hold of the checked rows."""

    parts: int
    place: Softmax
    route: Softmax
    checked: np.ndarray
    probes: int = 1
    recall: float = 1.0

    def part_of(self, x: np.ndarray) -> np.ndarray:
        return self.place(x).argmax(1)

    def order_for(self, q: np.ndarray) -> np.ndarray:
        """All parts for each query, the likeliest first."""
        return np.argsort(-self.route(q), axis=1, kind="stable")

    def asked(self, q: np.ndarray, sizes: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Matrix (query, part): the first `probes` parts, and the next ones until they hold what the query needs."""
        order = self.order_for(q)
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, (np.arange(self.parts) < self.probes) | (before < need[:, None]), 1)
        return out

    def measure(self, q: np.ndarray, owner: np.ndarray, part: np.ndarray, wanted: float) -> None:
        """Sets probes and recall from exact results: the part of each neighbour that row `owner` of q has."""
        rank = np.argsort(self.order_for(q), axis=1)[owner, part]
        if len(rank):
            self.probes = int(np.sort(rank)[min(len(rank), int(np.ceil(wanted * len(rank)))) - 1]) + 1
            self.recall = float((rank < self.probes).mean())


def learn(x: np.ndarray, parts: int, checked: int = CHECKED) -> Index:
    """x: the sample, in a fixed order. Its first rows, a fifth at most, are kept from the classifier of queries."""
    parts, checked = min(parts, len(x)), min(checked, -(-len(x) // 5))
    if len(x) <= GRAPH_K:
        parts = 1
    if parts == 1:
        one = Softmax(np.zeros((x.shape[1], 1)), np.zeros(1))
        return Index(1, one, one, x[:checked])
    top = nearest(x, min(2 * GRAPH_K, len(x) - 1))
    part = cut_graph(top[:, :GRAPH_K], halve(x, parts), parts)
    means = np.zeros((parts, x.shape[1]))
    np.add.at(means, part, x)
    means /= np.maximum(1e-9, np.sqrt((means**2).sum(1, keepdims=True)))
    return Index(parts, fit(x, part[:, None], parts, means, 1), fit(x[checked:], part[top[checked:]], parts, means, 2), x[:checked])


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, v) of rows with an id whose vector is not null, empty or zero and has only finite numbers."""
    v = F.transform(vectors[column], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine).where(F.exists("v", lambda x: x != 0))


def best(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, score): each query's k best by (score, smaller id) where rough, an inexact score, is finite."""
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    m = min(k, len(ids))
    limit = np.partition(rough, len(ids) - m, axis=1)[:, len(ids) - m]
    a, b = np.nonzero((rough >= limit[:, None] - 1e-9 * (1 + np.abs(limit[:, None]))) & np.isfinite(rough))
    score = (q[a] * x[b]).sum(axis=1)
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    return a[nth < k], b[nth < k], score[nth < k]


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_column: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, wanted: float = WANTED) -> DataFrame:
    """The k nearest by inner product of each row whose id is divisible by `every`: query_id, rank, vec_id, score.

    Candidates are all other rows. Vectors that are null, empty, zero or hold null or non-finite numbers take no
    part; of several dimensions in a table the most frequent one takes part. Ties go to the smaller vec_id. Of rows
    that repeat a vec_id, all are candidates of others, none of queries of that id, and its query is answered once
    (for the least vector). An empty table gives no rows.
    """
    found = search_with_index(vectors, every, k, id_column, column, sample, wanted)
    if found:
        return found[0]
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def search_with_index(vectors: DataFrame, every: int, k: int, id_column: str, column: str, sample: int, wanted: float) -> tuple[DataFrame, Index] | None:
    """search's rows and the index they come from, with its measured recall; None for a table without usable vectors."""
    import pyarrow as pa

    rows = written(usable(vectors, id_column, column), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return None
    d, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == d)
    parts = parts_for_rows(n)
    sample = min(sample, max(ROWS_A_PART * parts, 8 * k))
    share = F.xxhash64("vec_id", F.lit(5)).cast("double") / F.lit(2.0**64) + 0.5
    got = rows.where(share < 1.2 * sample / n + 20 / n).orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id", "v").limit(sample).collect()
    got_ids, got_x = np.array([r["vec_id"] for r in got], np.int64), np.array([r["v"] for r in got]).reshape(-1, d)
    if not len(got):  # a handful of rows that all hash high
        got = rows.orderBy("vec_id", "v").limit(sample).collect()
        got_ids, got_x = np.array([r["vec_id"] for r in got], np.int64), np.array([r["v"] for r in got]).reshape(-1, d)
    index, context = learn(got_x, parts), rows.sparkSession.sparkContext
    checked_ids = got_ids[: len(index.checked)]
    shared = context.broadcast(index)

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.part_of(matrix(b.column("v"))))], names=["vec_id", "v", "part"])

    # Of equal vectors only the k + 1 smallest ids can be among a query's k; found in salted steps, as one may be frequent.
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    for keys in (["v", "salt"], ["v"]):
        salted = salted.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    candidates = written(salted.select("vec_id", "v").mapInArrow(place, "vec_id long, v array<double>, part long"), "placed")
    held = np.zeros(index.parts, np.int64)
    for r in candidates.groupBy("part").count().collect():
        held[r["part"]] = r["count"]

    def exact(batches):
        """The k nearest of each checked row among a task's vectors: (row, part, score, vec_id)."""
        q, kept = shared.value.checked, None
        for b in batches:
            ids, x, part = b.column("vec_id").to_numpy(), matrix(b.column("v")), b.column("part").to_numpy()
            a, at, score = best(ids, x, checked_ids, q, q @ x.T, k)
            new = np.rec.fromarrays([a, part[at], score, ids[at]], names="row,part,score,vec_id")
            both = new if kept is None else np.concatenate([kept, new])
            both = both[np.lexsort((both["vec_id"], -both["score"], both["row"]))]
            kept = both[np.arange(len(both)) - np.searchsorted(both["row"], both["row"]) < k]
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array(kept[c].copy()) for c in ("row", "part", "score", "vec_id")], names=["row", "part", "score", "vec_id"])

    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    true = candidates.mapInArrow(exact, "row long, part long, score double, vec_id long").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)
    true = true.select("row", "part").toPandas()  # k for each of at most CHECKED rows
    index.measure(index.checked, true["row"].to_numpy(), true["part"].to_numpy(), wanted)
    shared = context.broadcast(index)
    per_shard = -(-index.parts // SHARDS)

    def route(batches):
        for b in batches:
            asked = shared.value.asked(matrix(b.column("v")), held, k + b.column("own").to_numpy())
            cut = np.pad(asked, ((0, 0), (0, per_shard * SHARDS - index.parts))).reshape(len(asked), SHARDS, per_shard)
            at, shard = np.nonzero(cut.any(axis=2))
            take = pa.array(at)
            mask = pa.array([m.tobytes() for m in np.packbits(cut[at, shard], axis=1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(take), b.column("v").take(take), mask, pa.array(shard)], names=["vec_id", "v", "mask", "shard"])

    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    asked = written(asked.mapInArrow(route, "vec_id long, v array<double>, mask binary, shard long"), "asked")
    dealt = candidates.withColumn("shard", F.expr(f"part div {per_shard}"))
    blocks = dealt.groupBy("shard").agg(F.ceil(F.count("*") / block_of(VECTOR_BLOCK, n)).alias("blocks")).join(asked.groupBy("shard").agg(F.ceil(F.count("*") / block_of(QUERY_BLOCK, n)).alias("chunks")), "shard")
    block, chunk = F.pmod(F.xxhash64("vec_id"), F.col("blocks")), F.pmod(F.xxhash64("vec_id"), F.col("chunks"))
    blocks = F.broadcast(blocks)  # a row for each of SHARDS shards
    left = dealt.join(blocks, "shard").select("shard", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "part", "vec_id", "v", F.lit(None).cast("binary").alias("mask"))
    right = asked.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), chunk.alias("chunk"), F.lit(index.parts).cast("long").alias("part"), "vec_id", "v", "mask")
    keys = ["shard", "block", "chunk"]

    def compare(batches):
        """Vectors of a block come first, by part; its queries are compared with the parts that they ask."""
        ids, x, part, at = np.zeros(0, np.int64), np.zeros((0, d)), np.zeros(0, np.int64), None
        for batch in batches:
            key, own_part = np.stack([batch.column(c).to_numpy() for c in keys], axis=1), batch.column("part").to_numpy()
            is_query, vec_id, v = own_part == index.parts, batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            masks = batch.column("mask").to_pylist()
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (is_query[1:] != is_query[:-1])) + 1).tolist(), len(key)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                here = tuple(key[a].tolist())
                if here != at:
                    ids, x, part, at = np.zeros(0, np.int64), np.zeros((0, d)), np.zeros(0, np.int64), here
                if not is_query[a]:
                    ids, x, part = np.concatenate([ids, vec_id[a:b]]), np.concatenate([x, v[a:b]]), np.concatenate([part, own_part[a:b]])
                    continue
                starts = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
                step = max(1, min(256, SCORES // max(1, len(ids))))
                for c in range(a, b if len(ids) else a, step):
                    q, q_ids = v[c : min(b, c + step)], vec_id[c : min(b, c + step)]
                    wants = np.unpackbits(np.frombuffer(b"".join(masks[c : c + len(q)]), np.uint8).reshape(len(q), -1), axis=1)
                    rough = np.full((len(q), len(ids)), -np.inf)
                    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                        some = np.flatnonzero(wants[:, part[lo] - here[0] * per_shard])
                        rough[some, lo:hi] = q[some] @ x[lo:hi].T
                    row, col, score = best(ids, x, q_ids, q, rough, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[col]), pa.array(score)], names=["query_id", "vec_id", "score"])

    both = left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys, "part", "vec_id")
    found = both.mapInArrow(compare, "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), index
