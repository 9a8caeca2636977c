"""N-gram Jaccard self-join by chosen paths: all pairs of texts whose sets of five-word shingles are 0.8 alike or more.

Equal sets are one representative from the first step on. Each representative is embedded in a fixed number of
min-hash tokens; a run splits the representatives recursively by tokens that all of a bucket sample alike, a little
over one token a node (1 / 0.8 on average, more from FIRST_LEVELS on), so that a pair at the threshold goes on together
in one branch on average and unlike texts part quickly. Spark deals buckets out a few levels at a time until they fit
in a task, which compares all of a bucket's tokens. Runs are repeated until the recall wanted: as many as `runs_for` says
that pairs at the threshold need at the deepest level.

What a bucket yields is not pairs but a spanning forest of those that look alike: its edges join representatives to
groups of candidates. In a group, each pair is then compared on its exact sets, block against block, and only each
one's number of links and the classes of linked texts leave the task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import NULL_ID, components, keep_rows, lean, rows_of, text_column, written
from tidewright.llm.tokens import Memory

WIDTH = 5
TOKENS = 64
#: Share of pairs at the threshold THRESHOLD that some run has to keep together down to the last of MOST_LEVELS.
TARGET, THRESHOLD = 0.994, 0.8
FIRST_LEVELS, MORE_LEVELS, MOST_LEVELS = 3, 3, 12
#: Of 256 nodes, how many sample a second token, in the first levels and below. All runs sample the same tokens, of which
#: a pair at the threshold may share far less than 0.8; more branches below hold such a pair together however deep it goes.
SECOND, SECOND_BELOW = 64, 128
TASK_ROWS = 2048
#: Rows of a bucket that are compared with its others at a time.
SMALL = 48
#: Share of equal min-hash tokens from which two may be 0.8 alike: 3.5 standard deviations below 0.8.
LOOKS_ALIKE = 0.62
BLOCK = 384
COLUMNS = 4096
_rng = np.random.default_rng(2024)
A = (_rng.integers(1, 1 << 32, TOKENS, dtype=np.uint64) | 1).astype(np.uint32)
B = _rng.integers(0, 1 << 32, TOKENS, dtype=np.uint64).astype(np.uint32)
PRIMES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hasher():
    import xxhash

    return Memory(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")), 250_000)


def shingles(text: str, known: Memory) -> np.ndarray:
    """The sorted set of hashes of WIDTH words in a row, lower case, split at ASCII white space; fewer words make one."""
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.lower().split(" ") if w]
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < WIDTH:
        return mix(np.array([sum(int(x) * int(p) for x, p in zip(h, PRIMES, strict=False)) + len(h) & (1 << 64) - 1], np.uint64)) if len(h) else h
    n = len(h) - WIDTH + 1
    total = h[:n] * PRIMES[0]
    for k in range(1, WIDTH):
        total += h[k : n + k] * PRIMES[k]
    return np.unique(mix(total))


def sketch(s: np.ndarray) -> np.ndarray:
    """TOKENS min-hashes, 32 bits each."""
    low = np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        v = x[at : at + 4096, None] * A + B
        low = np.minimum(low, (v ^ (v >> np.uint32(15))).min(axis=0))
    return low


def recall(similarity: float, levels: int, runs: int) -> float:
    """Share of pairs that some run keeps together over so many levels, over the binomial number of tokens they share."""
    from math import comb

    kept = 0.0
    for k in range(int(np.ceil(LOOKS_ALIKE * TOKENS)), TOKENS + 1):
        p, together = k / TOKENS, 1.0
        for level in reversed(range(levels)):
            second = (SECOND if level < FIRST_LEVELS else SECOND_BELOW) / 256
            together = 1 - (1 - p * together) * (1 - second * p * together)
        kept += comb(TOKENS, k) * similarity**k * (1 - similarity) ** (TOKENS - k) * (1 - (1 - together) ** runs)
    return kept


def runs_for(target: float) -> int:
    """The least number of runs that reaches the recall wanted."""
    if not target < recall(THRESHOLD, MOST_LEVELS, 1 << 20):
        raise ValueError(f"no number of runs reaches {target}")
    runs = 1
    while recall(THRESHOLD, MOST_LEVELS, runs) < target:
        runs += 1
    return runs


def deeper(path: np.ndarray, tokens: np.ndarray, levels: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of what each (path, tokens) at a level splits into, `levels` further down. All of a bucket sample alike."""
    row = np.arange(len(path))
    for at_level in range(level, level + levels):
        h = mix(path)
        first = (h >> np.uint64(8)) % np.uint64(TOKENS)
        second = (first + np.uint64(1) + (h >> np.uint64(20)) % np.uint64(TOKENS - 1)) % np.uint64(TOKENS)
        both = (h & np.uint64(255)) < np.uint64(SECOND if at_level < FIRST_LEVELS else SECOND_BELOW)
        at = np.concatenate([np.arange(len(path)), np.flatnonzero(both)])
        token = np.concatenate([first, second[both]])
        value = tokens[row[at], token.astype(np.int64)].astype(np.uint64)
        path = mix(path[at] * PRIMES[1] ^ mix((value << np.uint64(8)) + token + np.uint64(1)))
        row = row[at]
    return row, path


def roots(runs: int) -> np.ndarray:
    return mix(np.arange(1, runs + 1, dtype=np.uint64) * PRIMES[0])


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def bucket_edges(tokens: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the rows of a bucket that look alike; each pair is compared."""
    need, n = LOOKS_ALIKE * TOKENS, len(tokens)
    if n == 2:
        return [(0, 1)] if (tokens[0] == tokens[1]).sum() >= need else []
    if n <= SMALL:
        forest = Forest(n)
        alike = (tokens[:, None, :] == tokens[None, :, :]).sum(axis=2) >= need
        return [(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(np.triu(alike, 1))), strict=True) if forest.join(a, b)]
    # by the low bytes of the tokens: equal tokens stay equal, and a few more look so
    low, label, edges = np.ascontiguousarray((tokens & np.uint32(255)).astype(np.uint8).T), np.arange(n), []
    for at in range(0, n, SMALL):
        rows = low[:, at : at + SMALL, None]
        same, equal = np.zeros((rows.shape[1], n - at), np.uint8), np.empty((rows.shape[1], n - at), bool)
        for k in range(TOKENS):
            np.equal(rows[k], low[k, at:], out=equal)
            same += equal.view(np.uint8)
        alike = np.triu(same >= need, 1)
        for a in np.flatnonzero(alike.any(axis=1)).tolist():
            others = at + np.flatnonzero(alike[a])
            for x, b in zip(*np.unique(label[others], return_index=True), strict=True):
                if x != label[at + a]:
                    edges.append((at + a, int(others[b])))
                    label[label == x] = label[at + a]
    return edges


def sorted_groups(batches, key: tuple[str, ...]):
    """(key, [columns]) of runs of equal keys in batches sorted by key, over the borders of batches."""
    held, held_key = [], None
    names = None
    for batch in batches:
        names = batch.schema.names
        rows = list(zip(*(batch.column(c).to_pylist() for c in names), strict=True))
        at = [names.index(k) for k in key]
        for r in rows:
            k = tuple(r[i] for i in at)
            if k != held_key and held:
                yield held_key, list(zip(*held, strict=True))
                held = []
            held_key = k
            held.append(r)
    if held:
        yield held_key, list(zip(*held, strict=True))


def compare(sets: list[np.ndarray], first: int) -> np.ndarray:
    """Matrix [i, j] of whether sets i < first and j are alike by 0.8; if first is all, of all against all."""
    n = np.array([len(s) for s in sets])
    flat, which = np.unique(np.concatenate(sets), return_inverse=True)
    owner, counts = np.repeat(np.arange(len(sets)), n), np.bincount(which)
    column = np.cumsum(counts > 1) - 1
    shared = counts[which] > 1
    owner, column = owner[shared], column[which[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((first, len(sets)), np.float32)
    top = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, top, COLUMNS):
        a, b = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), min(COLUMNS, top - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        common += m[:first] @ m.T
    return 9 * common >= 4 * (n[:first, None] + n[None, :]) - 0.5


def jaccard_join(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_copies, n_shingles.

    n_links counts the other rows whose set is 0.8 alike or more, copies included. class_id is the least doc_id of
    those joined by links, over any number of them. Rows whose sets are equal are alike, also the empty sets of null
    texts and texts without words. doc_ids may be null or repeat: each row is one member. An empty table gives no rows.
    """
    rows, members = classes_of(docs, runs_for(target))
    # digests with over a thousandth of the rows, under a thousand of them, are settled without a shuffle
    heavy = members.where(F.col("copies") > rows.count() / 1000)
    many, few = rows.join(F.broadcast(heavy), "digest"), rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").join(members, "digest")
    kept = ["doc_id", "class_id", "n_links", F.col("copies").alias("n_copies"), "n_shingles"]
    return many.select(kept).unionByName(few.select(kept))


def first_of_each_class(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """The rows of docs, all columns, but of each class of linked texts only the row with the least doc_id (null last)."""
    rows, members = classes_of(docs, runs_for(target))
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id_key"), F.col("text_hash").alias("text_key"))
    # the least row of each digest first, so that no class is gathered, then of each class
    least = rows.groupBy("digest").agg(F.min(name).alias("name")).join(members, "digest").groupBy("class").agg(F.min("name").alias("name"))
    names = rows.groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id_key"), F.col("text_hash").alias("text_key")).agg((F.count("*") > 1).alias("repeats"))
    return keep_rows(docs, written(least.select("name.id_key", "name.text_key").join(names, ["id_key", "text_key"]), "winners"))


def classes_of(docs: DataFrame, runs: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, text_hash, digest, n_shingles, row; members: digest, class, class_id, n_links, copies)."""
    import pyarrow as pa

    text = text_column(docs).alias("text")
    key = F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash")

    def embed(batches):
        import xxhash

        known, out, names = hasher(), [], ["doc_id", "text_hash", "digest", "n_shingles", "tokens"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        for doc_id, text_hash, body in rows_of(batches, "doc_id", "text_hash", "text"):
            s = shingles(body, known)
            out.append((doc_id, text_hash, xxhash.xxh3_128_digest(s.tobytes()), len(s), sketch(s).tobytes()))
            if len(out) == 2048:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    all_rows = docs.select(docs["doc_id"], text).select(*key, "text").mapInArrow(lean(embed), "doc_id long, text_hash long, digest binary, n_shingles long, tokens binary")
    rows = written(all_rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = written(rows.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("copies"), F.min("doc_id").alias("least")), "groups")
    reps = written(rows.where("n_shingles > 0").select(F.col("row").alias("rep"), "doc_id", "text_hash", "tokens").join(groups.select("rep", "copies"), "rep"), "reps")
    candidates = components(candidate_edges(reps, runs))
    grouped = reps.drop("tokens").join(candidates.withColumnRenamed("node", "rep"), "rep")
    found = written(verify(docs.select(docs["doc_id"], text).select(*key, "text"), grouped), "found")
    links = found.where("kind = 0").groupBy("rep").agg(F.sum("links").alias("links"), F.min("other").alias("class"))
    wide = components(found.where("kind = 1").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    links = links.join(wide.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "links", F.coalesce("label", "class", "rep").alias("class"))
    members = groups.join(links, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
    classes = members.groupBy("class").agg(F.min("least").alias("class_id"))
    members = written(members.join(classes, "class").select("digest", "class", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies"), "members")
    return rows, members


def candidate_edges(reps: DataFrame, runs: int) -> DataFrame:
    """reps (rep, tokens) -> edges (a, b) between those that may be alike, as forests of their buckets."""
    import pyarrow as pa

    def split(levels: int, level: int):
        def run(batches):
            for batch in batches:
                tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS)
                rep = batch.column("rep").to_numpy()
                if not level:
                    path = np.repeat(roots(runs), len(rep))
                    rep, tokens = np.tile(rep, runs), np.tile(tokens, (runs, 1))
                else:
                    path = batch.column("path").to_numpy().view(np.uint64)
                row, path = deeper(path, tokens, levels, level)
                yield pa.RecordBatch.from_pydict({"path": pa.array(path.view(np.int64)), "rep": pa.array(rep[row])})

        return run

    def solve(batches):
        a, b = [], []
        for _, (_, rep, tokens) in sorted_groups(batches, ("path",)):
            rep = np.array(rep)
            t = np.frombuffer(b"".join(tokens), np.uint32).reshape(-1, TOKENS)
            for x, y in bucket_edges(t):
                a.append(rep[x])
                b.append(rep[y])
            if len(a) > 100_000:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
                a, b = [], []
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sized = reps.select("rep", "tokens")
    paths = written(sized.mapInArrow(lean(split(FIRST_LEVELS, 0)), "path long, rep long"), "paths")
    level, edges = FIRST_LEVELS, None
    while True:
        buckets = written(paths.groupBy("path").count().where("count > 1"), "buckets")
        here = written(paths.join(buckets, "path").join(sized, "rep"), "here")
        small = here.where(F.col("count") <= TASK_ROWS).select("path", "rep", "tokens")
        some = small.repartition("path").sortWithinPartitions("path", "rep").mapInArrow(lean(solve), "a long, b long").distinct()
        edges = some if edges is None else edges.unionByName(some)
        large = here.where(F.col("count") > TASK_ROWS)
        if large.isEmpty():
            return edges
        if level >= MOST_LEVELS:  # those that have stayed together this long are candidates of each other
            hubs = large.groupBy("path").agg(F.min("rep").alias("a"))
            return edges.unionByName(large.join(hubs, "path").select("a", F.col("rep").alias("b")).where("a <> b").distinct())
        paths = written(large.select("path", "rep", "tokens").mapInArrow(lean(split(MORE_LEVELS, level)), "path long, rep long"), "paths")
        level += MORE_LEVELS


def verify(texts: DataFrame, grouped: DataFrame) -> DataFrame:
    """grouped (rep, doc_id, text_hash, copies, label) -> (kind, rep, other, links) by the exact sets of each group.

    kind 0: links of rep to the others of two blocks, weighed by copies; other: the class of rep, if the group is of
    one block. kind 1: an edge of the forest of links of two blocks of a larger group. A group of n texts takes
    n / BLOCK blocks, and each pair of blocks is a task's work of bounded size.
    """
    import pyarrow as pa

    sizes = grouped.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    null = F.lit(NULL_ID)
    ready = grouped.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("doc_id", F.coalesce("doc_id", null))
    joined = texts.withColumn("doc_id", F.coalesce("doc_id", null)).join(ready, ["doc_id", "text_hash"])
    joined = joined.select("rep", "label", "copies", "blocks", "block", "text")
    schema = pa.schema([("label", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("blocks", pa.int64()), ("block", pa.int64()), ("shingles", pa.binary())])

    def to_sets(batches):
        known, out, held, done = hasher(), [], 0, set()

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        for rep, label, copies, blocks, block, body in rows_of(batches, "rep", "label", "copies", "blocks", "block", "text", step=64):
            if rep in done:  # rows that repeat id and text all join with their representative
                continue
            done.add(rep)
            raw = shingles(body, known).tobytes()
            for x in range(blocks):
                out.append((label, min(x, block), max(x, block), rep, copies, blocks, block, raw))
                held += len(raw)
                if held > 1 << 24:
                    yield batch()
                    out, held = [], 0
        if out:
            yield batch()

    def check(batches):
        out = []

        def batch():
            kind, rep, other, links = zip(*out, strict=True)
            return pa.RecordBatch.from_pydict({"kind": pa.array(kind, pa.int32()), "rep": pa.array(rep, pa.int64()), "other": pa.array(other, pa.int64()), "links": pa.array(links, pa.int64())})

        for (_, i, j), (_, _, _, rep, copies, blocks, block, raw) in sorted_groups(batches, ("label", "i", "j")):
            unique = sorted({r: at for at, r in enumerate(rep)}.items(), key=lambda x: (block[x[1]], x[0]))  # equal rows join more than once
            at = [x[1] for x in unique]
            sets = [np.frombuffer(raw[k], np.uint64) for k in at]
            ids, weight = [rep[k] for k in at], np.array([copies[k] for k in at], np.int64)
            first = sum(block[k] == i for k in at)
            if not first or first == len(at) and i != j:
                continue
            alike = compare(sets, first)
            if i == j:
                np.fill_diagonal(alike, False)
            else:
                alike[:, :first] = False
            forest = Forest(len(ids))
            tree = [(a, b) for a, b in zip(*(x.tolist() for x in np.nonzero(alike)), strict=True) if forest.join(a, b)] if alike.any() else []
            of_first = alike @ weight
            links = of_first if i == j else np.concatenate([of_first, (weight[:first] @ alike)[first:]])
            one = blocks[0] == 1
            out += [(0, r, ids[forest.find(k)] if one else None, n) for k, (r, n) in enumerate(zip(ids, links.tolist(), strict=True))]
            if not one:
                out += [(1, ids[a], ids[b], 0) for a, b in tree]
            if len(out) > 50_000:
                yield batch()
                out = []
        if out:
            yield batch()

    sets = joined.mapInArrow(lean(to_sets), "label long, i long, j long, rep long, copies long, blocks long, block long, shingles binary")
    dealt = sets.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "rep")
    return dealt.mapInArrow(lean(check), "kind int, rep long, other long, links long")
