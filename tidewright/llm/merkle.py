"""Merkle manifest of a dataset: a tree of hashes for each source, authentication paths by Merkle traversal.

Leaves are hashed where they are read and numbered along their source by a range partitioning with offsets. Aligned
blocks of WIDTH ** HEIGHT consecutive nodes are folded by treehash, block roots are the nodes of the next round, until
a source has one node; the sources' roots are folded in the same way. Paths then come down: a block's task walks its
nodes from left to right with treehash stacks that prepare each level's next run while the present one is in use, and
appends the path of the block itself, which its nodes share. No task sees more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import written

WIDTH = 16
HEIGHT = 3
#: Rows (a range partition's share of a source) up to which their offsets are broadcast: some MB.
FEW = 100_000
DIGITS = 64
PATH = "array<struct<at:int,run:string>>"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def folded(run: Sequence[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def height(size: int, most: int) -> int:
    """Levels, at most `most`, that a block of a tree of `size` nodes folds."""
    levels = 0
    while size > 1 and levels < most:
        size, levels = -(-size // WIDTH), levels + 1
    return levels


class Treehash:
    """Folds nodes given one by one into nodes `levels` above, holding an unfinished run at each level."""

    def __init__(self, levels: int):
        self.runs: list[list[str]] = [[] for _ in range(levels)]

    def push(self, node: str) -> str | None:
        """A node of the top, when this one finishes it."""
        for run in self.runs:
            run.append(node)
            if len(run) < WIDTH:
                return None
            node = folded(run)
            run.clear()
        return node

    def close(self) -> str | None:
        """The node of what is unfinished: runs of fewer, even one."""
        node = None
        for run in self.runs:
            if node is not None:
                run.append(node)
            node = folded(run) if run else None
            run.clear()
        return node


class Ahead:
    """The run at a level that begins at node `start`, prepared node by node."""

    def __init__(self, nodes: Sequence[str], level: int, start: int):
        self.nodes, self.next, self.end = nodes, start, min(len(nodes), start + WIDTH ** (level + 1))
        self.stack, self.run = Treehash(level), []

    def advance(self) -> None:
        if self.next < self.end:
            done = self.stack.push(self.nodes[self.next])
            self.next += 1
            if done is not None:
                self.run.append(done)

    def finish(self) -> list[str]:
        while self.next < self.end:
            self.advance()
        last = self.stack.close()
        return self.run + [last] if last is not None else self.run


def traverse(nodes: Sequence[str], levels: int) -> Iterator[list[tuple[int, str]]]:
    """For each node of a block in turn, its path: at each level the place in its run (from 0) and the run's text."""
    present = ["".join(Ahead(nodes, k, 0).finish()) for k in range(levels)]
    ahead = [Ahead(nodes, k, WIDTH ** (k + 1)) for k in range(levels)]
    for i in range(len(nodes)):
        for k in range(levels):
            span = WIDTH ** (k + 1)
            if i and i % span == 0:
                present[k], ahead[k] = "".join(ahead[k].finish()), Ahead(nodes, k, i + span)
            ahead[k].advance()
        yield [(i // WIDTH**k % WIDTH, present[k]) for k in range(levels)]


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds to rows (tree and others; repeatable) nth, from 0 along each tree in the given order, and size, the tree's rows.

    A tree is spread over as many range partitions as it fills; places inside a partition get the sum of the earlier
    partitions' counts added, so no task holds a tree.
    """
    placed = rows.repartitionByRange(*map(F.col, ["tree", *order])).sortWithinPartitions("tree", *order)
    placed = written(placed.withColumn("place", F.monotonically_increasing_id()), "placed")
    part, row = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    shares = placed.groupBy("tree", part).agg(F.min(row).alias("first"), F.count("*").alias("k"))
    along = Window.partitionBy("tree").orderBy("part")
    shares = shares.select("tree", "part", (F.sum("k").over(along) - F.col("k") - F.col("first")).alias("shift"), F.sum("k").over(Window.partitionBy("tree")).alias("size"))
    shares = written(shares, "shares")
    shares = F.broadcast(shares) if shares.count() <= FEW else shares
    out = placed.withColumn("part", part).join(shares, ["tree", "part"])
    return out.select(*rows.columns, (row + F.col("shift")).alias("nth"), "size")


def roots(nodes: DataFrame, most: int) -> DataFrame:
    """nodes (tree, nth, size, node) -> the same columns of the nodes above their blocks."""
    import pyarrow as pa

    wide = WIDTH**most

    def fold(key, block):
        block = block.sort_by("nth")
        size = block.column("size")[0].as_py()
        stack, node = Treehash(height(size, most)), None
        for x in block.column("node").to_pylist():
            node = stack.push(x.hex()) or node
        node = stack.close() or node
        return pa.table({"tree": [key[0].as_py()], "nth": pa.array([key[1].as_py()], pa.int64()), "size": pa.array([-(-size // wide)], pa.int64()), "node": pa.array([bytes.fromhex(node)], pa.binary())})

    each = nodes.select("tree", F.expr(f"nth div {wide}").alias("block"), "nth", "size", "node")
    return each.groupBy("tree", "block").applyInArrow(fold, "tree string, nth long, size long, node binary")


def climb(nodes: DataFrame, most: int) -> list[DataFrame]:
    """nodes (tree, nth, size, node), the nodes above their blocks, and so on up to one node for each tree."""
    tables = [nodes]
    while (tables[-1].agg(F.max("size")).first()[0] or 0) > 1 or len(tables) == 1:
        tables.append(written(roots(tables[-1], most), f"nodes{len(tables)}"))
    return tables


def descend(tables: list[DataFrame], top: DataFrame, most: int) -> DataFrame:
    """The first of `climb`'s tables, with path and subroot; top (tree, nth, path, subroot) has those of the last."""
    import pyarrow as pa

    step = pa.struct([("at", pa.int32()), ("run", pa.string())])

    def walk(key, block, above):
        block = block.sort_by("nth")
        shared = [(x["at"], x["run"]) for x in above.column("path")[0].as_py()]
        nodes = [x.hex() for x in block.column("node").to_pylist()]
        levels = height(block.column("size")[0].as_py(), most)
        paths = [own + shared for own in traverse(nodes, levels)]
        flat = [x for p in paths for x in p]
        steps = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int32()), pa.array([r for _, r in flat], pa.string())], fields=list(step))
        offsets = pa.array([k * (levels + len(shared)) for k in range(len(nodes) + 1)], pa.int32())
        out = block.drop_columns(["block"]).append_column("path", pa.ListArray.from_arrays(offsets, steps))
        return out.append_column("subroot", pa.array([above.column("subroot")[0].as_py()] * len(nodes), pa.string()))

    for nodes in tables[-2::-1]:
        keyed = nodes.withColumn("block", F.expr(f"nth div {WIDTH**most}"))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + f", path {PATH}, subroot string"
        upper = top.select(F.col("tree"), F.col("nth").alias("block"), "path", "subroot")
        top = keyed.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(walk, schema)
    return top


def leaf(columns: dict[str, Column]) -> Column:
    """The hash of a row: each field as its length in bytes, a colon and its value, a dash where it is null."""
    parts = []
    for c in FIELDS:
        s = columns[c].cast("string")
        parts.append(F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts), 256)


def tampered(docs: DataFrame) -> Column:
    """The contract's change: where 5 divides the crc32 of the id, A-Z in the text become small; else null."""
    from tidewright.llm.decontaminate import LOWER, UPPER

    columns = {c: docs[c] for c in FIELDS}
    changed = leaf(columns | {"text": F.translate(docs["text"], UPPER, LOWER)})
    return F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0, changed)


def manifest(docs: DataFrame, other: Column | None = None, most: int = HEIGHT) -> DataFrame:
    """One row per row of docs: doc_id, leaf, other, subroot, root, path.

    docs has doc_id, source, lang, n_chars and text, any of them null. path is the authentication path, from the
    leaf's own run of siblings up to the root's: at (place of the node in its run, from 0) and run (the digests of the
    run, one after another). Rows that repeat an id are leaves of their own, in order of their hashes; null ids come
    first. A null source is a source. An empty table gives no rows. `other` is a digest of the caller that goes along
    with each row (a hash of what is to be verified), or null. Blocks are `most` levels high. Other columns are not read.
    """
    other = F.lit(None).cast("string") if other is None else other
    tree = F.coalesce(F.concat(F.lit("="), docs["source"].cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), docs["doc_id"].cast("long").alias("doc_id"), F.unhex(leaf({c: docs[c] for c in FIELDS})).alias("node"), F.unhex(other).alias("other"))
    sources = climb(numbered(written(leaves, "leaves"), ["doc_id", "node", "other"]), most)
    subroots = sources[-1]
    whole = climb(numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "node"), ["source"]), most)
    root = [r[0].hex() for r in whole[-1].select(F.col("node")).collect()]  # one, or none of an empty table
    top = whole[-1].select("tree", "nth", F.array().cast(PATH).alias("path"), F.lit("").alias("subroot"))
    by_source = written(descend(whole, top, most).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("nth"), "path", F.lower(F.hex("node")).alias("subroot")), "paths")
    out = descend(sources, by_source, most)
    text = lambda c: F.lower(F.hex(c))
    return out.select("doc_id", text("node").alias("leaf"), text("other").alias("other"), "subroot", F.lit(root[0] if root else None).alias("root"), "path")


def before(p: Column) -> Column:
    return F.substring(p["run"], F.lit(1), p["at"] * DIGITS)


def after(p: Column) -> Column:
    return F.substring(p["run"], p["at"] * DIGITS + (DIGITS + 1), F.length(p["run"]))


def siblings(path: Column) -> Column:
    """All siblings on a path, one after another."""
    return F.array_join(F.transform(path, lambda p: F.concat(before(p), after(p))), "")


def root_from(path: Column, digest: Column) -> Column:
    """The root that a leaf's digest gives with the siblings on its path."""
    return F.aggregate(path, digest, lambda acc, p: F.sha2(F.concat(before(p), acc, after(p)), 256))
