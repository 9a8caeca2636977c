"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Each document of a source wants the same fractional number of copies. Whole copies are given at once; what is left, a
probability, is rounded by pivots: of two documents with fractional probabilities, mass moves from one to the other,
weighed by their sizes so that the words stay the same, until one of them is 0 or 1. The direction is drawn so that
each keeps its probability on average. Blocks of at most BLOCK documents are folded this way, each leaving one
document undecided; those are the next round's documents, until one is left for each source, which is drawn alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import NULL_ID, written

BLOCK = 256
WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: A document of more than 1 / LARGE of its source is rounded before the others, whose rate then makes up for the difference.
LARGE = 32
FEW_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"
UNIT = "struct<size:bigint,row:binary,p:double>"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> also target: shares of the total by weight, none above `most` times its source.

    Sources are weighed in order of code points, null last, the weights repeating. Filling up: with a level L, a
    source gets least(most * size, weight * L); L is such that the targets add up to the total. Sources are as
    many as the corpus has kinds, so one window over them is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("nth", F.row_number().over(order) - 1).withColumn("weight", pick)
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    up = Window.orderBy(F.col("cap") / F.col("weight"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.sum("source_size").over(every).cast("double").alias("total"), F.sum("weight").over(every).alias("all_weight"), F.coalesce(F.sum("cap").over(up), F.lit(0.0)).alias("cap_below"), F.coalesce(F.sum("weight").over(up), F.lit(0.0)).alias("weight_below"))
    level = (F.col("total") - F.col("cap_below")) / (F.col("all_weight") - F.col("weight_below"))
    # the first source, in order of cap / weight, that the level of what is left doesn't fill sets the level of all
    full = F.col("cap") / F.col("weight")
    level = F.min(F.when(level <= full, F.struct(full, "nth", level.alias("level")))).over(every)["level"]
    return s.select("source", "source_size", F.least("cap", F.col("weight") * F.coalesce(level, F.lit(float("inf")))).alias("target"))


def draw(seed: int, *of) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) / F.lit(float(1 << 53))


def fold(units: Column, seed: int) -> Column:
    """Pivots an array of units one after another: struct(left: the undecided unit or null, done: array of (row, p))."""
    none, unit = F.lit(None).cast(UNIT), lambda u, p: F.struct(u["size"].alias("size"), u["row"].alias("row"), p.alias("p"))
    whole = lambda p: (p <= 1e-12) | (p >= 1 - 1e-12)

    def step(acc: Column, x: Column) -> Column:
        held = acc["left"]
        a, b = F.least((1 - held["p"]) * held["size"], x["p"] * x["size"]), F.least(held["p"] * held["size"], (1 - x["p"]) * x["size"])
        move = F.when(draw(seed, held["row"], x["row"]) * (a + b) < b, a).otherwise(-b)
        moved = F.transform(F.array(move), lambda m: F.struct((held["p"] + m / held["size"]).alias("h"), (x["p"] - m / x["size"]).alias("x")))[0]
        pair = F.filter(F.array(unit(held, moved["h"]), unit(x, moved["x"])), lambda u: whole(u["p"]))
        rest = F.filter(F.array(unit(held, moved["h"]), unit(x, moved["x"])), lambda u: ~whole(u["p"]))
        pivoted = F.struct(F.get(rest, F.lit(0)).alias("left"), F.concat(acc["done"], F.transform(pair, lambda u: unit(u, F.round(u["p"])))).alias("done"))
        return F.when(held.isNull(), F.struct(x.alias("left"), acc["done"].alias("done"))).otherwise(pivoted)

    return F.aggregate(units, F.struct(none.alias("left"), F.array().cast(f"array<{UNIT}>").alias("done")), step)


def round_fractions(units: DataFrame, n_units: int, seed: int, block: int = BLOCK) -> DataFrame:
    """units (part, row, size > 0, 0 < p < 1; row unique) -> (row, taken 0 or 1). n_units: about how many in a part at most."""
    done, at, left = None, 0, units
    while True:
        # a hash deals units into blocks of about half the bound, numbering splits what comes out larger
        deal = F.pmod(F.xxhash64(F.lit(seed + at), "row"), F.lit(max(1, -(-2 * n_units // block))))
        nth = F.row_number().over(Window.partitionBy("part", "deal").orderBy("row"))
        dealt = left.withColumn("deal", deal).withColumn("block", F.floor((nth - 1) / block))
        groups = dealt.groupBy("part", "deal", "block").agg(F.sort_array(F.collect_list(F.struct("size", "row", "p")), asc=False).alias("units"))
        folded = written(groups.select("part", fold(F.col("units"), seed + at).alias("f")), f"round{at}")
        new = folded.select(F.explode("f.done").alias("u")).select("u.row", F.col("u.p").cast("long").alias("taken"))
        done = new if done is None else done.unionByName(new)
        left = folded.where("f.left is not null").select("part", "f.left.row", "f.left.size", "f.left.p")
        at += 1
        n_units = left.groupBy("part").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        if n_units <= 1:
            return done.unionByName(left.select("row", (draw(seed + at, "row") < F.col("p")).cast("long").alias("taken")))


def word_count(docs: DataFrame) -> Column:
    return F.coalesce(F.regexp_count(docs["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def number_rows(rows: DataFrame) -> DataFrame:
    """rows (doc_id, source, size) with nth, which tells rows of one doc_id (of one source and size, if it is null) apart."""
    w = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("source", "size"))).orderBy("size", F.col("source").asc_nulls_last())
    return rows.withColumn("nth", F.row_number().over(w))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Rows are met by id, source and size, and go through one join; only those that repeat all three are numbered among
    themselves, as mix_sources numbers them. Rows that repeat an id, or id and text, are rows of their own; documents
    without words, null texts among them, are taken 0 times; an empty table gives no rows.
    """
    key = lambda d: [F.coalesce(d["doc_id"].cast("long"), F.lit(NULL_ID)).alias("__id"), F.coalesce(F.concat(F.lit("="), d["source"].cast("string")), F.lit("")).alias("__source")]
    name = ["__id", "__source", "__size"]
    mixed = mix_sources(docs, **options)
    mixed = written(mixed.select(*key(mixed), mixed["size"].alias("__size"), mixed["nth"].alias("__nth"), "copies"), "mixed")
    groups = mixed.groupBy(name).agg(F.count("*").alias("rows"), F.min("__nth").alias("__first"), F.max("copies").alias("copies"))
    whole = docs.select(*key(docs), word_count(docs).alias("__size"), F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("whole"))
    found = whole.join(groups.where("rows = 1 and copies > 0").select(*name, "copies"), name).select("whole", "copies")
    repeated = groups.where("rows > 1")
    if not repeated.isEmpty():
        nth = F.row_number().over(Window.partitionBy(*name).orderBy(F.xxhash64("whole")))
        numbered = whole.join(repeated.select(*name, "__first"), name).withColumn("__nth", F.col("__first") - 1 + nth)
        found = found.unionByName(numbered.join(mixed.where("copies > 0"), [*name, "__nth"]).select("whole", "copies"))
    return found.select("whole", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("whole.*")


def mix_sources(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES, seed: int = 20, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, row, source, size, source_size, target, copies, taken (= copies * size).

    size is the number of words, 0 for null texts; documents without words are taken 0 times. A null source is a
    source of its own. `row` names the row among those that repeat a doc_id, in order of size and source, so that
    the result depends on the rows alone, not on how they are dealt out. An empty table gives no rows. A source's
    taken words differ from its target by less than the size of one of its documents.
    """
    sized = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), word_count(docs).alias("size"))
    sized = written(sized, "sizes")
    goals = written(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    # joined on a key that is never null
    key = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit(""))
    goals = goals.select(key(F.col("source")).alias("part"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    numbered = number_rows(sized).withColumn("part", key(F.col("source")))
    # 128 bits name a row, so that no two of any number of rows share a name
    name = F.to_json(F.struct("doc_id", "nth", "source", "size"))
    numbered = numbered.withColumn("row", F.unhex(F.md5(name.cast("binary"))))
    if goals.count() <= FEW_SOURCES:  # so that a source that holds much of the rows is not dealt to one task
        goals = F.broadcast(goals)
    wanted = written(numbered.join(goals, "part").withColumn("large", F.col("size") * LARGE > F.col("source_size")), "wanted")

    def rounded(rows: DataFrame, seed: int) -> DataFrame:
        rows = rows.withColumn("whole", F.floor("rate"))
        units = rows.where("size > 0 and rate - whole > 1e-12").select("part", "row", "size", (F.col("rate") - F.col("whole")).alias("p"))
        n_units = units.groupBy("part").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
        copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce("taken", F.lit(0))).otherwise(0)
        return rows.join(round_fractions(units, n_units, seed, block), "row", "left").withColumn("copies", copies.cast("long"))

    first = written(rounded(wanted.where("large"), seed), "large")
    so_far = first.groupBy("part").agg(F.sum(F.col("copies") * F.col("size")).alias("so_far"))
    rest = wanted.where("not large").groupBy("part").agg(F.first("target").alias("goal"), F.sum("size").alias("rest_size")).join(so_far, "part", "left")
    still = (F.col("goal") - F.coalesce("so_far", F.lit(0))) / F.col("rest_size")
    rest = rest.select("part", F.when(F.col("rest_size") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), still))).otherwise(0.0).alias("rate"))
    rest = F.broadcast(rest) if wanted.select("part").distinct().count() <= FEW_SOURCES else rest
    then = rounded(wanted.where("not large").drop("rate").join(rest, "part"), seed + 1)
    kept = ["doc_id", "nth", "source", "size", "source_size", "target", "copies"]
    return first.select(kept).unionByName(then.select(kept)).withColumn("taken", F.col("copies") * F.col("size"))
