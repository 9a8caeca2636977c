"""Inserts that are refused on a conflict with any of several unique keys, as of a table filled in order of arrival.

A row is kept if no kept row before it has one of its keys: the lexicographically first independent set of the graph
of conflicts. Rows are settled in rounds. A row that comes first among the undecided on each of its keys has no
undecided row before it that it conflicts with, and none that was kept, or it would have been refused: it is kept, and
whatever shares a key with it is refused. Each round settles at least the first undecided row, and most rows at once
where conflicts don't form chains; a chain of n rows, each in conflict with the next, takes n / 2 rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordering import saved


def first_of_any(rows: DataFrame, keys: list[str], order: list[str], blanks: bool = False) -> DataFrame:
    """The rows that are kept when they arrive in the order given and each of `keys` is unique.

    A null key conflicts with nothing, as in SQL. A blank one (empty or white space) conflicts with nothing either,
    unless `blanks`: then it is a value like any other, as it is to a unique column that can't be null. Rows that tie
    in `order` arrive in any order. A round reads keys, not whole rows, and what it takes of a key shared by very many
    rows is one minimum.
    """
    arrived = saved(rows.withColumn("_row", F.monotonically_increasing_id()), "arrived")

    def value(k: str):
        v = arrived[f"`{k}`"].cast("string")
        return v if blanks else F.when(F.trim(F.regexp_replace(v, r"\s", " ")) != "", v)

    taken = F.filter(F.array(*(F.struct(F.lit(i).alias("key"), value(k).alias("value")) for i, k in enumerate(keys))), lambda x: x["value"].isNotNull())
    named = arrived.select(F.struct(*(arrived[f"`{c}`"] for c in order), "_row").alias("at"), taken.alias("taken"))
    free = named.where(F.size("taken") == 0).select("at._row")
    left = saved(named.select("at", F.size("taken").alias("needs"), F.explode("taken").alias("k")).select("at", "needs", "k.key", "k.value"), "left")
    kept = free
    while not left.isEmpty():
        first = left.groupBy("key", "value").agg(F.min(F.struct("at", "needs")).alias("first"))
        winners = first.groupBy("first.at._row").agg(F.count("*").alias("wins"), F.first("first.needs").alias("needs"))
        winners = saved(winners.where("wins = needs").select("_row"), "winners")
        kept = kept.unionByName(winners)
        settled = left.withColumn("_row", F.col("at._row")).join(winners, "_row", "left_semi").select("key", "value")
        gone = left.join(settled, ["key", "value"], "left_semi").select("at._row").distinct()
        left = saved(left.withColumn("_row", F.col("at._row")).join(gone, "_row", "left_anti").drop("_row"), "left")
    return arrived.join(kept, "_row", "left_semi").drop("_row")
