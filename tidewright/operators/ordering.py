"""Places and running totals over a whole order, without a task that holds all rows.

Rows are dealt by range and sorted inside their partitions; what earlier partitions hold is added to each place. A
group of rows, of whatever size, is spread over as many partitions as it fills.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.session import shared_path

#: Rows (shares that partitions have of groups) up to which they are broadcast: some MB.
FEW = 100_000


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows in the order of `by`, saved, with _part and _row: the partition, and the place in it (growing, not gapless by group)."""
    ranged = rows.repartitionByRange(*map(F.col, by)).sortWithinPartitions(*by)
    out = saved(ranged.withColumn("_place", F.monotonically_increasing_id()), "placed")  # the upper bits of a place are its partition
    return out.select(*rows.columns, F.shiftright("_place", 33).alias("_part"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """That the keys of both are equal, null being equal to null."""
    return functools.reduce(operator.and_, (left[k].eqNullSafe(right[f"_of_{k}"]) for k in keys))


def with_shares(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows of `placed` joined to their partition's share of their group: _k rows, _first, and totals of `columns`.

    Adds _<c>_before and _<c>_all for each c of _k and `columns`: the sums over the group's earlier partitions, and over all.
    """
    sums = [F.count("*").alias("_k"), F.min("_row").alias("_first"), *(F.sum(c).alias(f"_sum_{c}") for c in columns)]
    shares = rows.groupBy(*keys, "_part").agg(*sums)
    group, before = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    added = []
    for c, total in (("k", "_k"), *((c, f"_sum_{c}") for c in columns)):
        added += [F.coalesce(F.sum(total).over(before), F.lit(0)).alias(f"_{c}_before"), F.sum(total).over(group).alias(f"_{c}_all")]
    names = [*keys, "_part"]
    shares = saved(shares.select(*(F.col(n).alias(f"_of_{n}") for n in names), "_first", *added), "shares")
    shares = F.broadcast(shares) if shares.count() <= FEW else shares
    return rows.join(shares, same(rows, shares, names)).drop(*(f"_of_{n}" for n in names))


def numbered(rows: DataFrame, keys: list[str], order: list[str], nth: str = "nth", size: str = "size") -> DataFrame:
    """Adds nth, from 0 along each group in the order given, and size, the group's rows. Ties are numbered in any order."""
    found = with_shares(placed(rows, [*keys, *order]), keys, [])
    return found.select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_k_before")).alias(nth), F.col("_k_all").alias(size))


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, before: str = "before", total: str = "total") -> DataFrame:
    """Adds the sum of `value` over the group's rows that stand before (0 for the first), and over all of them."""
    found = with_shares(placed(rows, [*keys, *order]), keys, [value])
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return found.withColumn("_here", here).select(*rows.columns, (F.col(f"_{value}_before") + F.col("_here")).alias(before), F.col(f"_{value}_all").alias(total))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and, for each name of `shares`, that quantile of the group's values, between its two neighbours where it meets none.

    Exact: values are counted before they are put in order by ranges. Nulls count for nothing; a group of nulls has null quantiles.
    """
    counts = rows.groupBy(*keys, F.col(value).alias("_value")).agg(F.count(value).alias("_n"))
    counts = saved(counts, "counts")  # ranges are told from a first pass over them
    found, out = running(counts, keys, ["_value"], "_n", "_before", "_total"), []
    for name, share in shares.items():
        place = F.lit(share) * (F.col("_total") - 1)
        low, high = (F.max(F.when((F.col("_before") <= at) & (at < F.col("_before") + F.col("_n")), F.col("_value"))) for at in (F.floor(place), F.ceil(place)))
        part = F.max(place - F.floor(place))
        out.append(F.when(part == 0, low).otherwise(low + (high - low) * part).alias(name))
    return found.groupBy(*keys).agg(*out)
