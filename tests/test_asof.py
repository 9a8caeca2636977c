"""As-of joins over ranges of rows give what one window by key gives: hot keys, keys without values, ties, both directions."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import asof


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("by", [["k"], []])
def test_spread_equals_one_window(spark, strict, forward, by):
    left = spark.range(3000).select((F.col("id") % 997).alias("t"), F.when(F.col("id") % 35 == 0, F.lit(None)).when(F.col("id") % 5 < 3, "hot").when(F.col("id") % 5 == 3, "bare").otherwise(F.concat(F.lit("k"), F.col("id") % 40)).alias("k"), "id").repartition(5)
    right = spark.range(0, 997, 13).select(F.explode(F.array(F.lit("hot"), F.lit("k4"), F.lit("k9"), F.lit("only"))).alias("k"), F.col("id").alias("at"), (F.col("id") * 2).alias("v"))
    if not by:
        right = right.where("k = 'hot'").drop("k")
    rows = [sorted(map(str, asof.asof(left, right, "t", "at", by, ["v"], strict, forward, spread).collect())) for spread in (False, True)]
    assert rows[0] == rows[1] and len(rows[0]) == 3000
    if by and not forward:
        hot = {r.t: r["at"] for r in asof.asof(left, right, "t", "at", by, ["v"], strict, forward, True).where("k = 'hot'").collect()}
        assert all(at == (None if strict and not t else (t - strict) // 13 * 13) for t, at in hot.items())
