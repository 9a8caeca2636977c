"""Rolling functions over bars by symbol and date. Each returns a column; a window without all its rows gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def order():
    return Window.partitionBy("symbol").orderBy("date")


def over(k: int, end: int = 0):
    return order().rowsBetween(end - k + 1, end)


def whole(x: Column, k: int, f, end: int = 0) -> Column:
    """f(x) over k rows, all of which must have x."""
    w = over(k, end)
    return F.when(F.count(x).over(w) == k, f(x).over(w))


def lag(c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(order())


def log_return(n: int = 1, c: str = "close") -> Column:
    return F.when((F.col(c) > 0) & (lag(c, n) > 0), F.ln(F.col(c) / lag(c, n)))


def simple_return(n: int = 1, c: str = "close") -> Column:
    return F.try_divide(F.col(c), lag(c, n)) - 1


def with_returns(daily: DataFrame) -> DataFrame:
    """Adds r1 (log return) and d1 (change), which windows over them need as columns."""
    return daily.withColumn("r1", log_return()).withColumn("d1", F.col("close") - lag("close"))


def mean_return(k: int) -> Column:
    return whole(F.col("r1"), k, F.avg)


def volatility(k: int) -> Column:
    return whole(F.col("r1"), k, F.stddev_samp)


def realised_volatility(k: int) -> Column:
    return whole(F.col("r1"), k, F.stddev_pop)


def relative_volume(variant: str) -> Column:
    """before: over the mean of the 20 before, null if that isn't positive; floored: the same with a floor;
    with_current: over the mean of 6 with this one, at least 1; with_current_floored: the same with a small floor."""
    v = F.col("volume")
    if variant in ("before", "floored"):
        mean = whole(v, 20, F.avg, -1)
        return F.when(mean > 0, v / mean) if variant == "before" else F.when(mean.isNotNull(), v / F.greatest(mean, F.lit(1e-8)))
    mean = whole(v, 6, F.avg)
    return F.when(mean.isNotNull(), v / F.greatest(mean, F.lit(1.0 if variant == "with_current" else 1e-8)))


def over_average(k: int) -> Column:
    return F.try_divide(F.col("close"), whole(F.col("close"), k, F.avg)) - 1


def day_range() -> Column:
    return F.try_divide(F.col("high") - F.col("low"), F.col("close"))


def mean_range(k: int) -> Column:
    return whole(day_range(), k, F.avg)


def with_benchmark(daily: DataFrame, symbol: str) -> DataFrame:
    """Adds bench_close and bench_r1 of the benchmark on the same date. daily has r1."""
    bench = daily.where(F.col("symbol") == symbol).select("date", F.col("close").alias("bench_close"), F.col("r1").alias("bench_r1"))
    return daily.join(bench, "date")


def both(k: int, f) -> Column:
    w = over(k)
    n = F.count(F.when(F.col("r1").isNotNull() & F.col("bench_r1").isNotNull(), 1)).over(w)
    return F.when(n == k, f.over(w))


def correlation(k: int = 24) -> Column:
    """0 where a side doesn't vary."""
    w = over(k)
    n = F.count(F.when(F.col("r1").isNotNull() & F.col("bench_r1").isNotNull(), 1)).over(w)
    flat = (F.stddev_samp("r1").over(w) < 1e-12) | (F.stddev_samp("bench_r1").over(w) < 1e-12)
    return F.when((n == k) & flat, 0.0).when(n == k, F.corr("r1", "bench_r1").over(w))


def beta(k: int = 24) -> Column:
    """0 where the benchmark doesn't vary."""
    return F.when(F.var_samp("bench_r1").over(over(k)) > 1e-20, both(k, F.covar_samp("r1", "bench_r1")) / both(k, F.var_samp("bench_r1"))).when(both(k, F.count("*")) == k, 0.0)


def rsi(k: int = 14) -> Column:
    """Of plain means of gains and losses; without losses 50 if there are no gains either, else 100."""
    gain, loss = whole(F.greatest(F.col("d1"), F.lit(0.0)), k, F.avg), whole(F.greatest(-F.col("d1"), F.lit(0.0)), k, F.avg)
    n = F.count("d1").over(over(k))
    return F.when(n == k, F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, 100.0).otherwise(50.0))


def volume_z(k: int = 20) -> Column:
    sd = whole(F.col("volume"), k, F.stddev_pop)
    return F.when(sd <= 1e-12, 0.0).otherwise((F.col("volume") - whole(F.col("volume"), k, F.avg)) / sd)


def gap() -> Column:
    return F.try_divide(F.col("open"), lag("close")) - 1


def log_gap() -> Column:
    return F.ln(F.try_divide(F.col("open"), lag("close")))


def intraday() -> Column:
    return F.ln(F.try_divide(F.col("close"), F.col("open")))


def open_to_close() -> Column:
    return F.abs(F.col("close") / F.col("open") - 1)


def trailing_median(k: int = 20) -> Column:
    """Median of absolute open-to-close changes."""
    w = over(k)
    return F.when(F.count(open_to_close()).over(w) == k, F.percentile(open_to_close(), F.lit(0.5)).over(w))


def mean_square(k: int = 20) -> Column:
    return whole(intraday() * intraday(), k, F.avg)


def average(k: int) -> Column:
    return whole(F.col("close"), k, F.avg)


def bollinger(k: int = 20, width: float = 2.0) -> tuple[Column, Column, Column]:
    mid, sd = average(k), whole(F.col("close"), k, F.stddev_pop)
    return mid - width * sd, mid, mid + width * sd


def drawdown() -> Column:
    peak = F.max("close").over(order().rowsBetween(Window.unboundedPreceding, 0))
    return F.col("close") / peak - 1


def rebased(base: float = 100.0) -> Column:
    return base * F.col("close") / F.first("close").over(order().rowsBetween(Window.unboundedPreceding, 0))


def sequence_of(columns: list[str], n: int) -> Column:
    """The last n rows' columns as an array of structs, null until there are n."""
    w = over(n)
    return F.when(F.count("*").over(w) == n, F.collect_list(F.struct(*columns)).over(w))


def shifted_forward(c: str, keys: list[str], order: str) -> Column:
    """The next session's value, 0 on the last."""
    return F.lead(c, 1, 0).over(Window.partitionBy(*keys).orderBy(order))


def buckets(score: str, keys: list[str], tie: str, n: int = 5) -> Column:
    """Bucket q holds the sorted rows from q * count / n to before (q + 1) * count / n, fractions cut off."""
    w = Window.partitionBy(*keys)
    at = F.row_number().over(w.orderBy(score, tie)) - 1
    return F.floor(((at + 1) * n - 1) / F.count("*").over(w)).cast("long")


def folded(daily: DataFrame, out: list[str], step, start: tuple, value: str = "close") -> DataFrame:
    """Adds the columns `out` by a recursion along each symbol's dates: step(state, x, index) -> (state, values of out).

    Rows are dealt by symbol and sorted by date, and a task goes through them with one symbol's state in hand, so that
    memory doesn't grow with a history. Values are doubles, or None.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*daily.schema.fields, *(StructField(c, DoubleType()) for c in out)])

    def go(batches):
        import pyarrow as pa

        symbol, state, i = None, start, 0
        for b in batches:
            found = []
            for s, x in zip(b.column("symbol").to_pylist(), b.column(value).to_pylist(), strict=True):
                if s != symbol:
                    symbol, state, i = s, start, 0
                state, values = step(state, x, i)
                found.append(values)
                i += 1
            more = [pa.array(c, pa.float64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.float64()) for _ in out]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *out])

    return daily.repartition("symbol").sortWithinPartitions("symbol", "date").mapInArrow(go, schema)
