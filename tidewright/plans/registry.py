"""Every registered query of the market-signal operators, and its DuckDB twin where SQL can express it.

Queries return doubles rounded to six places and dates as text, so that both sides can be compared by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    def one(c: str, kind: str):
        if kind in ("double", "float"):
            return (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c)
        return F.col(c).cast("string").alias(c) if kind == "date" else F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c)

    return df.select(*(one(c, kind) for c, kind in df.dtypes))


def add(name: str, query: Callable, twin: str | None = None, doubles: str = "", dates: str = "", longs: str = "") -> None:
    QUERIES[name] = lambda spark, d: plain(query(spark, d))
    if twin is not None:
        changed = [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles.split()] + [f"CAST({c} AS VARCHAR) AS {c}" for c in dates.split()] + [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
        SQL[name] = f"SELECT * REPLACE ({', '.join(changed)}) FROM ({twin})" if changed else twin


def fill() -> None:
    from tidewright.plans import queries_articles, queries_bars, queries_imports, queries_io, queries_joins, queries_models, queries_news, queries_panels, queries_reports, queries_rolling, queries_rules, queries_sets, queries_sources

    for m in (queries_bars, queries_rolling, queries_joins, queries_news, queries_models, queries_panels, queries_sets, queries_io, queries_articles, queries_reports, queries_sources, queries_imports, queries_rules):
        m.fill(add)


fill()
