"""Scalar rules: normalising, validating, identifying, classifying and dating rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Forms that count as filings, as fundamentals and as insider reports.
FILING_FORMS = ["8-K", "8-K/A", "10-K", "10-K/A", "10-Q", "10-Q/A", "6-K", "20-F", "40-F"]
FUNDAMENTAL_FORMS = ["10-K", "10-K/A", "10-Q", "10-Q/A"]
NEW_YORK = "America/New_York"
#: Fixed value: where the live engine's hash of names starts.
LIVE_START = 1469598103934665603


def infinite(c: Column) -> Column:
    return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))


def normalised_symbol(c: Column) -> Column:
    return F.upper(F.trim(c))


def trade_fault() -> Column:
    """Why a trade (symbol, price, volume, ts_ms) is rejected; null if it isn't."""
    return (
        F.when(F.coalesce(normalised_symbol(F.col("symbol")), F.lit("")) == "", "empty symbol")
        .when(infinite(F.col("price")) | (F.col("price") <= 0), "invalid price")
        .when(infinite(F.col("volume")) | (F.col("volume") < 0), "invalid volume")
        .when(F.coalesce(F.col("ts_ms"), F.lit(0)) == 0, "missing timestamp")
    )


def short_number(c: Column) -> Column:
    """A number with at most 15 significant digits and no closing zeros, for identifiers."""
    s = c.cast("string")
    return F.regexp_replace(s, r"\.0$", "")


def trade_id(source: Column) -> Column:
    parts = [source, F.col("symbol"), F.col("ts_ms").cast("string"), short_number(F.col("price")), short_number(F.col("volume")), F.col("seq").cast("string")]
    return F.concat(source, F.lit(":sha256:"), F.sha2(F.concat_ws("|", *parts), 256))


def content_hash(*parts: Column, joint: str = " ") -> Column:
    return F.sha2(F.lower(F.concat_ws(joint, *(F.trim(p) for p in parts))), 256)


def form_class(form: Column) -> Column:
    return (
        F.when(form.startswith("8-K"), "8-K").when(form.startswith("10-Q"), "10-Q").when(form.startswith("10-K"), "10-K")
        .when(form == "4", "form4").when(form.isin("3", "5"), "form3_5").when(form.startswith("SCHEDULE 13") | form.startswith("SC 13"), "schedule13").otherwise("other")
    )


def withdrawn(message_type: Column, status: Column) -> Column:
    return F.concat_ws(" ", message_type, status).rlike("(?i)delete|withdraw|retract|kill|remove")


def pollable(symbol: Column) -> Column:
    return symbol.rlike("^[A-Z]{1,5}$")


def iso_instant(c: Column) -> Column:
    """ISO 8601 with optional fraction and offset; null if it isn't one."""
    fine = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")
    return F.when(fine, F.try_to_timestamp(c))


def plain_instant(c: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS as UTC, also with " UTC" or "Z" behind it."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(c), r"( UTC|Z)$", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


def epoch_date(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def floor_to(c: Column, width: int) -> Column:
    return (F.floor(c / width) * width).cast("long")


def new_york_offset(day: Column) -> Column:
    """Hours that New York is behind UTC at noon: 4 from the second Sunday of March to the first of November, else 5."""
    first = lambda month: F.make_date(F.year(day), F.lit(month), F.lit(1))
    march = F.date_add(F.next_day(F.date_sub(first(3), 1), "Sun"), 7)
    november = F.next_day(F.date_sub(first(11), 1), "Sun")
    return F.when((day >= march) & (day < november), 4).otherwise(5)


def exchange_ms(day: Column, hour: int, minute: int) -> Column:
    """Milliseconds since 1970 of a wall time in New York on a day."""
    days = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 24 + hour + new_york_offset(day)) * 3_600_000 + minute * 60_000


def close_ms(day: Column) -> Column:
    return exchange_ms(day, 16, 0)


def cutoff_ms(day: Column) -> Column:
    return exchange_ms(day, 9, 20)


def minute_of_day(ms: Column) -> Column:
    """In New York."""
    local = F.floor(ms / 60_000) - new_york_offset(epoch_date(F.floor(ms / 1000))) * 60
    return F.pmod(local, F.lit(1440))


def regular_hours(ms: Column) -> Column:
    return minute_of_day(ms).between(570, 960)


def market_open(ms: Column) -> Column:
    local = ms - new_york_offset(epoch_date(F.floor(ms / 1000))) * 3_600_000
    day = epoch_date(F.floor(local / 1000))
    return F.dayofweek(day).between(2, 6) & (minute_of_day(ms) >= 570) & (minute_of_day(ms) < 960)


def clipped_change(now: Column, before: Column) -> Column:
    return F.when(F.abs(before) < 1e-12, 0.0).otherwise(F.greatest(F.least(F.try_divide(now, before) - 1, F.lit(5.0)), F.lit(-5.0)))


def archive_path(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit("edgar/data"), F.regexp_replace(cik, "^0+", ""), F.regexp_replace(accession, "-", ""), document)


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik, 10, "0")


def meaningful(text: Column) -> Column:
    return text.rlike("[A-Za-z0-9]")


def shard(hash_column: Column, n: int) -> Column:
    return F.conv(F.substring(hash_column, 1, 2), 16, 10).cast("long") % n


def prediction_date(now_ms: Column) -> Column:
    """The UTC date six hours ago, rolled back over a weekend."""
    day = epoch_date(F.floor((now_ms - 6 * 3_600_000) / 1000))
    return F.date_sub(day, F.when(F.dayofweek(day) == 7, 1).when(F.dayofweek(day) == 1, 2).otherwise(0))


def safe_name(c: Column) -> Column:
    return F.translate(c, "/\\: ", "____")


def compact(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def entity_kind(c: Column) -> Column:
    return F.when(c.startswith("XLK") | (F.length(c) <= 5), "etf").when(c.startswith("macro:"), "macro").when(c.startswith("sector:"), "sector").otherwise("company")


def entity_name(c: Column) -> Column:
    kind = entity_kind(c)
    return F.when(kind.isin("macro", "sector"), F.regexp_replace(c, "^(macro|sector):", "")).otherwise(c)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def schema_hash(names: list[str]) -> int:
    """FNV-1a of 64 bits over the names, each with a line feed behind it."""
    h = 0xCBF29CE484222325
    for b in "".join(n + "\n" for n in names).encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return h


def fnv_hashes(texts: list[bytes], start: int) -> np.ndarray:
    """FNV-1a of 64 bits of each text, all of them a byte at a time; longer texts go on alone."""
    sizes = np.array([len(x) for x in texts], np.int64)
    flat, order = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64), np.argsort(-sizes, kind="stable")
    begins, h = (np.cumsum(sizes) - sizes)[order], np.full(len(texts), start, np.uint64)
    longest = sizes[order]
    for k in range(int(longest[0]) if len(texts) else 0):
        n = int(np.searchsorted(-longest, -k, "left"))  # so many are longer than k
        h[:n] = (h[:n] ^ flat[begins[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv_hash(text: Column, start: int = 0xCBF29CE484222325) -> Column:
    """FNV-1a of 64 bits over a text's bytes, in 16 hexadecimal digits; null for null. `start` is its starting value."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        found = fnv_hashes([x.encode() for x in s.dropna()], start)
        return pd.Series([f"{h:016x}" for h in found.tolist()], s.dropna().index, dtype=object).reindex(s.index).astype(object).where(s.notna(), None)

    return run(text)


def names_hash(names: Column) -> Column:
    """The live engine's hash of a schema: over its names, each with a bar behind it, from that engine's own starting value."""
    return fnv_hash(F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("|"))), ""), LIVE_START)


def faults_of(df: DataFrame, needed: list[str], finite: list[str]) -> DataFrame:
    """One row: rows, rows with a number that isn't finite, and the largest absolute number; missing columns raise."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    bad = F.lit(False)
    for c in finite:
        bad = bad | infinite(F.col(c))
    return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("not_finite"), F.max(F.greatest(*(F.abs(c) for c in finite), F.lit(0.0))).alias("largest"))
