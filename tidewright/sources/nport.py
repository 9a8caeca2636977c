"""Quarterly fund reports in tab-separated tables: which sector fund held whom, by name, from when on that was known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import keep_first
from tidewright.sources.readers import issuer_key

# Parts of fund names and their sectors, in the order in which they are tried; what rules a fund out.
SECTORS = (
    ("COMMUNICATION SERVICES SELECT SECTOR SPDR", "XLC"),
    ("CONSUMER DISCRETIONARY SELECT SECTOR SPDR", "XLY"),
    ("CONSUMER STAPLES SELECT SECTOR SPDR", "XLP"),
    ("ENERGY SELECT SECTOR SPDR", "XLE"),
    ("FINANCIAL SELECT SECTOR SPDR", "XLF"),
    ("HEALTH CARE SELECT SECTOR SPDR", "XLV"),
    ("INDUSTRIAL SELECT SECTOR SPDR", "XLI"),
    ("MATERIALS SELECT SECTOR SPDR", "XLB"),
    ("REAL ESTATE SELECT SECTOR SPDR", "XLRE"),
    ("TECHNOLOGY SELECT SECTOR SPDR", "XLK"),
    ("UTILITIES SELECT SECTOR SPDR", "XLU"),
)
EXCLUDED = "PREMIUM INCOME"
OPEN_END = "2099-12-31"
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
#: Places (from 1) of the columns that are read.
FUND = {"accession": 1, "fund": 2}
SUBMISSION = {"accession": 1, "filed": 2, "reported": 6}
HOLDING = {"accession": 1, "issuer": 3, "weight": 13}


def read_tsv(spark: SparkSession, path: str, places: dict[str, int]) -> DataFrame:
    """The columns at the given places of a table without quoting; a line with fewer has empty ones. Header lines are rows."""
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).select(*(F.coalesce(F.get(parts, F.lit(n - 1)), F.lit("")).alias(c) for c, n in places.items()))


def sector_of(fund: Column) -> Column:
    """The sector of the first rule that a fund's name meets, or null."""
    name, found = F.upper(fund), None
    for part, sector in SECTORS:
        found = F.when(name.contains(part), sector) if found is None else found.when(name.contains(part), sector)
    return F.when(~name.contains(EXCLUDED), found)


def written_date(c: Column) -> Column:
    """DD-MON-YYYY as a date; null if it is none."""
    parts = F.split(F.lower(c), "-")
    month = F.floor((F.instr(F.lit(MONTHS), F.substring(F.get(parts, F.lit(1)), 1, 3)) + 2) / 3).cast("int")
    return F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.get(parts, F.lit(0)), 2, "0")).try_cast("date")


def sector_holdings(funds: DataFrame, submissions: DataFrame, holdings: DataFrame, names: DataFrame, quarter: str) -> tuple[DataFrame, DataFrame]:
    """(holdings: sector, symbol, effective_from, available_from, effective_to, weight, source; ledger by sector and accession).

    names: issuer, symbol; issuers are equal if their letters and digits are, and the last of several names counts. Of
    several submissions of an accession the first line counts, told by the least filed and reported texts. Holdings
    without a weight are not read; the ledger counts those whose name is unknown. A fund without both dates is left out.
    """
    chosen = funds.withColumn("sector", sector_of(F.col("fund"))).where("sector is not null").select("accession", "sector").distinct()
    dated = keep_first(submissions, ["accession"], ["filed", "reported"]).where("filed <> '' and reported <> ''")
    chosen = chosen.join(dated, "accession").select("accession", "sector", written_date(F.col("reported")).alias("effective_from"), written_date(F.col("filed")).alias("available_from"))
    held = holdings.where("weight <> ''").join(chosen, "accession")
    ticker = names.select(issuer_key(F.col("issuer")).alias("_k"), "symbol").groupBy("_k").agg(F.max("symbol").alias("symbol"))
    named = held.withColumn("_k", issuer_key(F.col("issuer"))).join(ticker, "_k", "left")
    rows = named.where("symbol is not null").select("sector", "symbol", "effective_from", "available_from", F.lit(OPEN_END).cast("date").alias("effective_to"), "weight", F.lit(f"SEC-NPORT-{quarter}").alias("source"))
    counts = named.groupBy("accession", "sector").agg(F.count("*").alias("total"), F.count_if(F.col("symbol").isNull()).alias("unresolved"))
    ledger = chosen.join(counts, ["accession", "sector"], "left").select("sector", F.lit(quarter).alias("quarter"), "effective_from", "available_from", "accession", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "unresolved")))
    return keep_first(rows, ["sector", "symbol", "effective_from", "available_from", "source"], ["weight"]), ledger
