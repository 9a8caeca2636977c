"""The corpus pipeline: stages over documents, each by one operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run writes it as Parquet and reads it again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm.common import written

#: A language is rejected as unknown (a null text, or no letter) or where no language reaches this probability.
LEAST_SCORE = 0.35
#: SQL can't express the classifier, so the stages are tested against brute force.
ORACLE_SQL = None


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents whose language can't be told go."""
    from tidewright.llm.langid import keep_identified, train

    return keep_identified(docs, train(docs), LEAST_SCORE)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal texts, the row with the largest doc_id stays."""
    from tidewright.llm.exact_dedup import kept_rows

    return kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of documents joined by links of 0.8 or more, the one with the least doc_id stays."""
    from tidewright.llm.jaccard_join import first_of_each_class

    return first_of_each_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents are repeated, or left out, as the mix of sources takes them."""
    from tidewright.llm.mixing import mixed_rows

    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: what is left is cut and packed into sequences; a repeated document's pieces are repeated."""
    import public_tokenizers

    from tidewright.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", keep_language), ("exact dedup", drop_copies), ("near copies", drop_near_copies), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
