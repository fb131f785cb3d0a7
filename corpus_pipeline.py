"""Cleaning, deduplication, redaction, mixing and encoding of documents.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of
their input. Null and empty texts, repeated rows and empty tables have in each
stage the result that its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.mixing import mixed
from filings.llm.pieces import encoded
from filings.llm.pii import redacted
from filings.llm.quality import keep_good
from filings.llm.simhash import one_of_each
from filings.operators.storage import materialise

# SQL can express neither the classifier nor the sampled encodings.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near-copies."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars is that of the new text.

    A null text stays null, with its n_chars.
    """
    clean = docs.withColumn("text", redacted(docs["text"]))
    length = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return clean.withColumn("n_chars", length)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece sequences of every document."""
    return encoded(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is stored and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    _, last = STAGES[-1]
    return last(spark, docs, sf_dir)
