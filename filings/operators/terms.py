"""Word counts and term weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.functions.text import term_counts, words
from filings.operators.skew import join_counts
from filings.operators.storage import materialise

MIN_DOC_FREQ = 5


def word_count(lines: DataFrame, text: str = "value") -> DataFrame:
    """How often each word between white space occurs."""
    return (
        lines.select(F.explode(words(F.col(text))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def preview(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent words, ties in word order."""
    return counts.orderBy(F.desc("n"), "word").limit(n)


def doc_frequency(documents: DataFrame, terms: Column) -> DataFrame:
    """In how many documents each term is."""
    return (
        documents.select(F.explode(F.array_distinct(terms)).alias("term"))
        .filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count("*").alias("df"))
    )


def tfidf_terms(
    documents: DataFrame,
    doc_id: str,
    terms: Column,
    min_doc_freq: int = MIN_DOC_FREQ,
) -> DataFrame:
    """Weight of each term in each document: tf * ln((N + 1) / (df + 1)).

    Terms in fewer than `min_doc_freq` documents weigh 0. Term frequencies come
    from the document's own row; only one row per document and term moves.
    These rows are stored, as they are counted and then joined.
    """
    rows = materialise(
        documents.select(doc_id, F.inline(term_counts(terms)).alias("term", "tf")), "tf"
    )
    frequencies = rows.groupBy("term").agg(F.count("*").alias("df"))
    total = documents.agg(F.count("*")).scalar()
    idf = F.when(
        F.col("df") >= min_doc_freq, F.log((total + F.lit(1)) / (F.col("df") + 1))
    ).otherwise(F.lit(0.0))
    return join_counts(rows, frequencies, "term", "df", doc_id).select(
        doc_id, "term", "tf", "df", (F.col("tf") * idf).alias("weight")
    )
