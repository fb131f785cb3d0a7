"""Phrases that recur across submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filings.functions.text import alpha_tokens, block_ngrams, join_words
from filings.operators.bloom import Filter
from filings.operators.computed import computed
from filings.operators.skew import drop_hot, hottest
from filings.operators.storage import materialise

# Words in a phrase and the range of counts that is of interest.
PHRASE_WORDS = 15
BAND = (15, 199)


def with_phrases(documents: DataFrame, n: int = PHRASE_WORDS) -> DataFrame:
    """Adds `phrases`: distinct blocks of n letter-only words of the fragments."""
    tokens = alpha_tokens(join_words(F.col("fragments")))
    return computed(documents, phrases=block_ngrams(tokens, n))


def phrase_postings(documents: DataFrame, irmark: str = "irmark", *ids: str) -> DataFrame:
    """One row (phrase, irmark) per document and phrase in it, with other columns."""
    # Stated here, so that counting and joining read the same plan.
    return documents.select(
        F.explode("phrases").alias("phrase"), F.col(irmark).alias("irmark"), *ids
    ).filter(F.col("phrase").isNotNull())


def phrase_counts(postings: DataFrame) -> DataFrame:
    """In how many documents each phrase is."""
    return postings.groupBy("phrase").agg(F.count("*").alias("n"))


def phrase_band(postings: DataFrame, low: int = BAND[0], high: int = BAND[1]) -> DataFrame:
    """Phrases in `low` to `high` documents, with their submissions and count.

    Counting comes first, with partial counts before the shuffle, and the
    phrases within the band are stored. Of the postings only those that a filter
    made of these lets pass are shuffled again: most phrases are in one document,
    and neither they nor the ones above the band meet the join. Lists are
    collected within the band alone, so none is longer than `high`.
    """
    counts = phrase_counts(postings)
    in_band = materialise(counts.filter(F.col("n").between(low, high)), "in-band")
    bloom = Filter(in_band, "phrase")
    if bloom.table is None:
        # Too many phrases for a filter: the most frequent ones above the band leave.
        total = counts.agg(F.sum("n")).scalar()
        too_many = hottest(counts.filter(F.col("n") > high), "n", total)
        reduced = drop_hot(postings, too_many, "phrase")
    else:
        reduced = bloom.possible(postings)
    return (
        reduced.join(in_band, "phrase")
        .groupBy("phrase")
        .agg(
            F.sort_array(F.collect_list("irmark")).alias("irmarks"),
            F.first("n").alias("n"),
        )
    )


def phrase_count_histogram(phrases: DataFrame) -> DataFrame:
    """How many phrases have each count."""
    return phrases.groupBy("n").agg(F.count("*").alias("phrases"))


def phrase_with_count(phrases: DataFrame) -> DataFrame:
    return phrases.select("phrase", "n")


def phrase_with_irmark(phrases: DataFrame) -> DataFrame:
    return phrases.select("phrase", F.explode("irmarks").alias("irmark"))
