"""A dictionary of terms without collisions: gapless ids by falling frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filings.functions.text import term_counts
from filings.operators.skew import join_counts
from filings.operators.storage import materialise

# monotonically_increasing_id() has the partition above this bit, the row below.
_ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """Add `name`, gapless from 0 in the order given.

    Rows are range-partitioned, sorted and stored; what follows are counts of
    partitions, one row for each, and their sums before it. No row is collected
    and no task holds more than a range.
    """
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    laid = materialise(laid.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    start = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = F.broadcast(sizes.select("_part", start.alias("_start")))
    within = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    placed = laid.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn(name, F.col("_start") + within).drop("_at", "_part", "_start")


def term_rows(documents: DataFrame, doc_id: str, terms: Column) -> DataFrame:
    """A stored row (doc_id, term, tf) for each term of each document."""
    rows = documents.select(doc_id, F.inline(term_counts(terms)).alias("term", "tf"))
    return materialise(rows, "term-rows")


def term_ids(rows: DataFrame, min_doc_freq: int = 1) -> DataFrame:
    """term, df and term_id: 0 for the term of most documents, ties in term order.

    `rows` has one row for each term of a document.
    """
    counts = rows.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_doc_freq)
    return numbered(counts, F.desc("df"), F.col("term"), name="term_id")


def id_vectors(rows: DataFrame, ids: DataFrame, doc_id: str) -> DataFrame:
    """doc_id and its vector by term ids: `ids`, rising, and `counts`.

    Terms without an id are left out, and documents without a term that has one.
    A term in most documents has its id from a broadcast (`join_counts`).
    """
    found = join_counts(rows, ids, "term", "df", doc_id, "term_id").filter("term_id IS NOT NULL")
    entry = F.struct(F.col("term_id").alias("id"), "tf")
    vectors = found.groupBy(doc_id).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return vectors.select(
        doc_id,
        F.transform("entries", lambda e: e["id"]).alias("ids"),
        F.transform("entries", lambda e: e["tf"]).alias("counts"),
    )
