"""What several operators share: whole texts, shared tables, global order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.operators.storage import materialise

# The characters that separate words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# monotonically_increasing_id() has the partition above this bit, the row below.
_ROW_BITS = 33


def whole(text: str | Column) -> Column:
    """The text; the empty string where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positions(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add `position`, gapless from 0 in the given order.

    Rows are range-partitioned, sorted and numbered where they lie; only the
    sizes of the partitions meet in one task. `rows` is read twice (Spark
    samples it for the ranges), so let it be a stored or cheap table. Rows that
    tie in all of `order` share a partition: give it a column that tells apart
    the rows of any large group.
    """
    laid = (
        rows.repartitionByRange(parallelism(rows.sparkSession), *order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    laid = materialise(laid, name)
    part = F.shiftright("_at", _ROW_BITS)
    sizes = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    # One row for each partition: a bounded table.
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    return (
        laid.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(
            "position",
            F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        )
        .drop("_at", "_part", "_start")
    )
