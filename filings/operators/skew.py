"""Joins of rows with a per-key table when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hottest(counts: DataFrame, n: str, total: Column | None = None) -> DataFrame:
    """Keys that hold more rows than an average shuffle partition.

    There are fewer of them than partitions, however many keys there are, so
    they can be broadcast; and no other key fills more than one partition.
    `counts` has one row per key; `total` is the number of all rows, where
    `counts` does not have all keys.
    """
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if total is None:
        total = counts.agg(F.sum(n)).scalar()
    return counts.filter(F.col(n) * F.lit(partitions) > total)


def drop_hot(rows: DataFrame, hot: DataFrame, key: str) -> DataFrame:
    """Rows whose key is none of the hot keys."""
    return rows.join(F.broadcast(hot.select(key)), key, "left_anti")


def join_counts(
    rows: DataFrame, counts: DataFrame, key: str, n: str, spread_by: str, value: str | None = None
) -> DataFrame:
    """Add `n`, or another `value`, of `counts` (one row per key) to every row of that key.

    Rows of the most frequent keys take it from a broadcast of fewer rows than
    there are partitions. In the shuffle join they then have no key and are spread by
    `spread_by`; only the other keys meet `counts` there. Key and spread are
    one struct: as two conditions, the constant side of the second would be
    optimized away, and all rows without a key would go to one task.
    """
    value = value or n
    hot = hottest(counts, n).select(F.col(key), F.col(value).alias("_hot"))
    is_hot = F.col("_hot").isNotNull()
    spread = F.when(is_hot, F.xxhash64(spread_by)).otherwise(F.lit(0).cast("long"))
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "_place",
        F.struct(F.when(~is_hot, F.col(key)).alias("key"), spread.alias("spread")),
    )
    cold = counts.select(
        F.struct(F.col(key).alias("key"), F.lit(0).cast("long").alias("spread")).alias(
            "_place"
        ),
        F.col(value).alias("_cold"),
    )
    return (
        marked.join(cold, "_place", "left")
        .withColumn(value, F.coalesce("_hot", "_cold"))
        .drop("_place", "_hot", "_cold")
    )
