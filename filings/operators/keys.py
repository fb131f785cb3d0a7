"""Restriction of a dataset to listed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A list of up to this many keys is sent to every executor.
BROADCAST_KEYS = 1_000_000


def restrict_to_keys(
    rows: DataFrame, keys: DataFrame, column: str, broadcast_keys: int = BROADCAST_KEYS
) -> DataFrame:
    """Rows whose `column` is among the keys (first column of `keys`).

    The list is counted first, up to the bound: within it, it is broadcast and
    the rows stay where they are; beyond it, Spark picks the join.
    """
    listed = keys.select(F.col(keys.columns[0]).alias(column)).distinct()
    if listed.limit(broadcast_keys + 1).count() <= broadcast_keys:
        listed = F.broadcast(listed)
    return rows.join(listed, column, "left_semi")
