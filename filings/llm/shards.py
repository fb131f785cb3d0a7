"""Shards cut from a Hilbert curve through the metadata of documents.

Source, language, size and id are each quantised to a few bits. Documents are
sorted by their index on the curve through these cells, then by doc_id, and cut
into runs, so that the range of every dimension within a shard, or within a
file of it, is short and readers can skip files.

Laws: `rows` cuts runs whose counts are at most one apart; `bytes` cuts where
the running size passes equal shares. A null text has no bytes and CRC 0; null
metadata fall into the first cell of their dimension. Repeated rows keep a slot
each. With fewer documents than shards some shards are empty; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from filings.llm.common import parallelism, positions, whole
from filings.operators.storage import materialise

SHARDS = 24
ROW_BYTES = 8
# Cells of a dimension: 2 ** BITS. A dimension's bounds are that many values.
BITS = 6


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of `cells` (n x dimensions) on the Hilbert curve.

    Cells are turned into the transposed index by undoing the curve's exchanges
    and inversions from the coarsest bit down, and then Gray-decoded.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            inverted = (x[i] & bit) > 0
            moved = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inverted, low, moved)
            if i:
                x[i] ^= moved
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turned
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> level) & 1)
    return index


def number_bounds(rows: DataFrame, column: str, cells: int) -> list[float]:
    """Upper bounds of all cells but the last, by approximate quantiles."""
    shares = [i / cells for i in range(1, cells)]
    found = rows.agg(F.percentile_approx(column, shares, 10_000).alias("bounds")).head()
    return sorted(set(found.bounds or []))


def string_bounds(rows: DataFrame, column: str, cells: int) -> list[str]:
    """First values of all cells but the first, by rank among distinct values."""
    values = rows.filter(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    ranked = positions(materialise(values, "values"), [F.col("value")], "value-ranks")
    last = ranked.agg(F.max("position").alias("last")).head().last
    if last is None:
        return []
    cell = F.floor(F.col("position") * F.lit(cells) / F.lit(last + 1))
    firsts = ranked.groupBy(cell.alias("cell")).agg(F.min("value").alias("first"))
    return sorted(row.first for row in firsts.filter("cell > 0").select("first").collect())


def curve_index(dims: Sequence[tuple[str, list, str]], bits: int = BITS) -> Column:
    """Column of the Hilbert index of (column, bounds, side) dimensions."""

    @F.pandas_udf(LongType())
    def index(parts: pd.DataFrame) -> pd.Series:
        cells = np.zeros((len(parts), len(dims)), dtype=np.int64)
        for i, (_, bounds, side) in enumerate(dims):
            values = parts.iloc[:, i]
            known = values.notna().to_numpy()
            cells[known, i] = np.searchsorted(
                np.array(bounds, dtype=object if side == "right" else float),
                values[known].to_numpy(dtype=object if side == "right" else float),
                side=side,
            )
        return pd.Series(hilbert_index(cells, bits))

    return index(F.struct(*[F.col(name) for name, _, _ in dims]))


def described(docs: DataFrame) -> DataFrame:
    """The metadata of documents; the only pass over their texts."""
    text = whole("text")
    return docs.select(
        "doc_id",
        "source",
        "lang",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def with_shards(docs: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """Metadata, curve index, `shard` and `slot` of every document."""
    rows = materialise(described(docs), "shard-rows")
    cells = 1 << BITS
    dims = [
        ("source", string_bounds(rows, "source", cells), "right"),
        ("lang", string_bounds(rows, "lang", cells), "right"),
        ("size", number_bounds(rows, "size", cells), "left"),
        ("doc_id", number_bounds(rows, "doc_id", cells), "left"),
    ]
    indexed = materialise(rows.withColumn("curve", curve_index(dims)), "shard-curve")
    order = [F.col("curve"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    placed = materialise(positions(indexed, order, "shard-order"), "shard-places")
    if law == "rows":
        total = placed.count()
        # Integer arithmetic: position * shards / total, rounded down.
        shard = F.floor(F.expr(f"position * {shards}L div {max(total, 1)}L"))
        first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
        return placed.withColumn("shard", shard.cast("int")).withColumn("slot", F.col("position") - first)
    if law != "bytes":
        raise ValueError(f"unknown law: {law}")
    return _by_bytes(placed, shards)


def _by_bytes(placed: DataFrame, shards: int) -> DataFrame:
    """Cut where the middle of a document passes an equal share of all bytes."""
    from pyspark.sql import Window

    blocks = parallelism(placed.sparkSession)
    total = placed.agg(F.count("*").alias("n"), F.sum("size").alias("size")).head()
    block = F.expr(f"position * {blocks}L div {max(total.n, 1)}L")
    rows = placed.withColumn("_block", block)
    sums = rows.groupBy("_block").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")
    starts = F.broadcast(sums.select("_block", before.alias("_before")))
    inside = F.sum("size").over(
        Window.partitionBy("_block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    )
    cut = rows.withColumn("_inside", inside).join(starts, "_block")
    middle = F.col("_before") + F.col("_inside") - F.col("size") / 2
    cut = cut.withColumn("shard", F.floor(middle * shards / F.lit(total.size or 1)).cast("int"))
    firsts = F.broadcast(cut.groupBy("shard").agg(F.min("position").alias("_first")))
    return cut.join(firsts, "shard").withColumn("slot", F.col("position") - F.col("_first")).drop(
        "_block", "_before", "_inside", "_first"
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Documents in folders by shard; files hold short runs of the curve.

    `placed` is joined by (doc_id, CRC): repeats of a document go along.
    """
    key = F.struct("doc_id", "text_crc32").alias("_key")
    place = placed.select(key, F.struct("shard", "slot").alias("_place")).dropDuplicates(["_key"])
    row = F.struct(*docs.columns).alias("_row")
    own = F.struct("doc_id", F.crc32(whole("text")).alias("text_crc32")).alias("_key")
    rows = docs.select(row, own).join(place, "_key").select("_row", "_place", "_place.shard")
    files = parallelism(docs.sparkSession)
    laid = rows.repartitionByRange(files, "_place").sortWithinPartitions("_place")
    laid.select("_row.*", "shard").write.partitionBy("shard").parquet(path)
