"""Bloom filters as small tables, for rows that should leave before a shuffle.

A filter is cut into blocks of 256 bits; a key sets two bits in each of the four
words of its block. The table of blocks is broadcast, so it is made only up to a
number of blocks; `possible` then lets all rows pass, and the exact join that
follows does the work alone. A filter never loses a row: it only lets some pass
that have no partner.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.operators.storage import materialise

WORDS = 4
# About one in a thousand of other keys passes.
BITS_PER_KEY = 16
# Most blocks of a filter that is sent to every executor: 20 MB of bits and keys.
BROADCAST_BLOCKS = 500_000


def _masks(key: Column) -> list[Column]:
    """The bits of a key in each word of its block."""
    bits, one = F.xxhash64(key, F.lit("bits")), F.lit(1).cast("long")
    place = lambda at: F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(63)).cast("int")
    shifted = lambda at: F.call_function("shiftleft", one, place(at))
    return [shifted(12 * word).bitwiseOR(shifted(12 * word + 6)) for word in range(WORDS)]


def blocks_for(keys: int) -> int:
    return max(1, math.ceil(keys * BITS_PER_KEY / (64 * WORDS)))


def filter_table(members: DataFrame, key: str, blocks: int) -> DataFrame:
    """`block` and `w0` to `w3` of the blocks that hold a bit."""
    masks = [mask.alias(f"m{i}") for i, mask in enumerate(_masks(F.col(key)))]
    return (
        members.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *masks)
        .groupBy("block")
        .agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])
    )


class Filter:
    """A stored filter of the distinct keys of `members`; None where it is too large."""

    def __init__(self, members: DataFrame, key: str, most: int = BROADCAST_BLOCKS):
        keys = members.select(key).distinct()
        self.key, self.blocks = key, blocks_for(keys.count())
        self.table = None
        if self.blocks <= most:
            self.table = materialise(filter_table(keys, key, self.blocks), "bloom")

    def possible(self, rows: DataFrame) -> DataFrame:
        """Rows whose key may be one of the members."""
        return self._joined(rows, "left_semi") if self.table is not None else rows

    def impossible(self, rows: DataFrame) -> DataFrame:
        """The other rows: none if there is no filter."""
        return self._joined(rows, "left_anti") if self.table is not None else rows.filter(F.lit(False))

    def _joined(self, rows: DataFrame, how: str) -> DataFrame:
        block = F.pmod(F.xxhash64(rows[self.key]), F.lit(self.blocks))
        table, fits = F.broadcast(self.table), block == self.table["block"]
        for i, mask in enumerate(_masks(rows[self.key])):
            fits = fits & (self.table[f"w{i}"].bitwiseAND(mask) == mask)
        return rows.join(table, fits, how)


def possible(rows: DataFrame, members: DataFrame, key: str, most: int = BROADCAST_BLOCKS) -> DataFrame:
    """Rows whose `key` may be among those of `members` (a stored or cheap table)."""
    return Filter(members, key, most).possible(rows)
