"""Hard negatives by Kronecker-packed products.

Of every component, the values of all candidates of a block and label stand in
the fields of one wide integer, each raised by a bias so that it is not negative.
The component of an anchor, raised likewise, multiplies that integer once; the
sum over the components holds the products with all candidates, field by field.
Fields are as wide as the largest sum needs, so nothing carries into the next,
and taking the biases out of a field leaves the exact inner product.

An anchor's positives are its first rows of the same label, by falling score and
then by id. Its negatives for a positive are the first rows of other labels whose
score is within a share of the positive's. Both are found in pairs of blocks of
anchors and candidates, and the best of each block are merged; the first pass
multiplies within labels, the second across them, so that each pair of rows is
multiplied once. Blocks are cut by row number, so no label makes one large.

Rows with a null id or label, a null vector, or a null or non-finite component
take no part, nor do vectors that pass the range of a double once scaled.
Shorter vectors count as padded with zeros; an empty one scores zero. Repeated
rows each count as candidates; an anchor that is repeated is answered once.
Another row is one with another id. A score of the result that does not fit a
long is an error. No anchors, no positives or no negatives: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filings.llm.common import parallelism
from filings.llm.topk import scaled
from filings.operators.storage import materialise

POSITIVES = 5
NEGATIVES = 3
# A negative has 50 to 95 hundredths of the positive's score.
LOWEST, HIGHEST = 50, 95
# Most rows in a block.
CANDIDATES = 8192
ANCHORS = 1024
LONG = 1 << 63


def usable_rows(rows: DataFrame, id_column: str, label: Column, embedding: str) -> DataFrame:
    """`id`, `label` and `vector` (whole doubles) of the rows that take part."""
    kept = rows.select(
        F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"), scaled(embedding).alias("vector")
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return kept.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))


def whole_numbers(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows of exact integers, padded with zeros."""
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    if np.abs(out).max(initial=0) < 1 << 53:
        return out.astype(np.int64)
    return np.array([[int(x) for x in row] for row in out], dtype=object)


class Packed:
    """Candidates, packed for anchors whose components are at most `reach`."""

    def __init__(self, vectors: np.ndarray, reach: int):
        self.n, self.width = vectors.shape
        self.lift, self.reach = int(np.abs(vectors).max(initial=0)), reach
        # A raised component is at most twice the largest one.
        most = max(1, self.width * 4 * self.lift * reach)
        self.octets = 1 << max(0, math.ceil(math.log2(math.ceil(most.bit_length() / 8))))
        self.sums = vectors.astype(np.int64 if self.octets <= 8 else object).sum(axis=1)
        self.wide = [self._fields(vectors[:, at] + self.lift) for at in range(self.width)]

    def _fields(self, values: np.ndarray) -> int:
        """One integer with a field for each value, the first in the lowest place."""
        if self.octets <= 8:
            return int.from_bytes(values.astype(f"<u{self.octets}").tobytes(), "little")
        return int.from_bytes(b"".join(int(x).to_bytes(self.octets, "little") for x in values), "little")

    def products(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products with all candidates: one multiplication a component."""
        total = 0
        for raised, wide in zip((int(x) + self.reach for x in anchor), self.wide, strict=True):
            total += raised * wide
        octets = total.to_bytes(self.n * self.octets, "little")
        same = self.lift * sum(int(x) for x in anchor) + self.width * self.lift * self.reach
        if self.octets <= 8:
            # Below 2^63 without its bias, a field of 64 bits may wrap on the way.
            found = np.frombuffer(octets, dtype=f"<u{self.octets}").astype(np.uint64).view(np.int64)
            with np.errstate(over="ignore"):
                return found - same - self.reach * self.sums
        fields = (octets[at : at + self.octets] for at in range(0, len(octets), self.octets))
        found = np.array([int.from_bytes(field, "little") for field in fields], dtype=object)
        return found - same - self.reach * self.sums


class Block:
    """Candidates of one block by label, in the order of their ids."""

    def __init__(self, rows: pd.DataFrame, width: int, reach: int):
        rows = rows.sort_values("id", kind="stable")
        labels, vectors = rows["label"].to_numpy(), whole_numbers(rows["vector"], width)
        self.packs = {}
        for label in np.unique(labels):
            own = labels == label
            self.packs[int(label)] = (rows["id"].to_numpy()[own], Packed(vectors[own], reach))

    def scores(self, anchor: np.ndarray, labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the candidates of these labels."""
        found = [(ids, pack.products(anchor)) for ids, pack in (self.packs[label] for label in labels)]
        if not found:
            return np.arange(0), np.arange(0)
        return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def first_rows(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to the smaller id."""
    if len(scores) > k and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    ranked = sorted(near, key=lambda row: (-int(scores[row]), ids[row]))
    return np.array(ranked[:k], dtype=int)


def window(positive: int) -> tuple[int, int]:
    """Least and greatest score of a negative."""
    return -(-LOWEST * positive // 100), HIGHEST * positive // 100


def _fits(score: int) -> int:
    if not -LONG <= score < LONG:
        raise ArithmeticError(f"the score {score} does not fit a long")
    return score


def positives_of_block(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple]:
    """(anchor, anchor_id, id, score): the best rows of each anchor's label."""
    out, (block, vectors) = [], _blocks(anchors, rows)
    for at, (anchor, own, label) in enumerate(zip(anchors["anchor"], anchors["id"], anchors["label"], strict=True)):
        ids, scores = block.scores(vectors[at], [label] if label in block.packs else [])
        other = ids != own
        ids, scores = ids[other], scores[other]
        out += [(anchor, own, ids[row], _fits(int(scores[row]))) for row in first_rows(ids, scores, k)]
    return out


def negatives_of_block(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> list[tuple]:
    """(anchor, place, id, score): the best rows of other labels for each positive."""
    out, (block, vectors) = [], _blocks(anchors, rows)
    columns = (anchors[name] for name in ("anchor", "label", "scores"))
    for at, (anchor, label, positives) in enumerate(zip(*columns, strict=True)):
        ids, scores = block.scores(vectors[at], [other for other in block.packs if other != label])
        for place, positive in enumerate(positives):
            low, high = window(int(positive))
            fit = np.flatnonzero((scores >= low) & (scores <= high)) if low <= high else np.arange(0)
            best = fit[first_rows(ids[fit], scores[fit], k)]
            out += [(anchor, place, ids[row], int(scores[row])) for row in best]
    return out


def _blocks(anchors: pd.DataFrame, rows: pd.DataFrame) -> tuple[Block, np.ndarray]:
    width = int(max(anchors["vector"].map(len).max(), rows["vector"].map(len).max()))
    vectors = whole_numbers(anchors["vector"], width)
    return Block(rows, width, int(np.abs(vectors).max(initial=0))), vectors


def _met(anchors: DataFrame, rows: DataFrame, best, kind: str) -> DataFrame:
    """`best(anchors, rows)` of every pair of a block of anchors and one of rows."""
    spark = rows.sparkSession
    a_blocks = max(1, math.ceil(anchors.count() / ANCHORS))
    r_blocks = max(parallelism(spark), math.ceil(rows.count() / CANDIDATES))
    # Rows are numbered where they are read, so that a repeated task gives the same.
    number = F.pmod(F.monotonically_increasing_id(), F.lit(r_blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Aliases, as both sides may come from one table.
    left = anchors.select(*[F.col(name).alias(name) for name in anchors.columns])
    left = left.withColumn("a_block", F.pmod("anchor", F.lit(a_blocks)).cast("int"))
    left = left.withColumn("r_block", every(r_blocks)).groupBy("a_block", "r_block")
    right = rows.withColumn("r_block", number)
    right = right.withColumn("a_block", every(a_blocks)).groupBy("a_block", "r_block")
    names = [part.split()[0] for part in kind.split(", ")]

    def meet(ours: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found = [] if ours.empty or theirs.empty else best(ours, theirs)
        columns = zip(*found, strict=True) if found else [[]] * len(names)
        return pd.DataFrame({name: np.array(c, dtype=np.int64) for name, c in zip(names, columns, strict=True)})

    return left.cogroup(right).applyInPandas(meet, kind)


def _ranked(found: DataFrame, k: int, *group: str) -> DataFrame:
    """`rank` from 1 within the group, for its first k rows."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    anchors: DataFrame, rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Both inputs have `id`, `label` and `vector`, as `usable_rows` makes them.
    """
    anchors = anchors.dropDuplicates(["id", "label", "vector"])
    anchors = anchors.withColumn("anchor", F.xxhash64("id", "label", "vector"))
    found = _met(
        anchors, rows, lambda a, r: positives_of_block(a, r, positives), "anchor long, anchor_id long, id long, score long"
    )
    # Used twice: for the bounds of negatives, and in the result.
    near = materialise(_ranked(found, positives, "anchor"), "positives")
    order = F.sort_array(F.collect_list(F.struct("rank", "score")))
    bounds = near.groupBy("anchor").agg(F.transform(order, lambda x: x["score"]).alias("scores"))
    bounded = anchors.join(bounds, "anchor")
    found = _met(
        bounded, rows, lambda a, r: negatives_of_block(a, r, negatives), "anchor long, place long, id long, score long"
    )
    best = _ranked(found, negatives, "anchor", "place")
    near = near.select(
        "anchor", "anchor_id", (F.col("rank") - 1).cast("long").alias("place"),
        F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return near.join(best, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
