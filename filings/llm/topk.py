"""Exact top-k inner products, pruned by statistics of vector segments.

Vectors are scaled to whole numbers. Every vector is described by the mean and
the deviation of its segments, at 1, 4 and 16 segments. From these follow lower
bounds of the squared distance of two vectors, and with the exact norms upper
bounds of their inner product: (|q|^2 + |v|^2 - bound) / 2. A query first takes
exact scores of the candidates with the highest coarse bounds; its k-th best
score so far then discards candidates, level by level, and the exact product is
computed for those that survive.

Queries and candidates are dealt to blocks; each pair of blocks is one group
that a task compares, and the best k of each block are merged at the end. Blocks
are cut by row number, so that no key makes one of them large.

Vectors that are null or that hold a null or non-finite component take no part,
nor do rows whose id is null, nor vectors that pass the range of a double once
scaled. Products that may pass 2^62 are computed in Python's integers; a score
of the best of a block that does not fit a long is an error. Shorter vectors count as padded with zeros; an
empty one scores zero. A candidate is any row with another id than the query;
repeated rows each count. A query id that occurs with several vectors is
answered once for each. No queries or no candidates: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filings.llm.common import parallelism

SCALE = 256
K = 5
SEGMENTS = (1, 4, 16)
# Most rows in a block.
CANDIDATES = 8192
QUERIES = 1024
# Queries whose bounds a task holds at a time.
SLICE = 64
# Components beyond this have no bounds; products up to EXACT are computed in longs.
LARGEST = 1e140
EXACT = 1 << 62
LONG = 1 << 63


def scaled(embedding: str) -> Column:
    """floor(SCALE * x) of every component, x as double, as whole doubles.

    floor() gives a long; a double of 2^53 or more is whole as it is.
    """

    def floored(x: Column) -> Column:
        x = x.cast("double") * SCALE
        return F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x)

    return F.transform(embedding, floored)


def usable_vectors(rows: DataFrame, id_column: str, embedding: str) -> DataFrame:
    """`id` and `vector` of the rows that take part."""
    kept = rows.select(F.col(id_column).cast("long").alias("id"), scaled(embedding).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return kept.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)))


class Described:
    """Vectors with exact norms and the statistics of their segments."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.parts = []
        if np.abs(vectors).max(initial=0) > LARGEST:
            # Squares may pass the range of a double: no bounds.
            return
        self.norm = (vectors * vectors).sum(axis=1, dtype=np.float64)
        for segments in SEGMENTS:
            cuts = np.linspace(0, vectors.shape[1], segments + 1).astype(int)
            cuts = cuts[np.r_[True, np.diff(cuts) > 0]]
            if len(cuts) < 2:
                break
            size = np.diff(cuts).astype(np.float64)
            mean = np.add.reduceat(vectors, cuts[:-1], axis=1) / size
            square = np.add.reduceat(vectors * vectors, cuts[:-1], axis=1) / size
            deviation = np.sqrt(np.maximum(square - mean * mean, 0))
            # Scaled by the root of the size, distances are plain sums of squares.
            self.parts.append(np.hstack([mean, deviation]) * np.sqrt(np.hstack([size, size])))


def _padded(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, vector in zip(out, vectors, strict=True):
        row[: len(vector)] = vector
    return out


def best_of_block(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of the best k candidates of each query.

    Ties go to the smaller id.
    """
    # Candidates by id: among equal scores the first row is then the best.
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    q, v = Described(queries), Described(vectors)
    levels = min(len(q.parts), len(v.parts))
    exact, lowest = _exact(queries, vectors)
    out = []
    for start in range(0, len(queries), SLICE):
        rows = np.arange(start, min(start + SLICE, len(queries)))
        own = query_ids[rows][:, None] == ids[None, :]
        # Candidates with the highest coarse bounds give a first threshold.
        bound = _bounds(q, v, 0, rows) if levels else np.full(own.shape, np.inf)
        bound = np.where(own, -np.inf, bound)
        first = min(4 * k, len(ids))
        likely = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        at, to = np.repeat(rows, first), likely.ravel()
        score = np.where(own[at - start, to], lowest, exact(at, to)).reshape(len(rows), first)
        threshold = np.full(len(rows), lowest)
        if first >= k:
            threshold = np.sort(score, axis=1)[:, first - k]
        at, to = np.nonzero((bound >= threshold[:, None]) & ~own)
        for level in range(1, levels):
            near = _pair_bounds(q, v, level, at + start, to) >= threshold[at]
            at, to = at[near], to[near]
        score = exact(at + start, to)
        good = score >= threshold[at]
        at, to, score = at[good], to[good], score[good]
        # Integers beyond a long are ranked by their place among all scores.
        height = np.unique(score, return_inverse=True)[1] if score.dtype == object else score
        ranked = np.lexsort((to, -height, at))
        at, to, score = at[ranked], to[ranked], score[ranked]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        top = place < k
        out.append((at[top] + start, order[to[top]], _longs(score[top])))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _longs(scores: np.ndarray) -> np.ndarray:
    for score in scores if scores.dtype == object else ():
        if not -LONG <= score < LONG:
            raise ArithmeticError(f"the score {score} does not fit a long")
    return scores.astype(np.int64)


def _whole(vectors: np.ndarray) -> np.ndarray:
    """Whole doubles as Python's integers."""
    out = np.empty(vectors.shape, dtype=object)
    out[...] = [[int(x) for x in row] for row in vectors]
    return out


def _exact(queries: np.ndarray, vectors: np.ndarray):
    """Products of pairs in whole numbers, in pieces of bounded size, and what is below all."""
    most = queries.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    small = most < EXACT
    q, v = (x.astype(np.int64) if small else _whole(x) for x in (queries, vectors))
    piece = max(1, (1 << 22) // max(1, q.shape[1]))

    def products(at: np.ndarray, to: np.ndarray) -> np.ndarray:
        pieces = ((q[at[s : s + piece]], v[to[s : s + piece]]) for s in range(0, len(at), piece))
        if small:
            found = [np.einsum("ij,ij->i", a, b) for a, b in pieces]
        else:
            found = [(a * b).sum(axis=1) if a.shape[1] else np.zeros(len(a), dtype=object) for a, b in pieces]
        return np.concatenate(found) if found else np.zeros(0, dtype=q.dtype)

    return products, np.iinfo(np.int64).min if small else -math.inf


def _slack(total: np.ndarray) -> np.ndarray:
    """Covers the rounding of the bounds."""
    return 1.0 + 1e-9 * total


def _bounds(q: Described, v: Described, level: int, rows: np.ndarray) -> np.ndarray:
    """Upper bounds of the products of the query rows with all candidates."""
    a, b = q.parts[level][rows], v.parts[level]
    total = q.norm[rows][:, None] + v.norm[None, :]
    distance = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return (total - distance) / 2 + _slack(total)


def _pair_bounds(q: Described, v: Described, level: int, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    piece = max(1, (1 << 21) // q.parts[level].shape[1])
    found = []
    for s in range(0, len(at), piece):
        i, j = at[s : s + piece], to[s : s + piece]
        total = q.norm[i] + v.norm[j]
        distance = ((q.parts[level][i] - v.parts[level][j]) ** 2).sum(axis=1)
        found.append((total - distance) / 2 + _slack(total))
    return np.concatenate(found) if found else np.arange(0.0)


def _blocked(rows: DataFrame, by: Column, size: int, least: int) -> tuple[DataFrame, int]:
    blocks = max(least, math.ceil(rows.count() / size))
    return rows.withColumn("own", F.pmod(by, F.lit(blocks)).cast("int")), blocks


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, id and score; both inputs have `id` and `vector`."""
    spark = candidates.sparkSession
    queries = queries.dropDuplicates(["id", "vector"]).withColumn("query", F.xxhash64("id", "vector"))
    q, q_blocks = _blocked(queries, F.col("query"), QUERIES, 1)
    # A block for each task at least, and none larger than its bound. Rows are
    # numbered where they are read, so that a repeated task gives the same.
    number = F.monotonically_increasing_id()
    c, c_blocks = _blocked(candidates, number, CANDIDATES, parallelism(spark))
    group = ("q_block", "c_block")
    q = q.withColumn("q_block", F.col("own"))
    q = q.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))))
    c = c.withColumn("c_block", F.col("own"))
    c = c.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        columns = ["query", "query_id", "id", "score"]
        if left.empty or right.empty:
            return pd.DataFrame({name: np.arange(0) for name in columns})
        width = max(left["vector"].map(len).max(), right["vector"].map(len).max())
        at, to, score = best_of_block(
            left["id"].to_numpy(), _padded(left["vector"], width),
            right["id"].to_numpy(), _padded(right["vector"], width), k,
        )
        values = (left["query"].to_numpy()[at], left["id"].to_numpy()[at], right["id"].to_numpy()[to], score)
        return pd.DataFrame(dict(zip(columns, values, strict=True)))

    found = (
        q.select(*group, "query", "id", "vector")
        .groupBy(*group)
        .cogroup(c.select(*group, "id", "vector").groupBy(*group))
        .applyInPandas(best, "query long, query_id long, id long, score long")
    )
    ranked = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )
