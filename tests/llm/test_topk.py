import math

import numpy as np
import pytest

from filings.llm import topk


def brute(rows):
    usable = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for q, a in usable:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    return out


def run(spark, rows):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    usable = topk.usable_vectors(frame, "vec_id", "embedding")
    return [tuple(r) for r in topk.top_k(usable.filter("id % 50 = 0"), usable).collect()]


def some_rows():
    rng = np.random.default_rng(3)
    vectors = rng.normal(0, 0.2, (400, 17)).astype(np.float32)
    vectors[50:90] = vectors[0]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [
        (450, None), (451, [1.0, None]), (452, [float("nan")]), (453, [float("inf")]),
        (454, []), (500, []), (550, [0.5, -0.25]), (None, [1.0] * 17), (456, [9e6, 1.0]), (600, [1e7, 1.0]),
    ]
    return rows


def test_like_brute_force(spark):
    rows = some_rows()
    found = run(spark, rows)
    assert set(found) == brute(rows) and len(found) == len(set(found))


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = some_rows()
    monkeypatch.setattr(topk, "CANDIDATES", 7)
    monkeypatch.setattr(topk, "QUERIES", 2)
    assert set(run(spark, rows)) == brute(rows)


def test_pruning_keeps_exact_answers_in_clusters():
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 100, (5, 64))
    vectors = np.floor(centres[rng.integers(0, 5, 3000)] + rng.normal(0, 5, (3000, 64)))
    ids = rng.permutation(3000)
    at, to, score = topk.best_of_block(ids[:100], vectors[:100], ids, vectors)
    products = (vectors[:100] @ vectors.T).astype(int)
    for q in range(100):
        best = sorted((-products[q, c], ids[c]) for c in range(3000) if ids[c] != ids[q])[:5]
        own = at == q
        assert [(-s, ids[c]) for s, c in zip(score[own], to[own])] == best


def test_large_components(spark):
    rows = [(0, [9e6, 1.0]), (1, [9e6, 1.0]), (2, [1e7, 1.0]), (50, [1e7, 1.0]), (3, [3e5, -2e6])]
    assert set(run(spark, rows)) == brute(rows) and len(brute(rows)) == 8
    # Only a product that is among the best must fit a long.
    rows = [(50, [0.0, 1.0]), (51, [3e38, 2.0]), (52, [-3e38, 3.0]), (53, [1e30, -1.0])]
    assert set(run(spark, rows)) == brute(rows)
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, [(50, [3e38]), (51, [3e38])])


def test_exact_products_beyond_longs_prune_like_others(monkeypatch):
    rng = np.random.default_rng(6)
    vectors, ids = np.floor(rng.normal(0, 1e4, (300, 8))), np.arange(300)
    expected = topk.best_of_block(ids[:20], vectors[:20], ids, vectors)
    monkeypatch.setattr(topk, "EXACT", 1)
    monkeypatch.setattr(topk, "LARGEST", 10.0)
    found = topk.best_of_block(ids[:20], vectors[:20], ids, vectors)
    assert all(np.array_equal(a, b) for a, b in zip(expected, found))


def test_few_and_no_rows(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0]), (0, [1.0]), (1, [2.0])]) == [
        (0, 1, 1, 512 * 256), (0, 2, 1, 512 * 256)
    ]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
