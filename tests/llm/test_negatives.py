import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filings.llm import negatives
from filings.llm.queries import op12_negatives


def brute(rows):
    usable = []
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        usable.append((i, label, tuple(math.floor(256 * float(x)) for x in v)))
    out = []
    for a, label, q in sorted({row for row in usable if row[0] % 50 == 0}):
        scored = sorted(
            ((-sum(x * y for x, y in zip(q, v)), i, other) for i, other, v in usable if i != a),
        )
        for p, i, _ in [row for row in scored if row[2] == label][:5]:
            fits = [(-s, j) for s, j, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(a, i, n + 1, j, -p, s) for n, (s, j) in enumerate(fits[:3])]
    return Counter(out)


def run(spark, tmp_path, rows, name="e"):
    frame = spark.createDataFrame(
        [(*row, 1) for row in rows], "vec_id long, embedding array<float>, label int, score int"
    )
    frame.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    found = op12_negatives(spark, f"{tmp_path}/{name}")
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return Counter(tuple(r) for r in found.select(*columns).collect())


def some_rows():
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 0.3, (10, 12))
    labels = rng.choice(10, 500, p=[0.4] + [0.6 / 9] * 9)
    vectors = (centres[labels] + rng.normal(0, 0.3, (500, 12))).astype(np.float32)
    vectors[200:230] = vectors[50]  # ties, over several labels
    rows = [(i, [float(x) for x in v], int(label)) for i, (v, label) in enumerate(zip(vectors, labels))]
    return rows + [
        (500, None, 1), (501, [1.0, None], 1), (502, [float("nan")], 1), (503, [1.0], None), (None, [1.0], 1),
        (504, [], 2), (550, [0.5, -0.25], 3), (505, [float("-inf")], 2), (506, [9e6, 1.0], 4), (600, [3e3, -1.0], 4),
    ]


def test_like_brute_force(spark, tmp_path, monkeypatch):
    rows = some_rows()
    expected = brute(rows)
    assert expected and run(spark, tmp_path, rows) == expected
    monkeypatch.setattr(negatives, "CANDIDATES", 60)
    monkeypatch.setattr(negatives, "ANCHORS", 3)
    assert run(spark, tmp_path, rows, "small") == expected


def test_repeated_rows_few_and_none(spark, tmp_path):
    rows = [(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1), (1, [1.0], 1), (2, [0.75], 2), (2, [0.75], 2), (3, [0.2], 2)]
    assert run(spark, tmp_path, rows) == brute(rows)
    assert run(spark, tmp_path, rows[:4], "same") == Counter()
    assert run(spark, tmp_path, [], "none") == Counter()
    below = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.75], 2), (50, [0.0], 5), (51, [0.0], 5)]
    assert run(spark, tmp_path, below, "below") == brute(below)


def test_packed_products_of_any_width():
    rng = np.random.default_rng(3)
    for high in (1, 100, 1 << 20, 1 << 30, 1 << 52):
        vectors = rng.integers(-high, high + 1, (37, 5))
        anchor = rng.integers(-high, high + 1, 5)
        pack = negatives.Packed(vectors, int(np.abs(anchor).max()))
        exact = [sum(int(x) * int(y) for x, y in zip(v, anchor)) for v in vectors]
        assert [int(x) for x in pack.products(anchor)] == exact
    extreme = np.array([[-100] * 5, [100] * 5])
    for anchor in extreme:
        assert list(negatives.Packed(extreme, 100).products(anchor)) == list(extreme @ anchor)


def test_components_beyond_any_long(spark, tmp_path):
    # A huge vector takes part; its products are exact, and none here is in the result.
    rows = [(50, [3e38, 1.0], 1), (51, [0.0, 1.0], 1), (52, [0.0, 0.75], 2), (1, [1e30, 0.0], 3)]
    rows += [(0, [0.0, 1.0], 5), (2, [0.0, 1.0], 5)]
    assert run(spark, tmp_path, rows) == brute(rows)
    with pytest.raises(Exception, match="does not fit a long"):
        run(spark, tmp_path, [(50, [3e38], 1), (51, [3e38], 1), (52, [1e38], 2)], "error")


def test_rows_that_take_part(spark):
    frame = spark.createDataFrame([(1, [1.0], 2), (2, None, 2), (3, [1.0, None], 2)], "i long, v array<double>, l int")
    kept = negatives.usable_rows(frame, "i", F.col("l"), "v").collect()
    assert [tuple(r) for r in kept] == [(1, 2, [256.0])]
