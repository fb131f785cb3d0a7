import zlib

import numpy as np

from filings.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    found = quality.scores(docs, labels)
    assert found.count() == docs.count()
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    right = np.mean([r.predicted == r.quality for r in rows])
    bad = [r for r in rows if r.quality == 0]
    assert right > 0.95 and np.mean([r.predicted == 0 for r in bad]) > 0.8
    assert all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(string(doc_id)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality"
    )
    one, two = quality.train(docs, labels), quality.train(docs, flipped)
    assert np.array_equal(one.weights, two.weights)


def test_risk_separates_clouds_without_negatives():
    rng = np.random.default_rng(5)
    good, bad = rng.normal(2, 1, (4000, 3)), rng.normal(-2, 1, (4000, 3))
    mixed = np.vstack([good[2000:], bad[:1000]])
    model = quality.fit(good[:2000], mixed, 2 / 3)
    assert (model.score(good) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


def test_direction_like_differences_of_the_risk():
    rng = np.random.default_rng(7)
    p, u = rng.normal(0.5, 1, (40, 4)), rng.normal(-0.5, 1, (60, 4))
    mean = lambda w, x, sign: np.mean([np.log1p(np.exp(-sign * float(row @ w))) for row in x])
    branches = set()
    for prior in (0.2, 0.5, 0.95):
        for scale in (0.1, 1.0, 4.0):
            w = rng.normal(0, scale, 4)
            below = lambda w: mean(w, u, -1) - prior * mean(w, p, -1)  # noqa: B023, E731
            positive = below(w) >= 0
            value = (lambda w: prior * mean(w, p, 1) + below(w)) if positive else (lambda w: -below(w))  # noqa: B023
            steps = np.eye(4) * 1e-6
            slopes = [(value(w + step) - value(w - step)) / 2e-6 for step in steps]
            assert np.allclose(quality.direction(w, p, u, prior), slopes, atol=1e-6)
            branches.add(positive)
    assert branches == {True, False}


def test_scores_like_their_formula():
    rng = np.random.default_rng(8)
    good, every = rng.normal(1, 2, (300, 3)), rng.normal(0, 2, (500, 3))
    model = quality.fit(good, every, 0.6)
    for row in np.vstack([good[:5], every[:5], [[1e9, -1e9, 0]]]):
        x = [min(8, max(-8, (v - c) / s)) for v, c, s in zip(row, model.centre, model.scale)]
        logit = sum(a * b for a, b in zip(model.weights, [*x, *(v * v / 4 for v in x), 1]))
        expected = 1 / (1 + np.exp(-min(30, max(-30, logit))))
        assert abs(model.score(row[None])[0] - expected) < 1e-12
    assert np.allclose(model.centre, np.median(every, axis=0))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a " * 200_000), (3, "a " * 200_000), (None, "x"), (4, "퟿ \U0001f600")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (None, 1)], "doc_id long, quality int")
    found = quality.scores(docs, labels).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
