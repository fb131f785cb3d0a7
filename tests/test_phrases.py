"""Phrases, skewed joins and term weights against brute force."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from filings.functions.text import words
from filings.operators import bloom, phrases, skew
from filings.operators.bloom import possible
from filings.operators.phrases import (
    phrase_band,
    phrase_count_histogram,
    phrase_counts,
    phrase_with_irmark,
)
from filings.operators.storage import materialise
from filings.operators.terms import preview, tfidf_terms, word_count


def postings(seed=3):
    """Every third document has the same phrase; the others share few."""
    rng = random.Random(seed)
    rows = [("hot", f"m{i % 50}") for i in range(2000)]
    rows += [(f"p{rng.randint(0, 900)}", f"m{rng.randint(0, 50)}") for _ in range(4000)]
    return rows


def test_band_matches_brute_force_with_a_hot_phrase(spark):
    rows = postings()
    made = spark.createDataFrame(rows, "phrase string, irmark string")
    lists = defaultdict(list)
    for phrase, mark in rows:
        lists[phrase].append(mark)
    for low, high in ((2, 5), (1, 1), (3, 3000), (15, 199)):
        got = {r.phrase: (r.irmarks, r.n) for r in phrase_band(made, low, high).collect()}
        assert got == {
            p: (sorted(m), len(m)) for p, m in lists.items() if low <= len(m) <= high
        }
    histogram = phrase_count_histogram(phrase_counts(made)).collect()
    assert {r.n: r.phrases for r in histogram} == Counter(map(len, lists.values()))
    pairs = phrase_with_irmark(phrase_band(made, 2, 5))
    assert pairs.count() == sum(len(m) for m in lists.values() if 2 <= len(m) <= 5)


def test_one_off_phrases_do_not_reach_the_join(spark):
    rows = postings() + [(f"lone{i}", "m") for i in range(5000)]
    made = materialise(spark.createDataFrame(rows, "phrase string, irmark string"), "test")
    band = phrase_band(made, 2, 5)
    sizes = Counter(phrase for phrase, _ in rows)
    in_band = {p for p, n in sizes.items() if 2 <= n <= 5}
    # Under the first exchange of the postings stands the semi-join with the filter.
    lines = band._jdf.queryExecution().sparkPlan().toString().splitlines()
    semi = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line and "LeftSemi" in line)
    joins = [i for i, line in enumerate(lines) if "Join" in line and "Inner" in line]
    assert joins and all(i < semi for i in joins)
    passed = {r.phrase for r in possible(made, spark.createDataFrame([(p,) for p in in_band], "phrase string"), "phrase").collect()}
    assert in_band <= passed and len(passed - in_band) < 60
    found = {r.phrase for r in band.collect()}
    assert found == in_band


def test_the_band_without_a_filter_is_the_same(spark, monkeypatch):
    made = spark.createDataFrame(postings(), "phrase string, irmark string")
    expected = sorted(map(tuple, phrase_band(made, 2, 5).collect()))
    class Without(bloom.Filter):
        def __init__(self, members, key):
            super().__init__(members, key, most=0)
    monkeypatch.setattr(phrases, "Filter", Without)
    assert sorted(map(tuple, phrase_band(made, 2, 5).collect())) == expected


def test_join_counts_spreads_hot_keys_and_keeps_every_row(spark):
    rows = [("hot", i) for i in range(500)] + [(f"k{i % 40}", i) for i in range(400)]
    rows += [("lone", -1)]
    made = spark.createDataFrame(rows, "k string, i int")
    counts = made.filter("k <> 'lone'").groupBy("k").agg(F.count("*").alias("n"))
    got = skew.join_counts(made, counts, "k", "n", "i").collect()
    expected = Counter(k for k, _ in rows)
    assert len(got) == len(rows)
    assert all(r.n == (None if r.k == "lone" else expected[r.k]) for r in got)


def test_hot_rows_do_not_meet_in_one_task(spark):
    rows = spark.range(8000).select(
        F.when(F.col("id") < 5000, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        "id",
    )
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    options = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name) for name in options}
    for name, value in options.items():
        spark.conf.set(name, value)
    try:
        joined = skew.join_counts(rows, counts, "k", "n", "id")
        tasks = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert len(tasks) == 8
    assert max(t["count"] for t in tasks) < 8000 / 4


def test_tfidf_matches_its_formula(spark):
    rng = random.Random(1)
    texts = [
        " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 30)))
        for _ in range(40)
    ]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = tfidf_terms(documents, "doc_id", words(F.col("text"))).collect()
    tf = [Counter(t.split()) for t in texts]
    df = Counter(term for c in tf for term in c)
    expected = {
        (n, term): (k, df[term], k * math.log(41 / (df[term] + 1)) if df[term] >= 5 else 0)
        for n, c in enumerate(tf)
        for term, k in c.items()
    }
    assert {(r.doc_id, r.term) for r in got} == set(expected)
    for r in got:
        k, d, w = expected[r.doc_id, r.term]
        assert (r.tf, r.df) == (k, d) and math.isclose(r.weight, w, abs_tol=1e-12)


def test_word_count_and_preview(spark):
    lines = spark.createDataFrame([("b a  a",), ("",), ("c b　a",)], "value string")
    counts = word_count(lines)
    assert {r.word: r.n for r in counts.collect()} == {"a": 3, "b": 2, "c": 1}
    assert [r.word for r in preview(counts, 2).collect()] == ["a", "b"]


def test_more_than_a_thousand_keys_can_be_hot(spark):
    rows = spark.range(3600).select((F.col("id") % 1200).cast("string").alias("k"), "id")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1500")
    try:
        assert skew.hottest(counts, "n").count() == 1200
        joined = skew.join_counts(rows, counts, "k", "n", "id")
        assert joined.filter("n = 3").count() == 3600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # With fewer partitions a key fills less than one, so none is hot.
    assert skew.hottest(counts, "n").count() == 0


def test_texts_are_tokenised_once(spark):
    documents = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id int, text string")
    weights = tfidf_terms(documents, "doc_id", words(F.col("text")), 1)
    plan = weights._jdf.queryExecution().toString()
    assert "split(" not in plan
    assert sorted((r.doc_id, r.term, r.tf, r.df) for r in weights.collect()) == [
        (1, "a", 2, 1), (1, "b", 1, 2), (2, "b", 1, 2)
    ]
