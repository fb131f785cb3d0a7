"""Text functions against plain Python on small inputs."""

import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filings.functions import text as X

TEXTS = [
    "",
    " ",
    "one",
    "  a  b \t c\n",
    "a b c　 d e\x85f",
    "abc1 frs-102 x_y _ 9 été A1b2",
    "The cat, the hat; the bat. the cat",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z a b c d e f",
]


def column(spark, make, texts=TEXTS):
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    found = rows.select("n", make(F.col("t")).alias("v")).collect()
    return [r.v for r in sorted(found, key=lambda r: r.n)]


def blocks(words, n):
    cut = [" ".join(words[i : i + n]) for i in range(0, len(words), n)]
    return list(dict.fromkeys(b for b in cut if len(b.split(" ")) == n))


def runs(words, n):
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_strip_and_words_use_unicode_spaces(spark):
    assert column(spark, X.strip) == [t.strip() for t in TEXTS]
    assert column(spark, X.words) == [t.split() for t in TEXTS]
    for n in (0, 1, 4, 5):
        got = column(spark, lambda t: X.has_more_words(X.strip(t), n))
        assert got == [len(t.split()) > n for t in TEXTS]


def test_tokens(spark):
    plain = [re.findall(r"\b\w+\b", t, re.ASCII) for t in TEXTS]
    assert column(spark, X.word_tokens) == plain
    letters = [re.findall(r"\b[a-zA-Z_]+\b", t, re.ASCII) for t in TEXTS]
    assert column(spark, X.alpha_tokens) == letters
    assert column(spark, X.space_tokens) == [t.split(" ") for t in TEXTS]
    kept = column(spark, lambda t: X.remove_stopwords(X.words(t), ["the", "b"]))
    assert kept == [[w for w in t.split() if w not in ("the", "b")] for t in TEXTS]
    assert column(spark, lambda t: X.remove_stopwords(X.words(t), [])) == [
        t.split() for t in TEXTS
    ]


@pytest.mark.parametrize("n", [1, 2, 5, 15, 40])
def test_word_sequences(spark, n):
    words = [t.split() for t in TEXTS]
    assert column(spark, lambda t: X.ngrams(X.words(t), n)) == [runs(w, n) for w in words]
    assert column(spark, lambda t: X.ngrams(X.words(t), n, distinct=True)) == [
        list(dict.fromkeys(runs(w, n))) for w in words
    ]
    assert column(spark, lambda t: X.block_ngrams(X.words(t), n)) == [
        blocks(w, n) for w in words
    ]


@settings(
    max_examples=15,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(st.lists(st.text("ab c1_é\n", max_size=40), min_size=1, max_size=20))
def test_term_counts_match_a_counter(spark, texts):
    got = column(spark, lambda t: X.term_counts(X.words(t)), texts)
    assert [{r.term: r.tf for r in row} for row in got] == [
        dict(Counter(t.split())) for t in texts
    ]
