"""Quality classifier learned from positives and unlabelled text.

Trusted positives are documents with label 1; the other side of the risk is
unlabelled text. Minimised is the non-negative unbiased risk with the logistic
loss, p * R+(positives) + max(0, R-(unlabelled) - p * R-(positives)), where p is
the estimated class prior: the share of label 1 among labelled rows.

Only rows outside the held-out third are learned from, on a sample of at most
`TRAIN_ROWS` positives and as many unlabelled rows, taken by hash. Scores depend
on the text alone and are made for every whole text.

Null and empty texts are scored like any other. Documents labelled with both
values have no label. Repeated rows have a score each. Without positives every
score is the prior (one half if nothing is labelled). An empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from filings.llm.common import whole

TRAIN_ROWS = 10_000
STEPS = 600
RATE = 0.05
DECAY = 1e-4

# Classes of characters; those beyond the table count as letters.
LETTER, UPPER, DIGIT, SPACE, STOP, SYMBOL = range(6)
_TABLE = np.array(
    [
        DIGIT if c.isdigit()
        else UPPER if c.isupper()
        else LETTER if c.isalpha()
        else SPACE if c.isspace()
        else STOP if c in ".,;:'\"?()-"
        else SYMBOL
        for c in map(chr, range(0x250))
    ]
)
_TABLE = np.r_[_TABLE, LETTER]


def features(text: str) -> list[float]:
    """Shares and averages that describe the form of a text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    counts = np.bincount(_TABLE[np.minimum(codes, len(_TABLE) - 1)], minlength=6)
    words, lines = text.split(), text.split("\n")
    n_chars, n_words = max(1, len(codes)), max(1, len(words))
    letters = counts[LETTER] + counts[UPPER]
    return [
        np.log1p(len(words)),
        np.log1p(len(words) / len(lines)),
        counts[UPPER] / max(1, letters),
        counts[DIGIT] / n_chars,
        counts[STOP] / n_words,
        np.log1p(50 * counts[SYMBOL] / n_words),
        np.log1p(letters / n_words),
        np.log(max(1, len(set(words)))) - np.log(n_words),
        np.sqrt(sum(map(eq, words, words[1:])) / n_words),
        1 - len(set(lines)) / len(lines),
    ]


@F.pandas_udf(ArrayType(DoubleType()))
def text_features(texts: pd.Series) -> pd.Series:
    return pd.Series([features(text) for text in texts])


@dataclass(frozen=True)
class Classifier:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, rows: np.ndarray) -> np.ndarray:
        logits = _expanded(rows, self.centre, self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _expanded(rows: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares and a constant."""
    x = np.clip((rows - centre) / scale, -8, 8)
    return np.hstack([x, x * x / 4, np.ones((len(x), 1))])


def loss(w: np.ndarray, x: np.ndarray, sign: int) -> tuple[float, np.ndarray]:
    """Mean logistic loss of rows that should have the sign, and its gradient."""
    margin = np.clip(sign * (x @ w), -30, 30)
    slope = -sign / (1 + np.exp(margin))
    return np.log1p(np.exp(-margin)).mean(), x.T @ slope / len(x)


def direction(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """What to descend along: the gradient of the unbiased risk.

    The risk of the negatives is that of unlabelled rows less that of the
    positives among them. Where this estimate is below zero, the step goes back
    along its gradient instead.
    """
    _, up = loss(w, p, 1)
    loss_p, down_p = loss(w, p, -1)
    loss_u, down_u = loss(w, u, -1)
    if loss_u - prior * loss_p >= 0:
        return prior * up + down_u - prior * down_p
    return prior * down_p - down_u


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float) -> Classifier:
    """Gradient steps on the non-negative unbiased risk."""
    width = max(positives.shape[-1], unlabelled.shape[-1])
    if not len(positives) or not len(unlabelled):
        logit = np.log(np.clip(prior, 1e-6, 1 - 1e-6) / np.clip(1 - prior, 1e-6, 1))
        flat = np.r_[np.zeros(2 * width), logit]
        return Classifier(np.zeros(width), np.ones(width), flat)
    centre = np.median(unlabelled, axis=0)
    scale = unlabelled.std(axis=0) + 1e-3
    p, u = _expanded(positives, centre, scale), _expanded(unlabelled, centre, scale)
    w, m, v = np.zeros(p.shape[1]), 0.0, 0.0
    w[-1] = np.log(prior / max(1e-6, 1 - prior)) if prior < 1 else 5.0

    for step in range(1, STEPS + 1):
        g = direction(w, p, u, prior)
        g = g + DECAY * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Classifier(centre, scale, w)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the labels of a document must not be learned from."""
    return F.crc32(whole(F.col(doc_id).cast("string"))) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    known = (
        labels.select("doc_id", "quality")
        .filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
        .filter("low = high")
        .filter(~held_out())
    )
    shares = known.agg(F.avg((F.col("high") == 1).cast("int")).alias("prior")).head()
    by = F.xxhash64("doc_id")
    good = known.filter("high = 1").select("doc_id").orderBy(by).limit(rows)
    # Unlabelled text stands for the whole corpus: labelled or not, it may be taken.
    ids = docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("doc_id")
    any_text = ids.distinct().orderBy(by).limit(rows)
    chosen = good.withColumn("positive", F.lit(True)).union(any_text.withColumn("positive", F.lit(False)))
    # At most 2 * rows ids.
    texts = docs.select("doc_id", whole("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = texts.select("doc_id", "positive", text_features("text").alias("x"))
    sample = found.orderBy(F.xxhash64("doc_id", "x"), "positive").limit(2 * rows).toPandas()
    width = len(features(""))
    parts = [
        np.array(sample["x"][sample["positive"] == side].tolist(), dtype=float).reshape(-1, width)
        for side in (True, False)
    ]
    return fit(*parts, 0.5 if shares.prior is None else float(shares.prior))


def score(text: str | Column, model: Classifier) -> Column:
    """Score of a text: the higher, the likelier label 1."""

    @F.pandas_udf(DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts], dtype=float)
        return pd.Series(model.score(rows) if len(rows) else [], dtype=float)

    return scored(whole(text))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(docs, labels)
    rows = docs.select("doc_id", score("text", model).alias("score"))
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, unchanged."""
    model = train(docs, labels)
    row = F.struct(*docs.columns).alias("_row")
    scored = docs.select(row, score(docs["text"], model).alias("_score"))
    return scored.filter("_score >= 0.5").select("_row.*")
