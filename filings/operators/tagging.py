"""Whether a document's untagged prose also stands inside a tagged fact."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.functions.fuzzy import matched_shares
from filings.functions.text import let
from filings.operators.computed import computed
from filings.operators.facts import is_tagged

# What stands for a missing text in the fuzzy comparison.
NO_FRAGMENT = " "
NO_FACT_TEXT = "###"

FUZZY_THRESHOLD = 0.6


def _result(documents: DataFrame, match: Column, matched_in: Column) -> DataFrame:
    """Adds `status` and, for tagged documents, where the match is."""
    kept = [c for c in documents.columns if c not in ("facts", "fragments")]
    return documents.select(
        *kept,
        F.get("fragments", F.lit(0)).alias("fragment"),
        match.alias("m"),
        matched_in.alias("matched_in"),
    ).select(
        *kept,
        "fragment",
        F.when(F.col("m").isNull(), "untagged").otherwise("tagged").alias("status"),
        "m.name",
        "m.context",
        "m.seq",
        F.when(F.col("m").isNotNull(), F.col("matched_in")).alias("matched_in"),
    )


def tag_lookup(documents: DataFrame) -> DataFrame:
    """First tagged fact whose text or tail holds the document's first fragment."""
    def holds(text: Column, fragment: Column) -> Column:
        return F.coalesce(F.contains(F.lower(text), fragment), F.lit(False))

    def matches(fragment: Column) -> Column:
        return F.filter(
            "facts",
            lambda f: is_tagged(f)
            & (holds(f["text"], fragment) | holds(f["tail"], fragment)),
        )

    first = F.get("fragments", F.lit(0))
    match = F.get(let(first, matches), F.lit(0))
    found = computed(documents, _match=match)
    where = F.when(holds(F.col("_match.text"), first), "text").otherwise("tail")
    return _result(found, F.col("_match"), where).drop("_match")


def _may_match(fragment: Column, text: Column, threshold: float) -> Column:
    """False only where `matched_shares` cannot pass the threshold.

    With d edits at most, all but d characters of the shorter text are matched,
    so a much longer text cannot pass; and each edit spoils two pairs of
    neighbours at most, so of the shorter text's pairs all others are in the
    longer one.
    """

    def enough(short: Column, long: Column) -> Column:
        length = F.length(short)
        # Fewest matched characters that pass, and the edits that leaves.
        least = F.floor(F.lit(threshold / 2) * (length + F.length(long)) + 1e-9) + 1
        edits = length - least
        starts = F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1)))
        held = F.filter(starts, lambda i: F.contains(long, F.substring(short, i, F.lit(2))))
        return (edits >= 0) & ((length < 2) | (F.size(held) >= length - 1 - 2 * edits))

    shorter = F.length(fragment) <= F.length(text)
    return let(
        F.struct(
            F.when(shorter, fragment).otherwise(text).alias("short"),
            F.when(shorter, text).otherwise(fragment).alias("long"),
        ),
        lambda pair: enough(pair["short"], pair["long"]),
    )


def _first_alike(threshold: float) -> Callable[[Column, Column], Column]:
    """The number of the first text, from 0, that is alike to the fragment; else null."""

    @F.pandas_udf("int")
    def first(fragments: pd.Series, texts: pd.Series) -> pd.Series:
        rows = np.repeat(np.arange(len(texts)), texts.map(len).to_numpy(dtype=int))
        every = [text for own in texts for text in own]
        alike = matched_shares([fragments[row] for row in rows.tolist()], every) > threshold
        starts = np.searchsorted(rows, np.arange(len(texts)))
        hits, out = np.flatnonzero(alike), [None] * len(texts)
        for hit in hits[::-1].tolist():
            out[rows[hit]] = hit - int(starts[rows[hit]])
        return pd.Series(out, dtype="Int32")

    return first


def tag_lookup_fuzzy(
    documents: DataFrame, threshold: float = FUZZY_THRESHOLD
) -> DataFrame:
    """As `tag_lookup`, for a fact text or tail similar to the first fragment.

    Case counts here. Similar are texts of which twice the matched characters are
    more than `threshold` of both lengths together (`matched_shares`): a fragment
    of 30 characters within a text of 52 has 60 of 82. Texts that cannot pass by
    their length or their pairs of characters are not compared; Python sees
    only the others, a batch of documents at a time.
    """

    def filled(text: Column, default: str) -> Column:
        return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))

    fragment = filled(F.get("fragments", F.lit(0)), NO_FRAGMENT)

    def candidates(own: Column) -> Column:
        pairs = F.flatten(
            F.transform(
                F.filter("facts", is_tagged),
                lambda f: F.transform(
                    F.array(f["text"], f["tail"]),
                    lambda t: F.struct(f.alias("fact"), filled(t, NO_FACT_TEXT).alias("text")),
                ),
            )
        )
        return F.filter(pairs, lambda pair: _may_match(own, pair["text"], threshold))

    found = computed(documents, _fragment=fragment, _near=let(fragment, candidates))
    texts = F.transform("_near", lambda pair: pair["text"])
    first = _first_alike(threshold)("_fragment", texts)
    found = found.withColumn("_at", first)
    found = found.withColumn("_match", F.when(F.col("_at").isNotNull(), F.get("_near", F.col("_at"))["fact"]))
    kept = found.drop("_fragment", "_near", "_at")
    return _result(kept, F.col("_match"), F.lit(None).cast("string")).drop("_match", "matched_in")


def keep_tagged(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "tagged")
