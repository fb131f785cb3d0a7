"""Column functions on text, words and word sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space when text is stripped
# or split into words (the no-break and typographic spaces included).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RANGES = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body) -> Column:
    """Bind `value` once for `body`, which may use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def words(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.array_remove(F.split(text, f"[{_SPACE_RANGES}]+", -1), "")


def has_more_words(stripped: Column, n: int) -> Column:
    """Whether a stripped text has more than n words; reads no further than that."""
    word = f"[^{_SPACE_RANGES}]"
    return stripped.rlike(f"^(?:{word}++[{_SPACE_RANGES}]++){{{n}}}{word}")


def word_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0))


def alpha_tokens(text: Column) -> Column:
    """Word tokens that hold no digit."""
    pattern = "(?<![A-Za-z0-9_])[A-Za-z_]++(?![A-Za-z0-9_])"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Split at every single space; empty tokens and punctuation stay."""
    return F.split(text, " ", -1)


def remove_stopwords(tokens: Column, stopwords: Sequence[str]) -> Column:
    """Drop the listed words; order and repeats of the others stay."""
    listed = sorted(set(stopwords))
    if not listed:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(listed))


def join_words(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _runs(tokens: Column, n: int, step: int) -> Column:
    """Runs of n tokens that start at every `step`-th token.

    The tokens are bound first: a lambda computes what it captures anew for
    each item.
    """

    def cut(bound: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(bound) - F.lit(n - 1), F.lit(step))
        runs = F.transform(starts, lambda i: join_words(F.slice(bound, i, n)))
        return F.when(F.size(bound) >= n, runs).otherwise(_no_strings())

    return let(tokens, cut)


def ngrams(tokens: Column, n: int, distinct: bool = False) -> Column:
    """Every run of n neighbouring tokens."""
    runs = _runs(tokens, n, 1)
    return F.array_distinct(runs) if distinct else runs


def block_ngrams(tokens: Column, n: int) -> Column:
    """Distinct blocks of n tokens laid end to end; a short last block is dropped."""
    return F.array_distinct(_runs(tokens, n, n))


def term_counts(tokens: Column) -> Column:
    """`array<struct<term, tf>>` of one document, without leaving its row.

    The tokens are sorted, so each term is one run: its count is the distance
    between the starts of neighbouring runs.
    """

    def runs(ordered: Column) -> Column:
        size = F.size(ordered)
        starts = F.filter(
            F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: (i == 1)
            | (F.get(ordered, i - 1) != F.get(ordered, i - 2)),
        )
        return let(
            starts,
            lambda s: F.transform(
                s,
                lambda at, k: F.struct(
                    F.get(ordered, at - 1).alias("term"),
                    (F.coalesce(F.get(s, k + 1), size + 1) - at)
                    .cast("long")
                    .alias("tf"),
                ),
            ),
        )

    return let(F.sort_array(tokens), runs)
