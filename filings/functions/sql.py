"""The text functions as SQL functions of a session.

Each has a SQL expression for a body, so a query that calls it is planned as if
the expression stood there: nothing is hidden from the optimizer, and no Python
runs. They give what the column functions of `text` of like names give.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from filings.functions.text import _SPACE_RANGES, SPACE_CHARS


def _text(value: str) -> str:
    """A SQL string of these characters."""
    return "'" + "".join(f"\\u{ord(c):04x}" for c in value) + "'"


# Name and parameters, type and body. The optimizer puts an argument wherever its
# parameter stands, so one that is used for every item is bound by a lambda first.
_RUNS = (
    "get(transform(array(tokens), bound -> CASE WHEN size(bound) >= n THEN "
    "transform(sequence(1, size(bound) - (n - 1), {step}), i -> array_join(slice(bound, i, n), ' ')) "
    "ELSE cast(array() AS array<string>) END), 0)"
)
FUNCTIONS = {
    "strip_text(s STRING)": ("STRING", f"trim(BOTH {_text(SPACE_CHARS)} FROM s)"),
    "words(s STRING)": (
        "ARRAY<STRING>", f"array_remove(split(s, r'[{_SPACE_RANGES}]+', -1), '')"
    ),
    "word_tokens(s STRING)": ("ARRAY<STRING>", "regexp_extract_all(s, '[A-Za-z0-9_]+', 0)"),
    "alpha_tokens(s STRING)": (
        "ARRAY<STRING>",
        "regexp_extract_all(s, '(?<![A-Za-z0-9_])[A-Za-z_]++(?![A-Za-z0-9_])', 0)",
    ),
    "space_tokens(s STRING)": ("ARRAY<STRING>", "split(s, ' ', -1)"),
    "remove_stopwords(tokens ARRAY<STRING>, listed ARRAY<STRING>)": (
        "ARRAY<STRING>", "filter(tokens, t -> NOT array_contains(listed, t))"
    ),
    "join_words(tokens ARRAY<STRING>)": ("STRING", "array_join(tokens, ' ')"),
    "ngrams(tokens ARRAY<STRING>, n INT)": ("ARRAY<STRING>", _RUNS.format(step="1")),
    "block_ngrams(tokens ARRAY<STRING>, n INT)": (
        "ARRAY<STRING>", f"array_distinct({_RUNS.format(step='n')})"
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
