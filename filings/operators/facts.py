"""Tagged facts and prose fragments of parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.functions.text import has_more_words, strip
from filings.operators.computed import computed
from filings.operators.markup import document_columns, kept_elements

# Names and contexts given to elements that carry none.
UNKNOWN = "Ukn Conv"
NO_NAME = "No attr"
NO_CONTEXT = "No ctx"


def _attribute(node: Column, upper_name: str) -> Column:
    """Value of the last attribute of that name, in any case."""
    found = F.filter(
        F.map_entries(node["attrs"]), lambda a: F.upper(a["key"]) == upper_name
    )
    return F.get(found, F.size(found) - 1)["value"]


def fact(node: Column) -> Column:
    """`struct<seq, name, context, text, tail, is_tagged>` of one element."""
    bare = F.size(node["attrs"]) == 0
    name = F.when(bare, NO_NAME).otherwise(
        F.coalesce(_attribute(node, "NAME"), F.lit(UNKNOWN))
    )
    context = F.when(bare, NO_CONTEXT).otherwise(
        F.coalesce(_attribute(node, "CONTEXTREF"), F.lit(UNKNOWN))
    )
    return F.struct(
        node["seq"].alias("seq"),
        name.alias("name"),
        context.alias("context"),
        strip(node["text"]).alias("text"),
        strip(node["tail"]).alias("tail"),
    )


def is_tagged(one: Column) -> Column:
    return ~one["name"].isin(UNKNOWN, NO_NAME)


def facts_of(elements: Column) -> Column:
    return F.transform(elements, fact)


def fragments_of(facts: Column, min_words: int, untagged_only: bool = True) -> Column:
    """Lower-cased texts and tails of more than `min_words` words, in order."""
    read = F.filter(facts, lambda f: ~is_tagged(f)) if untagged_only else facts
    each = F.flatten(F.transform(read, lambda f: F.array(f["text"], f["tail"])))
    long = F.filter(each, lambda t: has_more_words(t, min_words))
    return F.transform(long, F.lower)


def with_facts(parsed: DataFrame, style_rule: str | None = "first_line") -> DataFrame:
    """Adds `facts`, one per kept element, to each document."""
    kept = kept_elements(F.col("elements"), style_rule)
    return computed(parsed, facts=facts_of(kept)).select(
        *document_columns(parsed), "facts"
    )


def resolve_facts(
    parsed: DataFrame, style_rule: str | None = "first_line"
) -> DataFrame:
    """One row per kept element: its name, context, text and tail."""
    ids = document_columns(parsed)
    facts = facts_of(kept_elements(F.col("elements"), style_rule))
    rows = parsed.select(*ids, F.explode(facts).alias("f"))
    return rows.select(*ids, "f.*", is_tagged(F.col("f")).alias("is_tagged"))


def with_fragments(
    facts: DataFrame, min_words: int, untagged_only: bool = True
) -> DataFrame:
    """Adds `fragments` to documents that have any; the others are dropped."""
    fragments = fragments_of(F.col("facts"), min_words, untagged_only)
    return documents_with_text(computed(facts, fragments=fragments), "fragments")


def documents_with_text(documents: DataFrame, fragments: str) -> DataFrame:
    return documents.filter(F.size(fragments) > 0)


def line_fragments(text: Column, min_words: int) -> Column:
    """Fragments of plain text: its stripped, lower-cased, long enough lines."""
    lines = F.transform(F.split(text, "\n"), strip)
    long = F.filter(lines, lambda t: has_more_words(t, min_words))
    return F.transform(long, F.lower)
