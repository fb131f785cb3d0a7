"""Tables under telling headings, and text sections, of parsed documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.functions.text import SPACE_CHARS, let, strip
from filings.functions.tree import (
    XHTML,
    child_text_nodes,
    children,
    following_subtrees,
    inner_text,
    is_element,
    text_else_tail,
)
from filings.operators.computed import computed
from filings.operators.markup import document_columns

# Phrases before a table that mark a tax computation.
HEADING_TERMS = (
    "adjustment of profit",
    "adjustment of loss",
    "adjustment of profit and tax payable",
    "accounts adjustments",
    "calculation of tax liability",
    "adjustment of income and expense statement",
    "adjustment of trading profit",
    "tax reconciliation",
    "losses and allowances",
    "income statement",
)

# A heading that begins like this stands over a contents page.
CONTENTS_WORD = "content"
CONTENTS_WITHIN = 20

SECTION_LABEL = "adjustment of profit"

# The line between two rendered tables.
DIVIDER = "#---------\t" * 5
TABLE_GAP = "\n\n\n" + DIVIDER + "\n\n\n"


def _found_end(text: Column, word: str) -> Column:
    """Position of the last character of the first occurrence, or NULL."""
    at = F.locate(word, text)
    return F.when(at > 0, at + (len(word) - 1))


def _heading_ends(heading: Column, terms: Sequence[str], exclude: str) -> Column:
    """Where the first heading term ends and where a contents word ends."""
    term_ends = [_found_end(heading, term) for term in terms]
    indent = F.length(heading) - F.length(F.ltrim(heading, F.lit(SPACE_CHARS)))
    opening = F.substr(heading, indent + 1, F.lit(CONTENTS_WITHIN))
    return F.struct(
        F.least(*term_ends, F.lit(None).cast("int")).alias("term"),
        (indent + _found_end(opening, exclude)).alias("contents"),
    )


def _place(nodes: Column, ends: Column) -> Column:
    """Number of the text node in which each of the two ends falls."""
    nothing = F.lit(None).cast("int")
    start = F.struct(
        F.lit(0).alias("at"), nothing.alias("term"), nothing.alias("contents")
    )

    def step(seen: Column, node: Column) -> Column:
        end = seen["at"] + F.length(node["value"])
        return F.struct(
            (end + 1).alias("at"),
            F.coalesce(
                seen["term"], F.when(ends["term"] <= end, node["no"])
            ).alias("term"),
            F.coalesce(
                seen["contents"], F.when(ends["contents"] <= end, node["no"])
            ).alias("contents"),
        )

    return F.aggregate(nodes, start, step)


def _heading_of(
    elements: Column, parent: Column, terms: Sequence[str], exclude: str
) -> Column:
    """For one parent: after which text node its tables have a heading.

    The text before a table is a beginning of the text before a later table of
    the same parent, so one pass over the parent's text serves all of them.
    """
    nodes = F.transform(
        child_text_nodes(elements, parent),
        lambda t: F.struct(t["no"].alias("no"), F.lower(t["value"]).alias("value")),
    )
    return let(
        nodes,
        lambda ts: let(
            F.array_join(F.transform(ts, lambda t: t["value"]), " "),
            lambda heading: let(
                _heading_ends(heading, terms, exclude),
                lambda ends: let(
                    _place(ts, ends),
                    lambda place: F.struct(
                        parent["seq"].alias("parent_seq"),
                        place["term"].alias("term_no"),
                        place["contents"].alias("contents_no"),
                    ),
                ),
            ),
        ),
    )


def _identity(documents: DataFrame) -> list[str]:
    """Columns that name the document, without what was made from it."""
    made = ("selected", "tables", "sections")
    return [c for c in document_columns(documents) if c not in made]


def _is_table(node: Column) -> Column:
    return node["tag"] == XHTML + "table"


def select_tables(
    parsed: DataFrame,
    terms: Sequence[str] = HEADING_TERMS,
    exclude: str = CONTENTS_WORD,
) -> DataFrame:
    """Adds `selected`: table elements under a heading that holds a term.

    The heading is all text in the elements before the table under the same
    parent. A heading with the excluded word at its beginning does not count.
    """
    elements = F.col("elements")
    tables = F.filter(elements, _is_table)
    parents = F.array_distinct(
        F.filter(F.transform(tables, lambda t: t["parent_seq"]), lambda p: p >= 0)
    )
    headings = F.filter(
        F.transform(
            parents,
            lambda p: _heading_of(elements, F.get(elements, p), terms, exclude),
        ),
        lambda h: h["term_no"].isNotNull(),
    )

    def under_heading(table: Column, heading: Column) -> Column:
        return (
            (heading["parent_seq"] == table["parent_seq"])
            & (heading["term_no"] < table["text_no"])
            & ~F.coalesce(heading["contents_no"] < table["text_no"], F.lit(False))
        )

    selected = let(
        headings,
        lambda hs: F.filter(
            tables, lambda t: F.exists(hs, lambda h: under_heading(t, h))
        ),
    )
    return computed(parsed, selected=selected)


def with_cells(selected: DataFrame) -> DataFrame:
    """Adds `tables`: numbered selected tables, their rows and their cells.

    Rows are the direct `tr` children of a table and cells the direct `td`
    children of a row; a cell holds all text under it.
    """
    elements = F.col("elements")

    def row(tr: Column, at: Column) -> Column:
        cells = F.transform(
            children(elements, tr, XHTML + "td"), lambda td: inner_text(elements, td)
        )
        return F.struct((at + 1).alias("row_no"), cells.alias("cells"))

    def table(node: Column, at: Column) -> Column:
        rows = F.transform(children(elements, node, XHTML + "tr"), row)
        return F.struct((at + 1).alias("table_no"), rows.alias("rows"))

    return computed(selected, tables=F.transform("selected", table))


def table_cells(documents: DataFrame) -> DataFrame:
    """One row per cell: `table_no`, `row_no`, `col_no` (from 1) and `text`."""
    ids = _identity(documents)
    return (
        documents.select(*ids, F.explode("tables").alias("t"))
        .select(*ids, "t.table_no", F.explode("t.rows").alias("r"))
        .select(
            *ids,
            "table_no",
            "r.row_no",
            F.posexplode("r.cells").alias("col_no", "text"),
        )
        .withColumn("col_no", F.col("col_no") + 1)
    )


def with_sections(parsed: DataFrame, label: str = SECTION_LABEL) -> DataFrame:
    """Adds `sections`: for each element labelled so, the texts that follow it.

    A section is the text of the labelled element and of every element in its
    following siblings.
    """
    elements = F.col("elements")

    def is_label(node: Column) -> Column:
        own = F.coalesce(
            F.nullif(node["text"], F.lit("")),
            F.nullif(node["tail"], F.lit("")),
            F.lit("n/a"),
        )
        return strip(F.lower(own)) == label

    def section(node: Column) -> Column:
        nodes = F.concat(F.array(node), following_subtrees(elements, node))
        return F.transform(F.filter(nodes, is_element), text_else_tail)

    return computed(
        parsed, sections=F.transform(F.filter(elements, is_label), section)
    )


def sibling_sections(documents: DataFrame) -> DataFrame:
    """One row per section text: `section_no` (from 1), `pos` (from 0), `text`."""
    ids = _identity(documents)
    return (
        documents.select(*ids, F.posexplode("sections").alias("section_no", "s"))
        .select(*ids, "section_no", F.posexplode("s").alias("pos", "text"))
        .withColumn("section_no", F.col("section_no") + 1)
    )


def render(tables: Column) -> Column:
    """Tables as text: cells apart by tabs, rows by lines, tables by a divider."""

    def lines(table: Column) -> Column:
        filled = F.filter(table["rows"], lambda r: F.size(r["cells"]) > 0)
        return F.array_join(
            F.transform(
                filled, lambda r: F.array_join(F.transform(r["cells"], strip), "\t")
            ),
            "\n",
        )

    filled = F.filter(
        tables, lambda t: F.exists(t["rows"], lambda r: F.size(r["cells"]) > 0)
    )
    return F.array_join(F.transform(filled, lines), TABLE_GAP)


def has_cells(tables: Column) -> Column:
    return F.exists(
        tables, lambda t: F.exists(t["rows"], lambda r: F.size(r["cells"]) > 0)
    )


def render_tables(documents: DataFrame) -> DataFrame:
    """Documents with any cell, with `rendered` in place of their parts."""
    return (
        documents.filter(has_cells(F.col("tables")))
        .withColumn("rendered", render(F.col("tables")))
        .select(*_identity(documents), "rendered")
    )
