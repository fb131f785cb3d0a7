"""Tables, headings, sections and rendering."""

import csv
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from filings.functions.tree import XHTML
from filings.operators.markup import parse_markup
from filings.operators.tables import (
    DIVIDER,
    HEADING_TERMS,
    has_cells,
    render_tables,
    select_tables,
    sibling_sections,
    table_cells,
    with_cells,
    with_sections,
)
from filings.schemas import TABLE_FIELDS
from filings.sinks.export import csv_text

ROOT = '<html xmlns="http://www.w3.org/1999/xhtml">'


def parsed(spark, *bodies):
    rows = [(n, f"{ROOT}{body}</html>") for n, body in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "doc_id int, content string")
    return parse_markup(pages, fields=TABLE_FIELDS)


def table(word="x"):
    return f"<table><tr><td>{word}</td></tr></table>"


def selected_words(spark, body):
    cells = table_cells(with_cells(select_tables(parsed(spark, body))))
    return [r.text for r in cells.orderBy("table_no", "row_no", "col_no").collect()]


@pytest.mark.parametrize(
    "body, words",
    [
        (f"<p>Tax RECONCILIATION</p>{table()}", ["x"]),
        (f"<p>Balance</p>{table()}", []),
        # Bare text beside the table is not a heading; text inside a sibling is.
        (f"tax reconciliation {table()}", []),
        (f"<p/>tax reconciliation {table()}", []),
        (f"<p><b><i>tax reconciliation</i></b></p>{table()}", ["x"]),
        (f"<p><b/>tax reconciliation</p>{table()}", ["x"]),
        # Neighbouring text nodes are joined by a space.
        (f"<p>tax</p><p>reconciliation</p>{table()}", ["x"]),
        (f"<p>tax<!-- c -->reconciliation</p>{table()}", ["x"]),
        (f"<!-- tax reconciliation -->{table()}", []),
        (f"<p>tax re</p><p>conciliation</p>{table()}", []),
        # A heading after the table does not count, one under another parent neither.
        (f"{table()}<p>tax reconciliation</p>", []),
        (f"<div><p>tax reconciliation</p></div><div>{table()}</div>", []),
        (f"<p>tax reconciliation</p><div>{table()}</div>", []),
        # All tables after it count, and the text of a table is a heading, too.
        (f"{table('a')}<p>income statement</p>{table('b')}<p>q</p>{table('c')}", ["b", "c"]),
        (f"{table('losses and allowances')}{table('b')}", ["b"]),
        # A contents page: the word lies within the first 20 characters.
        (f"<p> \n Contents tax reconciliation</p>{table()}", []),
        (f"<p>1234567890123content tax reconciliation</p>{table()}", []),
        (f"<p>12345678901234content tax reconciliation</p>{table()}", ["x"]),
        (f"<p>con</p>{table('a')}<p>tent income statement</p>{table('b')}", ["b"]),
        (f"<p>con</p><p>tax reconciliation</p>{table('a')}", ["a"]),
    ],
)
def test_headings(spark, body, words):
    assert selected_words(spark, body) == words


def test_heading_agrees_with_a_plain_search(spark):
    """Random pages against the text before each table, searched on its own."""
    rng = random.Random(5)
    words = ["tax", "reconciliation", "tax reconciliation", "income", "statement",
             "contents", "content", " ", "İ", "filler words here", "adjustment of loss"]

    def block(depth):
        kind = rng.random()
        if kind < 0.3 or depth > 3:
            return f"<p>{rng.choice(words)}</p>{rng.choice(words)}"
        if kind < 0.6:
            return table(rng.choice(words))
        inner = "".join(block(depth + 1) for _ in range(rng.randint(1, 4)))
        return f"<div>{rng.choice(words)}{inner}</div><!--{rng.choice(words)}-->"

    bodies = ["".join(block(0) for _ in range(5)) for _ in range(60)]
    rows = select_tables(parsed(spark, *bodies)).collect()
    terms = "|".join(HEADING_TERMS)
    found = expected = 0
    for row in rows:
        wanted = []
        for node in row.elements:
            if node.tag != XHTML + "table" or node.parent_seq < 0:
                continue
            texts = []
            for other in row.elements[node.parent_seq + 1 : node.seq]:
                if other.kind == "element" and other.text is not None:
                    texts.append((other.text_no, other.text))
                if other.parent_seq != node.parent_seq and other.tail is not None:
                    texts.append((other.tail_no, other.tail))
            heading = " ".join(t for _, t in sorted(texts)).lower()
            if re.search(terms, heading) and "content" not in heading.strip()[:20]:
                wanted.append(node.seq)
        assert [n.seq for n in row.selected] == wanted
        found += len(row.selected)
        expected += len(wanted)
    assert found == expected > 20


def test_cells_are_direct_children(spark):
    body = (
        "<p>income statement</p><table><thead><tr><td>no</td></tr></thead>"
        "<tr><th>no</th></tr><tr><td> a <b>b</b><!--c--> d</td><th>no</th><td/></tr>"
        "<tr><td><table><tr><td>in</td></tr></table></td></tr></table>"
    )
    rows = table_cells(with_cells(select_tables(parsed(spark, body)))).collect()
    assert [(r.table_no, r.row_no, r.col_no, r.text) for r in rows] == [
        (1, 2, 1, " a b d"),
        (1, 2, 2, ""),
        (1, 3, 1, "in"),
    ]


def test_sections(spark):
    body = (
        "<p>before</p><h2> Adjustment of PROFIT\n</h2><!--c-->x<p>one</p>"
        "<div><b/> two <i>three</i></div><u>adjustment of profit</u> tail"
    )
    rows = sibling_sections(with_sections(parsed(spark, body))).collect()
    assert [(r.section_no, r.pos, r.text) for r in rows] == [
        (1, 0, "Adjustment of PROFIT"),
        (1, 1, "one"),
        (1, 2, ""),
        (1, 3, "two"),
        (1, 4, "three"),
        (1, 5, "adjustment of profit"),
        (2, 0, "adjustment of profit"),
    ]


def test_label_in_a_tail_in_a_comment_and_on_the_root(spark):
    body = "<b/>Adjustment of profit<p>q</p><!--adjustment of profit--><p>r</p>"
    rows = sibling_sections(with_sections(parsed(spark, body))).collect()
    assert [(r.section_no, r.text) for r in rows] == [
        (1, "Adjustment of profit"), (1, "q"), (1, "r"), (2, "r"),
    ]
    rows = sibling_sections(with_sections(parsed(spark, "adjustment of profit"))).collect()
    assert [(r.section_no, r.text) for r in rows] == [(1, "adjustment of profit")]


def test_rendering_drops_empty_rows_and_documents(spark):
    body = (
        "<p>income statement</p><table><tr/><tr><td> a </td><td>b,c</td></tr></table>"
        "<table><tr><th>q</th></tr></table><table><tr><td>d\"e</td></tr><tr><td/></tr></table>"
    )
    cells = with_cells(select_tables(parsed(spark, body, "<p>none</p>")))
    assert cells.filter(has_cells(F.col("tables"))).count() == 1
    (row,) = render_tables(cells).collect()
    assert row.rendered == f'a\tb,c\n\n\n{DIVIDER}\n\n\nd"e\n'
    (line,) = render_tables(cells).select(csv_text(F.col("rendered"))).first()
    written = io.StringIO()
    csv.writer(written).writerows([x.split("\t") for x in row.rendered.split("\n")])
    assert line + "\r\n" == written.getvalue()
