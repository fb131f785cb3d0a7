"""Parser, element rows, style rules, quarantine and footers."""

import random
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from filings.operators import markup
from filings.operators.markup import (
    footer_subtrees,
    parse_elements,
    parse_markup,
    quarantine,
    well_formed,
)

X = "{http://www.w3.org/1999/xhtml}"


def parse(spark, *sources, **options):
    rows = [(n, s.encode() if isinstance(s, str) else s) for n, s in enumerate(sources)]
    return parse_markup(
        spark.createDataFrame(rows, "doc_id int, content binary"), **options
    )


def nodes(spark, source, **options):
    (row,) = parse(spark, source, **options).collect()
    assert row.error is None
    return row.elements


def test_mixed_content_keeps_text_tail_and_order(spark):
    a, b, c = nodes(spark, "<a x='1'>t1<b>q</b>t2<c/>t3</a>")
    assert (a.text, a.tail, a.attrs) == ("t1", None, {"x": "1"})
    assert (b.text, b.tail) == ("q", "t2")
    assert (c.text, c.tail) == (None, "t3")
    assert [(n.seq, n.end_seq, n.parent_seq, n.depth) for n in (a, b, c)] == [
        (0, 2, -1, 0),
        (1, 1, 0, 1),
        (2, 2, 0, 1),
    ]
    assert (a.text_no, b.text_no, b.tail_no, c.tail_no) == (0, 1, 2, 3)


def test_comments_instructions_and_entities_are_nodes(spark):
    source = (
        '<!DOCTYPE html PUBLIC "p" "s"><!-- outside -->'
        "<a>x<!--note-->y<?go now?>z&nbsp;w<b>&amp;<![CDATA[<q>]]></b></a>"
    )
    found = [(n.kind, n.text, n.tail) for n in nodes(spark, source)]
    assert found == [
        ("element", "x", None),
        ("comment", "note", "y"),
        ("pi", "now", "z"),
        ("entity", "&nbsp;", "w"),
        ("element", "&<q>", None),
    ]


def test_namespaces(spark):
    source = (
        f'<h:a xmlns:h="u:h" xmlns="u:d" h:k="1" K="2"><b xmlns="u:e"/></h:a>'
    )
    (row,) = parse(spark, source).collect()
    a, b = row.elements
    assert (a.tag, a.qname, a.attrs) == ("{u:h}a", "h:a", {"{u:h}k": "1", "K": "2"})
    assert (b.tag, b.qname) == ("{u:e}b", "b")
    assert row.nsmap == {"h": "u:h", "": "u:d"}


@pytest.mark.parametrize(
    "source, dropped",
    [
        # One line: every ancestor of the style element goes with it.
        ("<a><b>x</b><style>s</style></a>", ["a", "style"]),
        # The style element starts on the second line.
        ("<a>1\n<style>s</style><b>x</b></a>", ["style"]),
        ("<a>\n<b style='color:red'>x</b></a>", ["b"]),
        # The tail of b holds the word on its first line.
        ("<a>\n<b>x</b> Life style</a>", ["b"]),
        ("<a>\n<b>x</b> life\nstyle</a>", []),
        # A start tag is written on one line, whatever the source did.
        ("<a>\n<b\nclass='y'\nstyle='z'>x</b></a>", ["b"]),
        ("<a>\n<b><i>q</i> sty<u>le</u></b></a>", []),
        ("<a>\n<!-- my style --> t</a>", ["comment"]),
        ("<a xmlns:p='u:style'>\n<b>x</b></a>", ["a", "b"]),
        ("<a>\n<b xmlns:p='u:style'>x</b><c>y</c></a>", ["b"]),
    ],
)
def test_first_line_style_rule(spark, source, dropped):
    flags = [
        n.qname or n.kind for n in nodes(spark, source) if n.style_first_line
    ]
    assert flags == dropped


def test_own_tag_style_rule(spark):
    parsed = parse(spark, "<a>t<style>s</style><b style='q'>x</b><h:style xmlns:h='u'>y</h:style></a>")
    kept = parse_elements(parsed, "own_tag").collect()
    assert [n.qname for n in kept] == ["a", "b", "h:style"]


def test_element_rows_are_stripped_and_need_text(spark):
    parsed = parse(spark, "<a>  x \n<b/><c>  </c></a>")
    rows = parse_elements(parsed, columns=["seq", "text", "tail"]).collect()
    assert [tuple(r) for r in rows] == [(0, 0, "x", None), (0, 2, "", None)]


def test_malformed_documents_are_quarantined(spark):
    parsed = parse(
        spark, "<a>ok</a>", "<a>&nbsp;</a>", "<a><b></a>", "", None, b"<a>\xff</a>"
    )
    bad = quarantine(parsed).collect()
    assert [r.doc_id for r in bad] == [1, 2, 3, 4, 5]
    assert all(r.error for r in bad)
    assert [r.doc_id for r in well_formed(parsed).collect()] == [0]


def test_declared_encodings(spark):
    latin = '<?xml version="1.0" encoding="iso-8859-1"?><a>é</a>'.encode("latin-1")
    cp = '<?xml version="1.0" encoding="windows-1252"?><a>€</a>'.encode("cp1252")
    wide = '<?xml version="1.0" encoding="utf-16"?><a>é</a>'.encode("utf-16")
    rows = parse(spark, latin, cp, wide, "﻿<a>ü</a>").collect()
    assert [r.elements[0].text for r in rows] == ["é", "€", "é", "ü"]


def test_string_content_and_many_batches(spark):
    pages = spark.range(3000).select(
        "id", F.format_string("<a>%d<b/>%d</a>", "id", "id").alias("page")
    )
    parsed = parse_markup(pages, "page")
    rows = parsed.select("id", F.col("elements")[1]["tail"].alias("t")).collect()
    assert sorted((r.id, r.t) for r in rows) == [(i, str(i)) for i in range(3000)]


def test_kept_markup_declares_the_namespaces_in_scope(spark):
    source = (
        "<r xmlns='u:r' xmlns:p='u:p'><Instance>"
        "<f><p:x k='a&quot;&lt;'>1 &amp; 2<q/>\n <!--c--></p:x> </f><f>text</f>"
        "</Instance></r>"
    )
    kept = [n.xml for n in nodes(spark, source, keep_xml_under="Instance") if n.xml]
    assert kept == [
        '<p:x xmlns="u:r" xmlns:p="u:p" k="a&quot;&lt;">1 &amp; 2<q></q>\n <!--c--></p:x> '
    ]
    (again,) = [nodes(spark, kept[0].strip())]
    assert [n.tag for n in again] == ["{u:p}x", "{u:r}q", None]


def test_footers_emit_nested_anchors_twice_and_skip_comments(spark):
    source = (
        "<a>\n<div class='page-footer'>one<p>two</p><!--c-->"
        "<i class='foot'>three</i></div><b class='Foot'>no</b>"
        "<style class='foot'>no</style><u class='foot'/></a>"
    )
    rows = (
        footer_subtrees(parse(spark, source))
        .select(F.inline("subtrees"))
        .select("anchor_seq", "element.text")
        .collect()
    )
    assert [tuple(r) for r in rows] == [
        (1, "one"), (1, "two"), (1, "three"), (4, "three"),
    ]


def random_document(rng, depth=0):
    words = ["style", "STYLE ", "\n", "t", " ", "a&amp;b", "sty", "le", "<!--style-->", "<!--\nc-->", "<?p style?>"]
    text = lambda: "".join(rng.choice(words) for _ in range(rng.randint(0, 2)))
    attribute = rng.choice(["", "", " k='1'", " style='x'", "\nk='a&#10;style'"])
    children = rng.randint(0, 3) if depth < 4 else 0
    inner = "".join(random_document(rng, depth + 1) + text() for _ in range(children))
    name = rng.choice("abc")
    return f"<{name}{attribute}>{text()}{inner}</{name}>"


def test_trees_and_style_flags_agree_with_the_standard_library(spark):
    rng = random.Random(11)
    sources = [random_document(rng) for _ in range(200)]
    rows = sorted(parse(spark, *sources).collect(), key=lambda r: r.doc_id)
    flagged = 0
    for source, row in zip(sources, rows):
        builder = ElementTree.TreeBuilder(insert_comments=True, insert_pis=True)
        parser = ElementTree.XMLParser(target=builder)
        root = ElementTree.fromstring(source, parser)
        wanted = list(root.iter())
        assert len(wanted) == len(row.elements)
        for ours, theirs in zip(row.elements, wanted):
            if ours.kind == "element":
                assert (ours.tag, ours.attrs) == (theirs.tag, theirs.attrib)
                assert (ours.text or "") == (theirs.text or "")
            assert (ours.tail or "") == (theirs.tail or "")
            assert ours.end_seq - ours.seq == sum(1 for _ in theirs.iter()) - 1
            line = ElementTree.tostring(theirs, "unicode").split("\n")[0].lower()
            assert ours.style_first_line == ("style" in line), (source, ours.seq)
            flagged += ours.style_first_line
    assert flagged > 100


def test_batches_are_split_at_document_bounds(spark, monkeypatch):
    monkeypatch.setattr(markup, "_BATCH_ELEMENTS", 7)
    pages = spark.range(500).coalesce(1).select(
        "id", F.concat(F.lit("<a><b/><c/>"), F.col("id").cast("string"), F.lit("</a>")).alias("page")
    )
    rows = parse_markup(pages, "page", fields=("text", "tail")).collect()
    assert [(r.id, r.elements[2].tail) for r in rows] == [(i, str(i)) for i in range(500)]
    assert rows[0].elements[0].asDict() == {"text": None, "tail": None}


def test_documents_of_a_batch_share_names_and_a_broken_one_leaves_no_node(spark):
    pages = [
        b"<a x='1'><b>t</b>u<!--c--><?p q?></a>", b"<a><b>lost<", None, b"<n:a xmlns:n='N'><b n:x='2'/></n:a>",
        b"<a><style>s</style></a>",
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "doc_id int, content binary").coalesce(1)
    parsed = {r.doc_id: r for r in parse_markup(rows).collect()}
    alone = {r.doc_id: r for i in range(len(pages)) for r in parse_markup(rows.filter(f"doc_id = {i}")).collect()}
    assert parsed == alone and parsed[2].error == "no content" and parsed[1].elements is not None
    assert [len(parsed[i].elements) for i in range(5)] == [4, 0, 0, 2, 2]
    assert [e.tag for e in parsed[3].elements] == ["{N}a", "b"] and parsed[3].elements[1].attrs == {"{N}x": "2"}
    assert [e.seq for e in parsed[0].elements] == [0, 1, 2, 3] and parsed[4].elements[1].style_first_line
