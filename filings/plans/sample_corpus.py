"""Well-formed filings written by Spark from relational tables.

Each builder turns rows into documents with column expressions alone, so that
a corpus of known content can be made at any scale and parsed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.operators.envelope import ENVELOPE_NS

XHTML_ROOT = '<html xmlns="http://www.w3.org/1999/xhtml">'

# Heading of the first table of an order page, by order priority.
HEADINGS = {
    "1-URGENT": "Adjustment of Profit",
    "2-HIGH": "Contents: adjustment of profit",
    "3-MEDIUM": "Tax Reconciliation",
    "4-NOT SPECIFIED": "Balance sheet",
    "5-LOW": "Income Statement",
}
TAXATION_YEAR = {"F": "5", "O": "20", "P": "2017"}


def escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def chosen(key: Column, values: dict[str, str]) -> Column:
    """The value listed for the key."""
    out = F.lit(None).cast("string")
    for name, value in values.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def cents(amount: str) -> Column:
    return F.round(F.col(amount) * 100).cast("long").cast("string")


def iso_date(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


def _concat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def order_page() -> Column:
    """Tax computation of an order, with tables and sections."""
    heading = chosen(F.col("o_orderpriority"), HEADINGS)
    gap = F.when(F.col("o_orderstatus") == "F", "").otherwise("\n")
    return _concat(
        XHTML_ROOT,
        "<head><title>Order ",
        F.col("o_orderkey").cast("string"),
        "</title>",
        gap,
        '<style type="text/css">td {}</style></head>\n<body>\n<div><h2>',
        heading,
        "</h2>\n<!-- filed -->\n<table><tr><th>Item</th><th>Value</th></tr>"
        "<tr><td>Status</td><td> <b>",
        F.col("o_orderstatus"),
        "</b> as filed</td></tr><tr><td>Price</td><td>",
        cents("o_totalprice"),
        "</td><td/></tr></table>\n<p>Priority <i>",
        F.col("o_orderpriority"),
        "</i></p></div>\n<div><p>Due</p><table><tr><td>",
        iso_date("o_orderdate"),
        "</td></tr></table></div>\n<div><h3>Adjustment of Profit</h3><p>Customer ",
        F.col("o_custkey").cast("string"),
        "</p><table><tbody><tr><td>hidden</td></tr></tbody><tr><td>Tax</td><td>",
        iso_date("o_orderdate"),
        "</td></tr></table></div>\n</body></html>",
    )


def item_page() -> Column:
    """Tax computation of an order with a row for each of its line items.

    Rows are ragged: the tax is left out where there is none, and every third
    row has a nested table. An order without items has an empty table.
    """

    def row(item: Column) -> Column:
        tax = F.when(item["tax"] > 0, _concat("<td>", item["tax"].cast("string"), "</td>"))
        nested = _concat(
            "<td>see <table><tr><td>", item["no"].cast("string"), "</td></tr></table></td>"
        )
        return _concat(
            "<tr><td>",
            item["no"].cast("string"),
            "</td><td>",
            item["quantity"].cast("string"),
            "</td>",
            F.coalesce(tax, F.lit("")),
            F.when(item["no"] % 3 == 0, nested).otherwise(""),
            "</tr>",
        )

    return _concat(
        XHTML_ROOT,
        "<body><p>Tax reconciliation</p><table>",
        F.array_join(F.transform("items", row), "\n"),
        "</table></body></html>",
    )


def orders_with_items(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders with `items`, by line number; an order has a handful of them."""
    item = F.struct(
        F.col("l_linenumber").alias("no"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.round(F.col("l_tax") * 100).cast("long").alias("tax"),
    )
    listed = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_list(item)).alias("items")
    )
    none = F.array().cast("array<struct<no:int,quantity:bigint,tax:bigint>>")
    return orders.join(listed, "o_orderkey", "left").withColumn(
        "items", F.coalesce("items", none)
    )


def item_pages(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return orders_with_items(orders, lineitem).select(
        F.col("o_orderkey").alias("doc_id"), F.encode(item_page(), "UTF-8").alias("content")
    )


def item_envelopes(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Submission of each order, with its item page attached."""
    encoded = F.base64(F.encode(item_page(), "UTF-8"))
    envelope = _concat(
        f'<env:Envelope xmlns:env="{ENVELOPE_NS}"><env:Key>',
        F.col("o_custkey").cast("string"),
        '</env:Key><C xmlns="http://www.govtalk.gov.uk/taxation/CT/9"><To>',
        iso_date("o_orderdate"),
        "</To><IRmark>IR",
        F.col("o_orderkey").cast("string"),
        "</IRmark><Computation><Instance><F>",
        encoded,
        "</F></Instance></Computation></C></env:Envelope>",
    )
    return orders_with_items(orders, lineitem).select(
        _concat("order/", F.col("o_orderkey").cast("string")).alias("path"),
        F.encode(envelope, "UTF-8").alias("content"),
    )


def segment_text() -> Column:
    """Prose of a customer: a sentence that the market segment decides."""
    return _concat("all in the ", F.lower("c_mktsegment"), " trade sell their own goods")


def segment_pages(customers: DataFrame) -> DataFrame:
    page = _concat("<html>\n<p>", segment_text(), "</p></html>")
    return customers.select(
        F.col("c_custkey").alias("doc_id"), F.encode(page, "UTF-8").alias("content")
    )


def mixed_files(customers: DataFrame) -> DataFrame:
    """A page of each customer: by nation whole, cut off, or with an unknown entity."""
    whole = _concat("<html><p>", escaped(F.col("c_name")), "</p></html>")
    cut = _concat("<html><p>", escaped(F.col("c_name")))
    unknown = _concat("<html><p>", escaped(F.col("c_name")), "&unknown;</p></html>")
    by = F.col("c_nationkey") % 3
    page = F.when(by == 0, whole).when(by == 1, cut).otherwise(unknown)
    return customers.select(
        F.col("c_custkey").alias("doc_id"), F.encode(page, "UTF-8").alias("content")
    )


def order_pages(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("doc_id"),
        F.encode(order_page(), "UTF-8").alias("content"),
    )


def order_envelopes(orders: DataFrame) -> DataFrame:
    """Submission of each order: taxpayer is the customer, mark is the order.

    By status an envelope holds one encoded page (F), one encoded page, an
    empty one and one that is not base64 (O), or an inline page (P). The
    priority "4-NOT SPECIFIED" has no attachment.
    """
    encoded = F.base64(F.encode(order_page(), "UTF-8"))
    file = lambda *inner: ("<Instance><EncodedInlineXBRL>", *inner, "</EncodedInlineXBRL></Instance>")
    body = (
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "")
        .when(F.col("o_orderstatus") == "F", _concat(*file(encoded)))
        .when(
            F.col("o_orderstatus") == "O",
            _concat(*file(encoded), *file("0"), *file("x")),
        )
        .otherwise(
            _concat("<Instance><InlineXBRL>", order_page(), "</InlineXBRL></Instance>")
        )
    )
    envelope = _concat(
        f'<env:Envelope xmlns:env="{ENVELOPE_NS}">'
        '<env:Keys><env:Key Type="UTR">',
        F.col("o_custkey").cast("string"),
        "</env:Key><env:Key>other</env:Key></env:Keys>\n"
        '<IRenvelope xmlns="http://www.govtalk.gov.uk/taxation/CT/',
        chosen(F.col("o_orderstatus"), TAXATION_YEAR),
        '"><PeriodCovered><From>1990-01-01</From><To>',
        iso_date("o_orderdate"),
        '</To></PeriodCovered><IRmark Type="generic">IR',
        F.col("o_orderkey").cast("string"),
        "</IRmark><Computation>",
        body,
        "</Computation><Accounts><Instance><F>QQ==</F></Instance></Accounts>"
        "</IRenvelope></env:Envelope>",
    )
    return orders.select(
        _concat("order/", F.col("o_orderkey").cast("string")).alias("path"),
        F.encode(envelope, "UTF-8").alias("content"),
    )


def customer_pages(customers: DataFrame) -> DataFrame:
    """Accounts of a customer: prose with and without tags.

    A customer in credit restates the first sentence under a tag.
    """
    name = escaped(F.col("c_name"))
    restated = F.when(F.col("c_acctbal") >= 0, "Statement").otherwise("Report")
    page = _concat(
        '<html xmlns="http://www.w3.org/1999/xhtml"'
        ' xmlns:ix="http://www.xbrl.org/2008/inlineXBRL"><body>\n<p>Statement of ',
        name,
        " for the period ended</p>\n"
        '<ix:nonNumeric NAME="uk:Segment" contextRef="n',
        F.col("c_nationkey").cast("string"),
        '">Business of ',
        name,
        " is in the segment ",
        F.col("c_mktsegment"),
        "</ix:nonNumeric> and these words stand after the tag\n"
        '<span class="x">Balance of ',
        name,
        " stands at ",
        cents("c_acctbal"),
        " pence</span>\n<b>short</b>\n"
        '<ix:nonFraction name="uk:Balance" CONTEXTREF="now">',
        restated,
        " of ",
        name,
        " for the period ended, restated</ix:nonFraction>\n</body></html>",
    )
    return customers.select(
        F.col("c_custkey").alias("doc_id"), F.encode(page, "UTF-8").alias("content")
    )


def footer_page(text: Column, nested: bool = False) -> Column:
    """Page with every line of the text as a paragraph of its footer."""
    paragraphs = F.transform(
        F.split(text, "\n"), lambda line: _concat("<p>", escaped(line), "</p>")
    )
    inner = F.array_join(paragraphs, "\n")
    if nested:
        inner = _concat('<div class="x footnote">', inner, "</div>\n")
    return _concat(
        XHTML_ROOT,
        "<head>\n<style>p {}</style></head><body>\n"
        '<p class="Foot">This line belongs to the page and to no footer at all</p>\n'
        '<div class="page-footer">',
        inner,
        "</div>\n</body></html>",
    )


def prose_pages(documents: DataFrame) -> DataFrame:
    """Page of every document with a paragraph for each line."""
    paragraphs = F.transform(
        F.split("text", "\n"), lambda line: _concat("<p>", escaped(line), "</p>")
    )
    page = _concat(XHTML_ROOT, "<body>\n", F.array_join(paragraphs, "\n"), "\n</body></html>")
    return documents.select("doc_id", F.encode(page, "UTF-8").alias("content"))


def footer_pages(documents: DataFrame, nested: bool = False) -> DataFrame:
    return documents.select(
        "doc_id",
        F.encode(footer_page(F.col("text"), nested), "UTF-8").alias("content"),
    )


def footer_envelopes(documents: DataFrame) -> DataFrame:
    """One submission per document, its source being the receipt mark."""
    encoded = F.base64(F.encode(footer_page(F.col("text")), "UTF-8"))
    envelope = _concat(
        f'<env:Envelope xmlns:env="{ENVELOPE_NS}">'
        '<C xmlns="http://www.govtalk.gov.uk/taxation/CT/3"><IRmark>',
        F.col("source"),
        "</IRmark><Computation><Instance><F>",
        encoded,
        "</F></Instance></Computation></C></env:Envelope>",
    )
    return documents.select(
        _concat(F.col("source"), "/", F.col("doc_id").cast("string")).alias("path"),
        F.encode(envelope, "UTF-8").alias("content"),
    )
