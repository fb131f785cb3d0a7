"""Axes of a document tree, as column functions on its `elements` array.

Elements lie in document order, so a subtree is a slice of the array. Every
axis is therefore a slice with a filter inside the document's own row: no join
and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filings.functions.text import strip

XHTML = "{http://www.w3.org/1999/xhtml}"


def is_element(node: Column) -> Column:
    return node["kind"] == "element"


def subtree(elements: Column, node: Column) -> Column:
    """The node and all its descendants."""
    return F.slice(
        elements, node["seq"] + 1, node["end_seq"] - node["seq"] + 1
    )


def descendants(elements: Column, node: Column) -> Column:
    return F.slice(elements, node["seq"] + 2, node["end_seq"] - node["seq"])


def children(elements: Column, node: Column, tag: str | None = None) -> Column:
    def wanted(child: Column) -> Column:
        named = is_element(child) if tag is None else child["tag"] == tag
        return (child["parent_seq"] == node["seq"]) & named

    return F.filter(descendants(elements, node), wanted)


def following_subtrees(elements: Column, node: Column) -> Column:
    """Following siblings of the node with all that lies under them."""
    parent_end = F.get(elements, node["parent_seq"])["end_seq"]
    after = F.slice(elements, node["end_seq"] + 2, parent_end - node["end_seq"])
    return F.when(node["parent_seq"] >= 0, after).otherwise(
        F.slice(elements, 1, 0)
    )


def ordered_text(texts: Column, tails: Column) -> Column:
    """Text nodes (no, value) in document order.

    `texts` are the nodes whose text belongs to the result, `tails` those whose
    tail does.
    """
    own = F.transform(
        F.filter(texts, lambda x: is_element(x) & x["text"].isNotNull()),
        lambda x: F.struct(x["text_no"].alias("no"), x["text"].alias("value")),
    )
    after = F.transform(
        F.filter(tails, lambda x: x["tail"].isNotNull()),
        lambda x: F.struct(x["tail_no"].alias("no"), x["tail"].alias("value")),
    )
    return F.sort_array(F.concat(own, after))


def inner_text(elements: Column, node: Column) -> Column:
    """All text under the node, run together without change."""
    nodes = ordered_text(subtree(elements, node), descendants(elements, node))
    return F.array_join(F.transform(nodes, lambda t: t["value"]), "")


def child_text_nodes(elements: Column, parent: Column) -> Column:
    """Text nodes inside the parent's child elements, not its own bare text."""
    below = descendants(elements, parent)
    return ordered_text(
        below, F.filter(below, lambda x: x["parent_seq"] != parent["seq"])
    )


def text_else_tail(node: Column) -> Column:
    """Stripped text or, where that is empty, stripped tail."""
    return F.coalesce(
        F.nullif(strip(node["text"]), F.lit("")), strip(node["tail"]), F.lit("")
    )


def is_own_style(node: Column) -> Column:
    """The node itself is a style element."""
    return is_element(node) & F.upper(node["qname"]).startswith("STYLE")


def has_text(node: Column) -> Column:
    return node["text"].isNotNull() | node["tail"].isNotNull()


def style_filter(node: Column, rule: str | None) -> Column:
    """Whether the style rule keeps the node.

    `first_line`: the first line of the node written out as markup (descendants
    and tail included) must not hold the word "style". `own_tag`: the node must
    not be a style element itself.
    """
    if rule is None:
        return F.lit(True)
    if rule == "first_line":
        return ~node["style_first_line"]
    if rule == "own_tag":
        return ~is_own_style(node)
    raise ValueError(f"unknown style rule: {rule}")
