"""Axes and tables of documents whose nodes are rows, not an array in one row.

Nodes have preorder numbers, so the subtree of a node is the range from `seq` to
`end_seq`, and ranges of two nodes lie one in the other or apart. A structural
join finds, for anchors, the places in their ranges. The places of a document are
cut into splits of `SPLIT`; an anchor is carried to every split that its range
reaches, which is one more row for each `SPLIT` places that it holds. Within a
split places are sorted, so those of an anchor are one run of them, found by two
binary searches. A document of any size is then joined by many tasks, and none
holds more than a few splits and the anchors over them.

Rows of a document that lie together in a partition, as the parser leaves them, need
no such join: ranges are slices of them. `in_place` does the work there, in one pass
that stores its results, and hands on what is cut by a partition's end, out of order
or longer than a split. Only that is shuffled.

Results are the rows of the operators of `markup` and `tables` of like names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filings.functions.text import SPACE_CHARS, strip
from filings.functions.tree import XHTML, is_element
from filings.operators.computed import computed
from filings.operators.markup import is_footer
from filings.operators.storage import materialise
from filings.operators.tables import (
    CONTENTS_WORD,
    HEADING_TERMS,
    SECTION_LABEL,
    _heading_ends,
    _place,
    select_tables,
    sibling_sections,
    table_cells,
    with_cells,
    with_sections,
)

# Places in a split.
SPLIT = 50_000


def _node(rows: DataFrame) -> Column:
    """The row as a node, for conditions that are written for arrays of nodes."""
    return F.struct(*[rows[name].alias(name) for name in rows.columns])


def within(
    anchors: DataFrame, places: DataFrame, keys: Sequence[str], split: int = SPLIT
) -> DataFrame:
    """Every place with every anchor whose range holds it.

    `anchors` has the keys, `low`, `high` and other columns; `places` has the
    keys, `at` and other columns of other names. A place is held if
    low < at <= high. Keys are not null.
    """
    carried = [f for f in anchors.schema.fields if f.name not in (*keys, "low", "high")]
    own = [f for f in places.schema.fields if f.name not in (*keys, "at")]
    first, last = F.floor((F.col("low") + 1) / split), F.floor(F.col("high") / split)
    reached = anchors.filter("low < high").withColumn("_split", F.explode(F.sequence(first, last)))
    # Aliases, as both sides may come from one table.
    laid = places.select(*[F.col(name).alias(name) for name in places.columns])
    laid = laid.withColumn("_split", F.floor(F.col("at") / split))
    group = [*keys, "_split"]
    # Splits of small documents share a task, about `split` places in all.
    tasks = max(1, math.ceil(places.count() / split))
    task = F.pmod(F.xxhash64(*group), F.lit(tasks)).alias("_task")
    reached, laid = reached.select("*", task), laid.select("*", task)
    schema = T.StructType([*(places.schema[k] for k in keys), *carried, places.schema["at"], *own])
    mine, theirs = [f.name for f in carried], [*keys, "at", *(f.name for f in own)]

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        # Places of one split lie apart from those of others.
        every = pa.concat_tables([left.select(group), right.select(group)])
        number = _numbers(every, group) << 40
        ints = lambda table, name: table[name].to_numpy().astype(np.int64)
        bases, at = number[: len(left)], number[len(left) :] + ints(right, "at")
        order = np.argsort(at, kind="stable")
        at = at[order]
        low = np.searchsorted(at, bases + ints(left, "low"), "right")
        n = np.maximum(np.searchsorted(at, bases + ints(left, "high"), "right") - low, 0)
        rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        found = left.select(mine).take(pa.array(np.repeat(np.arange(len(left)), n)))
        right = right.select(theirs).take(pa.array(order[rows]))
        columns = dict(zip(mine, found.columns, strict=True)) | dict(zip(theirs, right.columns, strict=True))
        return pa.table({name: columns[name] for name in schema.names})

    return reached.groupBy("_task").cogroup(laid.groupBy("_task")).applyInArrow(held, schema)


def _numbers(rows: pa.Table, names: Sequence[str]) -> np.ndarray:
    """A number for each row, equal where all the named columns are."""
    out = np.zeros(len(rows), dtype=np.int64)
    for name in names:
        codes = rows[name].combine_chunks().dictionary_encode().indices
        codes = codes.to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.unique(out * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)[1]
    return out


def _runs(keys: Sequence[str], fields: Sequence[str], most: int):
    """Consecutive rows of a document as one row each, and whether that is all of it."""

    def packed(rows: pa.Table, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(starts) == 0:
            return
        rows = rows.slice(starts[0], ends[-1] - starts[0]).combine_chunks()
        offsets = np.append(starts, ends[-1]) - starts[0]
        nodes = [rows[name].combine_chunks() for name in fields]
        columns = {name: rows[name].combine_chunks().take(pa.array(offsets[:-1])) for name in keys}
        columns["whole"] = pa.array(whole)
        structs = pa.StructArray.from_arrays(nodes, list(fields))
        columns["elements"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)
        yield pa.RecordBatch.from_pydict(columns)

    def cut(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs, whether they are whole documents, and their nodes in all."""
        seq, number = rows["seq"].to_numpy(), _numbers(rows, keys)
        new = (np.diff(seq) != 1) | (np.diff(number) != 0) | (seq[1:] == 0)
        starts = np.append(0, np.flatnonzero(new) + 1)
        ends = np.append(starts[1:], len(seq))
        # The first node is the root, and its end is that of the document.
        size = np.where(seq[starts] == 0, rows["end_seq"].to_numpy()[starts] + 1, most + 1)
        return starts, ends, (ends - starts == size) & (size <= most), size

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            starts, ends, whole, size = cut(rows)
            # The last document may go on in the next batch.
            goes_on = size[-1] <= most and ends[-1] - starts[-1] < size[-1]
            held = rows.slice(starts[-1]) if goes_on else None
            done = len(starts) - goes_on
            yield from packed(rows, starts[:done], ends[:done], whole[:done])
        if held is not None:
            starts, ends, whole, _ = cut(held)
            yield from packed(held, starts, ends, whole)

    return gather


def in_place(
    nodes: DataFrame, keys: Sequence[str], made: Callable[[DataFrame], DataFrame], name: str, most: int = SPLIT
) -> tuple[DataFrame, DataFrame]:
    """The column `name` that `made` adds to documents (keys, `elements`), and the nodes of the others.

    A document is made where its rows lie if they follow one another and are at most
    `most`. Both results are read from one stored table, written in one pass, so each
    node is in one of them however a later scan cuts its files. It holds what was made,
    and no nodes but those of the others.
    """
    fields = [f for f in nodes.schema.fields if f.name not in keys]
    schema = T.StructType([
        *(nodes.schema[k] for k in keys), T.StructField("whole", T.BooleanType()),
        T.StructField("elements", T.ArrayType(T.StructType(fields))),
    ])
    runs = nodes.mapInArrow(_runs(keys, [f.name for f in fields], most), schema)
    others = F.when(~F.col("whole"), F.col("elements"))
    elements = F.when(F.col("whole"), F.col("elements")).otherwise(F.array().cast(schema["elements"].dataType))
    documents = made(computed(runs, others=others, elements=elements))
    stored = materialise(documents.select(*keys, name, "others"), name)
    rest = stored.filter("others IS NOT NULL").select(*keys, F.inline("others"))
    return stored.filter("others IS NULL").select(*keys, name), rest


def descendants(
    anchors: DataFrame, nodes: DataFrame, keys: Sequence[str], fields: Sequence[str], itself: bool = False
) -> DataFrame:
    """keys, `anchor_seq`, `seq` and other fields of every node under each anchor."""
    low = F.col("seq") - (1 if itself else 0)
    ranges = anchors.select(*keys, low.alias("low"), F.col("end_seq").alias("high"), F.col("seq").alias("anchor_seq"))
    others = [name for name in fields if name != "seq"]
    places = nodes.select(*keys, F.col("seq").alias("at"), *others)
    return within(ranges, places, keys).withColumnRenamed("at", "seq")


def footer_rows(nodes: DataFrame, keys: Sequence[str], fields: Sequence[str] = ("seq", "text")) -> DataFrame:
    """Elements under footers, once for each footer around them, with `anchor_seq`."""
    anchors = nodes.filter(is_footer(_node(nodes)))
    return descendants(anchors, nodes.filter(is_element(_node(nodes))), keys, fields, itself=True)


def children(parents: DataFrame, nodes: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
    """Nodes of a tag whose parent is one of `parents` (keys, `parent_seq` and others)."""
    return nodes.filter(F.col("tag") == tag).join(parents, [*keys, "parent_seq"])


def text_places(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Text nodes: `at`, its place among ranges, `no` and `value`.

    The text of node n has the place 2n + 1 and its tail 2n, so the text under a
    node, its tail left out, is the range from 2n to 2 end_seq + 1.
    """
    pieces = F.filter(
        F.array(
            F.struct((2 * F.col("seq") + 1).alias("at"), F.col("text_no").alias("no"), F.when(F.col("kind") == "element", F.col("text")).alias("value")),
            F.struct((2 * F.col("seq")).alias("at"), F.col("tail_no").alias("no"), F.col("tail").alias("value")),
        ),
        lambda piece: piece["value"].isNotNull(),
    )
    return nodes.select(*keys, F.inline(pieces))


def inner_texts(anchors: DataFrame, nodes: DataFrame, keys: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """keys, `marks` and `inner`, all text under each anchor in document order."""
    ranges = anchors.select(*keys, (2 * F.col("seq")).alias("low"), (2 * F.col("end_seq") + 1).alias("high"), *marks)
    found = within(ranges, text_places(nodes, keys), keys).groupBy(*keys, *marks)
    ordered = F.sort_array(F.collect_list(F.struct("no", "value")))
    return found.agg(F.array_join(F.transform(ordered, lambda t: t["value"]), "").alias("inner"))


def selected_tables(
    nodes: DataFrame, keys: Sequence[str], terms: Sequence[str] = HEADING_TERMS, exclude: str = CONTENTS_WORD
) -> DataFrame:
    """Table nodes under a heading that holds a term, and `table_no` from 1.

    The text of a parent of tables is one row: it is where terms are looked for.
    """
    tables = nodes.filter((F.col("tag") == XHTML + "table") & (F.col("parent_seq") >= 0))
    parents = tables.select(*keys, F.col("parent_seq").alias("seq")).distinct()
    parents = parents.join(nodes.select(*keys, "seq", "end_seq"), [*keys, "seq"])
    # Text of all below the parent, and tails but for those of its children.
    ranges = parents.select(
        *keys, (2 * F.col("seq") + 1).alias("low"), (2 * F.col("end_seq") + 1).alias("high"), F.col("seq").alias("heading_seq")
    )
    owners = nodes.select(*keys, F.col("tail_no").alias("no"), F.col("parent_seq").alias("heading_seq"))
    owners = owners.filter(F.col("no").isNotNull())
    texts = within(ranges, text_places(nodes, keys), keys).join(owners, [*keys, "no", "heading_seq"], "left_anti")
    lowered = F.transform(
        F.sort_array(F.collect_list(F.struct("no", "value"))), lambda t: F.struct(t["no"].alias("no"), F.lower(t["value"]).alias("value"))
    )
    headings = texts.groupBy(*keys, "heading_seq").agg(lowered.alias("texts"))
    joined = F.array_join(F.transform("texts", lambda t: t["value"]), " ")
    headings = computed(headings, ends=_heading_ends(joined, terms, exclude))
    headings = computed(headings, place=_place(F.col("texts"), F.col("ends")))
    headings = headings.select(
        *keys, F.col("heading_seq").alias("parent_seq"), F.col("place.term").alias("term_no"), F.col("place.contents").alias("contents_no")
    ).filter("term_no IS NOT NULL")
    found = tables.join(headings, [*keys, "parent_seq"]).filter(
        (F.col("term_no") < F.col("text_no")) & ~F.coalesce(F.col("contents_no") < F.col("text_no"), F.lit(False))
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    return found.drop("term_no", "contents_no").withColumn("table_no", number)


def cell_rows(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, `table_no`, `row_no`, `col_no` (from 1) and `text` of all cells of selected tables."""
    documents, rest = in_place(nodes, keys, lambda documents: with_cells(select_tables(documents)), "tables")
    return table_cells(documents).unionByName(joined_cell_rows(rest, keys))


def joined_cell_rows(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """As `cell_rows`, by joins of ranges and places, wherever the rows lie."""
    tables = selected_tables(nodes, keys)
    parents = tables.select(*keys, F.col("seq").alias("parent_seq"), "table_no")
    rows = children(parents, nodes, keys, XHTML + "tr")
    number = F.row_number().over(Window.partitionBy(*keys, "table_no").orderBy("seq"))
    parents = rows.select(*keys, F.col("seq").alias("parent_seq"), "table_no", number.alias("row_no"))
    cells = children(parents, nodes, keys, XHTML + "td")
    number = F.row_number().over(Window.partitionBy(*keys, "table_no", "row_no").orderBy("seq"))
    marks = ["table_no", "row_no", "col_no"]
    cells = cells.select(*keys, "seq", "end_seq", "table_no", "row_no", number.alias("col_no"))
    # Read for their texts and joined with them: stored, as tables are not to be selected twice.
    cells = materialise(cells, "cells")
    texts = inner_texts(cells, nodes, keys, marks)
    found = cells.join(texts, [*keys, *marks], "left")
    return found.select(*keys, *marks, F.coalesce("inner", F.lit("")).alias("text"))


def section_rows(nodes: DataFrame, keys: Sequence[str], label: str = SECTION_LABEL) -> DataFrame:
    """keys, `section_no` (from 1), `pos` (from 0) and `text` of the sections under a label."""
    documents, rest = in_place(nodes, keys, lambda documents: with_sections(documents, label), "sections")
    return sibling_sections(documents).unionByName(joined_section_rows(rest, keys, label))


def joined_section_rows(nodes: DataFrame, keys: Sequence[str], label: str = SECTION_LABEL) -> DataFrame:
    """As `section_rows`, by joins of ranges and places, wherever the rows lie."""
    blank = lambda name: F.nullif(F.col(name), F.lit(""))
    own = F.coalesce(blank("text"), blank("tail"), F.lit("n/a"))
    labels = nodes.filter(strip(F.lower(own)) == label)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    labels = labels.select(*keys, "seq", "end_seq", "parent_seq", number.alias("section_no"))
    ends = nodes.select(*keys, F.col("seq").alias("parent_seq"), F.col("end_seq").alias("parent_end"))
    labels = labels.join(ends, [*keys, "parent_seq"], "left")
    # The labelled node itself, and what follows it under its parent.
    ranges = labels.select(
        *keys, "section_no",
        F.explode(F.array(
            F.struct((F.col("seq") - 1).alias("low"), F.col("seq").alias("high")),
            F.struct(F.col("end_seq").alias("low"), F.coalesce("parent_end", "end_seq").alias("high")),
        )).alias("range"),
    ).select(*keys, "section_no", "range.low", "range.high")
    elements = nodes.filter(F.col("kind") == "element")
    trimmed = lambda name: F.trim(F.col(name), F.lit(SPACE_CHARS))
    text = F.coalesce(F.nullif(trimmed("text"), F.lit("")), trimmed("tail"), F.lit(""))
    found = within(ranges, elements.select(*keys, F.col("seq").alias("at"), text.alias("text")), keys)
    place = F.row_number().over(Window.partitionBy(*keys, "section_no").orderBy("at")) - 1
    return found.select(*keys, "section_no", place.alias("pos"), "text")
