"""Markup documents to element trees, one row per document."""

from __future__ import annotations

import gc
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from xml.parsers import expat
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filings.functions.text import strip
from filings.functions.tree import (
    has_text,
    is_element,
    is_own_style,
    style_filter,
    subtree,
)
from filings.operators.computed import computed
from filings.schemas import ELEMENT

# An output batch is closed after the document that takes it past either bound.
_BATCH_ELEMENTS = 50_000
_BATCH_CHARS = 32 << 20

_NAME_SEPARATOR = "\x1f"
_QUOTED = {'"': "&quot;", "\n": "&#10;", "\t": "&#9;", "\r": "&#13;"}


_FIELDS = ELEMENT.fieldNames()

# Names of nodes are kept over documents, up to so many.
_NAMES = 50_000


class _Reader:
    """Nodes of documents, read one after another, as a list for each field.

    A node is a place in these lists; what was read since the last `clear` can be
    taken as Arrow arrays. A document that does not parse leaves no node. Names
    are numbers of (kind, tag, qname), which most nodes share.

    Style marks: each start tag and each text is an event. An event is marked
    when it holds the word "style" or a line break, whichever comes first in
    it. A node's first line holds the word exactly when the first mark between
    its start and the end of its tail is a style mark.
    """

    def __init__(self, keep_xml_under: str | None, marks_style: bool, with_attrs: bool = True):
        self.keep, self.marks_style, self.with_attrs = keep_xml_under, marks_style, with_attrs
        self.pool: list[tuple] = []
        self.names: dict = {}
        self.clear()

    def clear(self) -> None:
        self.offsets = [0]
        self.ints = {name: array("i") for name in ("end_seq", "parent_seq", "depth", "text_no", "tail_no")}
        self.name = array("i")
        self.text: list[str | None] = []
        self.tail: list[str | None] = []
        self.attr_ends = array("i", [0])
        self.attr_keys: list[str] = []
        self.attr_values: list[str] = []
        self.style = bytearray()
        self.xml: dict[int, str] = {}
        if len(self.pool) > _NAMES:
            self.pool.clear()
            self.names.clear()

    def number(self, key, kind: str, tag: str | None, qname: str | None) -> int:
        self.names[key] = len(self.pool)
        self.pool.append((kind, tag, qname))
        return len(self.pool) - 1

    def named(self, raw: str) -> int:
        """The number of an element's `({namespace}local, prefix:local)`."""
        known = self.names.get(raw)
        return self.number(raw, "element", *_split_name(raw)) if known is None else known

    def read(self, content) -> tuple[dict[str, str] | None, str | None]:
        """Add the nodes of a document; returns its root's namespaces, or the error."""
        base, attrs = len(self.name), len(self.attr_keys)
        try:
            if content is None:
                raise ValueError("no content")
            nsmap, failed = self._parse(content, base), None
        except (expat.ExpatError, ValueError, LookupError) as failure:
            for column in (*self.ints.values(), self.name, self.text, self.tail, self.style):
                del column[base:]
            del self.attr_ends[base + 1 :], self.attr_keys[attrs:], self.attr_values[attrs:]
            self.xml = {at: text for at, text in self.xml.items() if at < base}
            nsmap, failed = None, str(failure)
        self.offsets.append(len(self.name))
        return nsmap, failed

    def _parse(self, content, base: int) -> dict[str, str]:
        names, number, named = self.names, self.number, self.named
        name, text, tail = self.name, self.text, self.tail
        ends, parents, depths, text_nos, tail_nos = self.ints.values()
        attr_ends, attr_keys, attr_values = self.attr_ends, self.attr_keys, self.attr_values
        keep, marks_style, with_attrs, xml = self.keep, self.marks_style, self.with_attrs, self.xml
        # Open nodes; the last closed child of the innermost one; text read and not yet given.
        above: list[int] = []
        closed, texts, n = -1, 0, base
        pieces: list[str] = []
        scope: list[tuple] = []
        fresh: list[tuple] = []
        nsmap: dict[str, str] = {}
        styled_scope = events = 0
        firsts: list[int] = []
        lasts: list[int] = []
        mark_at: list[int] = []
        mark_is_style: list[bool] = []
        out, out_owner, out_done = None, -1, False

        def mark(chunk: str) -> None:
            nonlocal events
            events += 1
            style, line = chunk.lower().find("style"), chunk.find("\n")
            if style >= 0 or line >= 0:
                mark_at.append(events)
                mark_is_style.append(style >= 0 and (line < 0 or style < line))

        def mark_tag(qname: str, raw_attrs: dict[str, str]) -> None:
            nonlocal events
            events += 1
            line = qname + "".join([f" {k} {v}" for k, v in raw_attrs.items()]) if raw_attrs else qname
            if styled_scope or "style" in line.lower():
                mark_at.append(events)
                mark_is_style.append(True)

        def add(code: int, value: str | None) -> None:
            nonlocal n
            name.append(code)
            parents.append(above[-1] - base if above else -1)
            depths.append(len(above))
            ends.append(n - base)
            text.append(value)
            tail.append(None)
            text_nos.append(texts)
            tail_nos.append(texts)
            if marks_style:
                firsts.append(events)
                lasts.append(events)
            n += 1

        def flush() -> None:
            """Give the text read so far to its owner."""
            nonlocal texts, out, out_done
            if pieces:
                value = pieces[0] if len(pieces) == 1 else "".join(pieces)
                pieces.clear()
                if marks_style:
                    mark(value)
                if closed < 0:
                    text[above[-1]] = value
                else:
                    tail[closed] = value
                    if marks_style:
                        lasts[closed - base] = events
                texts += 1
                if out is not None:
                    out.append(escape(value))
            if out_done:
                xml[out_owner] = "".join(out)
                out, out_done = None, False

        def declare(prefix, uri) -> None:
            nonlocal styled_scope
            flush()
            styled = "style" in f"{prefix or ''} {uri or ''}".lower()
            scope.append((prefix, uri, styled))
            fresh.append((prefix, uri))
            styled_scope += styled

        def undeclare(prefix) -> None:
            nonlocal styled_scope
            styled_scope -= scope.pop()[2]

        def start(raw, raw_attrs) -> None:
            nonlocal closed, nsmap
            if pieces or out_done:
                flush()
            code = names.get(raw)
            if code is None:
                code = named(raw)
            if marks_style:
                mark_tag(self.pool[code][2], raw_attrs)
            at = n
            add(code, None)
            if with_attrs:
                if raw_attrs:
                    # Two prefixes of one namespace make one key, which the last value takes.
                    shown = {_split_name(key)[0]: value for key, value in raw_attrs.items()}
                    attr_keys.extend(shown)
                    attr_values.extend(shown.values())
                attr_ends.append(len(attr_keys))
            if keep is not None:
                write_start(at, raw_attrs)
            if at == base:
                nsmap = {prefix or "": uri or "" for prefix, uri in fresh}
            if fresh:
                fresh.clear()
            above.append(at)
            closed = -1

        def write_start(at: int, raw_attrs: dict[str, str]) -> None:
            nonlocal out, out_owner
            if out is None and is_kept(at):
                out, out_owner = [], at
                fresh[:] = [entry[:2] for entry in scope]
            if out is None:
                return
            shown = {f"xmlns:{prefix}" if prefix else "xmlns": uri or "" for prefix, uri in fresh}
            shown.update((_split_name(key)[1], value) for key, value in raw_attrs.items())
            pairs = [f' {key}="{escape(value, _QUOTED)}"' for key, value in shown.items()]
            out.append(f"<{self.pool[name[at]][2]}{''.join(pairs)}>")

        def is_kept(at: int) -> bool:
            """First child of a child of an element with the wanted local name."""
            if len(above) < 2 or at != above[-1] + 1:
                return False
            return self.pool[name[above[-2]]][1].rpartition("}")[2] == keep

        def stop(raw) -> None:
            nonlocal closed, out_done
            if pieces or out_done:
                flush()
            closed = above.pop()
            ends[closed] = n - 1 - base
            tail_nos[closed] = texts
            if marks_style:
                lasts[closed - base] = events
            if out is not None:
                out.append(f"</{self.pool[name[closed]][2]}>")
                out_done = closed == out_owner

        def leaf(kind, target, value) -> None:
            nonlocal closed
            if not above:
                return
            flush()
            if marks_style:
                mark(value if target is None else f"{target} {value}")
            key = (kind, target)
            code = names.get(key)
            add(number(key, kind, None, target) if code is None else code, value)
            if with_attrs:
                attr_ends.append(len(attr_keys))
            closed = n - 1
            if out is not None:
                shapes = {"comment": "<!--{1}-->", "pi": "<?{0} {1}?>", "entity": "{1}"}
                out.append(shapes[kind].format(target, value))

        parser = expat.ParserCreate(namespace_separator=_NAME_SEPARATOR)
        parser.namespace_prefixes = True
        parser.buffer_text = True
        parser.StartNamespaceDeclHandler = declare
        parser.EndNamespaceDeclHandler = undeclare
        parser.StartElementHandler = start
        parser.EndElementHandler = stop
        parser.CharacterDataHandler = pieces.append
        parser.CommentHandler = lambda value: leaf("comment", None, value)
        parser.ProcessingInstructionHandler = lambda target, value: leaf("pi", target, value)
        parser.SkippedEntityHandler = lambda entity, is_parameter: (
            None if is_parameter else leaf("entity", entity, f"&{entity};")
        )
        parser.Parse(content, True)
        flush()
        if marks_style:
            flags = bytearray(n - base)
            if any(mark_is_style):
                for node, first in enumerate(firsts):
                    at = bisect_left(mark_at, first)
                    flags[node] = at < len(mark_at) and mark_at[at] <= lasts[node] and mark_is_style[at]
            self.style += flags
        return nsmap

    def seqs(self) -> np.ndarray:
        starts = np.array(self.offsets[:-1], dtype=np.int32)
        return np.arange(len(self.name), dtype=np.int32) - np.repeat(starts, np.diff(self.offsets))

    def arrays(self, fields: T.StructType) -> list[pa.Array]:
        """An array for each of the fields, over all nodes."""
        # Copies: a list that has lent its memory cannot grow.
        codes = pa.array(np.array(self.name, dtype=np.int32))
        out = []
        for field in fields.names:
            if field == "seq":
                made = pa.array(self.seqs(), pa.int32())
            elif field in self.ints:
                made = pa.array(np.array(self.ints[field], dtype=np.int32))
            elif field in _NAMED:
                values = pa.array([entry[_NAMED.index(field)] for entry in self.pool], pa.string())
                made = values.take(codes)
            elif field == "attrs":
                made = pa.MapArray.from_arrays(
                    pa.array(np.array(self.attr_ends, dtype=np.int32)),
                    pa.array(self.attr_keys, pa.string()),
                    pa.array(self.attr_values, pa.string()),
                )
            elif field == "style_first_line":
                made = pa.array(np.array(self.style, dtype=np.uint8).astype(bool), pa.bool_())
            elif field == "xml":
                made = pa.nulls(len(self.name), pa.string())
                if self.xml:
                    made = pa.array([self.xml.get(at) for at in range(len(self.name))], pa.string())
            else:
                made = pa.array(self.text if field == "text" else self.tail, pa.string())
            out.append(made)
        return out


_NAMED = ("kind", "tag", "qname")


def _split_name(raw: str) -> tuple[str, str]:
    """`({namespace}local, prefix:local)`."""
    parts = raw.split(_NAME_SEPARATOR)
    if len(parts) == 1:
        return raw, raw
    prefix = parts[2] + ":" if len(parts) > 2 else ""
    return f"{{{parts[0]}}}{parts[1]}", prefix + parts[1]


def read_nodes(content) -> Iterator[dict]:
    """Nodes of one document, each with all fields but `xml`; none if it does not parse."""
    reader = _Reader(None, True)
    reader.read(content)
    fields = T.StructType([field for field in ELEMENT if field.name != "xml"])
    columns = [
        [dict(value) for value in made.to_pylist()] if name == "attrs" else made.to_pylist()
        for name, made in zip(fields.names, reader.arrays(fields), strict=True)
    ]
    for node in zip(*columns, strict=True):
        yield dict(zip(fields.names, node, strict=True))


def _map_array(maps: Sequence[dict[str, str] | None]) -> pa.MapArray:
    ends, full = [0], [entries or {} for entries in maps]
    for entries in full:
        ends.append(ends[-1] + len(entries))
    return pa.MapArray.from_arrays(
        pa.array(ends, pa.int32()),
        pa.array([k for entries in full for k in entries], pa.string()),
        pa.array([v for entries in full for v in entries.values()], pa.string()),
    )


def _reader_of(fields: T.StructType, keep_xml_under: str | None) -> _Reader:
    return _Reader(keep_xml_under, "style_first_line" in fields.names, "attrs" in fields.names)


def _documents_at_a_time(
    batches: Iterator[pa.RecordBatch], content: str, reader: _Reader
) -> Iterator[tuple[pa.RecordBatch, int, list[tuple]]]:
    """Batch, first row and (nsmap, error) of the documents that the reader holds."""
    # Nodes are many and hold no cycles; scanning them for some is waste.
    gc.disable()
    try:
        for batch in batches:
            first, documents, chars = 0, [], 0
            for value in batch.column(content):
                source = value.as_py()
                documents.append(reader.read(source))
                chars += len(source or "")
                if len(reader.name) >= _BATCH_ELEMENTS or chars >= _BATCH_CHARS:
                    yield batch, first, documents
                    reader.clear()
                    first += len(documents)
                    documents, chars = [], 0
            if documents:
                yield batch, first, documents
                reader.clear()
    finally:
        gc.enable()


def _read_batches(
    content: str, fields: T.StructType, keep_xml_under: str | None
):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader_of(fields, keep_xml_under)
        for batch, first, documents in _documents_at_a_time(batches, content, reader):
            nsmaps, errors = zip(*documents)
            made = {
                name: batch.column(name).slice(first, len(documents))
                for name in batch.schema.names
                if name != content
            }
            elements = pa.StructArray.from_arrays(reader.arrays(fields), fields.names)
            made["elements"] = pa.ListArray.from_arrays(pa.array(reader.offsets, pa.int32()), elements)
            made["nsmap"] = _map_array(nsmaps)
            made["error"] = pa.array(errors, pa.string())
            yield pa.RecordBatch.from_pydict(made)

    return read


def parse_markup(
    documents: DataFrame,
    content: str = "content",
    fields: Sequence[str] | None = None,
    keep_xml_under: str | None = None,
) -> DataFrame:
    """Parse each document; `content` gives way to `elements`, `nsmap`, `error`.

    Elements carry only the named `fields` of ELEMENT, all by default. Spark
    cannot prune fields inside Python, so a job names those it reads.

    `nsmap` holds the namespaces declared on the root ('' for the default). A
    document that does not parse keeps its row, with no elements and the
    parser's message in `error`. With `keep_xml_under`, the first child of each
    child of an element of that local name also carries its own markup in
    `xml`, with the namespaces in scope declared on it.
    """
    kept = [f for f in documents.schema.fields if f.name != content]
    element = T.StructType([f for f in ELEMENT if fields is None or f.name in fields])
    made = [
        T.StructField("elements", T.ArrayType(element)),
        T.StructField("nsmap", T.MapType(T.StringType(), T.StringType())),
        T.StructField("error", T.StringType()),
    ]
    return documents.mapInArrow(
        _read_batches(content, element, keep_xml_under), T.StructType(kept + made)
    )


def _read_rows(content: str, fields: T.StructType, others: Sequence[str], most: int):
    """Nodes of documents as rows, in batches of at most so many."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _reader_of(fields, None)
        for batch, first, documents in _documents_at_a_time(batches, content, reader):
            errors = [error for _, error in documents]
            # A document that does not parse is one row without a node.
            failed = np.array([row for row, error in enumerate(errors) if error is not None], dtype=np.int32)
            at = np.repeat(np.arange(len(documents), dtype=np.int32), np.diff(reader.offsets))
            at = pa.array(np.concatenate([at, failed]) + np.int32(first))
            columns = {name: batch.column(name).take(at) for name in others}
            for name, made in zip(fields.names, reader.arrays(fields), strict=True):
                columns[name] = pa.concat_arrays([made, pa.nulls(len(failed), made.type)])
            reasons = [None] * len(reader.name) + [errors[row] for row in failed.tolist()]
            columns["error"] = pa.array(reasons, pa.string())
            made = pa.RecordBatch.from_pydict(columns)
            for start in range(0, made.num_rows, most):
                yield made.slice(start, most)

    return read


def parse_rows(
    documents: DataFrame,
    content: str = "content",
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """As `parse_markup`, but one row for each node, with its fields as columns.

    For documents whose nodes would not fit a row: `structure` has the axes of
    such rows. A document that does not parse has one row, with `error` alone.
    """
    kept = [f for f in documents.schema.fields if f.name != content]
    element = T.StructType([f for f in ELEMENT if fields is None or f.name in fields])
    schema = T.StructType([*kept, *element.fields, T.StructField("error", T.StringType())])
    names = [f.name for f in kept]
    return documents.mapInArrow(_read_rows(content, element, names, _BATCH_ELEMENTS), schema)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Documents that did not parse, with the reason."""
    return parsed.filter(F.col("error").isNotNull()).drop("elements", "nsmap")


def well_formed(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error")


def with_reasons(parsed: DataFrame) -> DataFrame:
    """The parser's `error` as `stage` and `reason`, unless an earlier stage failed."""
    failed = F.when(F.col("error").isNotNull(), "document")
    has = "stage" in parsed.columns
    return parsed.withColumns(
        {
            "stage": F.coalesce("stage", failed) if has else failed,
            "reason": F.coalesce("reason", "error") if has else F.col("error"),
        }
    ).drop("error")


def document_columns(parsed: DataFrame) -> list[str]:
    """Columns that came with the document, not from the parser."""
    return [c for c in parsed.columns if c not in ("elements", "nsmap", "error")]


def kept_elements(elements: Column, style_rule: str | None = "first_line") -> Column:
    """Nodes with text or tail that pass the style rule."""
    return F.filter(
        elements, lambda e: has_text(e) & style_filter(e, style_rule)
    )


def parse_elements(
    parsed: DataFrame,
    style_rule: str | None = "first_line",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row per kept node in document order, text and tail stripped."""
    ids = document_columns(parsed)
    nodes = parsed.select(
        *ids, F.explode(kept_elements(F.col("elements"), style_rule)).alias("e")
    )
    parsed_fields = parsed.schema["elements"].dataType.elementType.names
    fields = columns or [name for name in parsed_fields if name != "xml"]
    return nodes.select(
        *ids,
        *[
            (strip(F.col(f"e.{f}")) if f in ("text", "tail") else F.col(f"e.{f}"))
            .alias(f)
            for f in fields
        ],
    )


def select_subtrees(
    parsed: DataFrame, anchor: Callable[[Column], Column]
) -> DataFrame:
    """Adds `subtrees`: `array<struct<anchor_seq, element>>`.

    Each anchor contributes every element of its subtree, itself included, so
    elements under nested anchors come once per anchor.
    """
    elements = F.col("elements")
    per_anchor = F.transform(
        F.filter(elements, anchor),
        lambda a: F.transform(
            F.filter(subtree(elements, a), is_element),
            lambda e: F.struct(a["seq"].alias("anchor_seq"), e.alias("element")),
        ),
    )
    return computed(parsed, subtrees=F.flatten(per_anchor))


def is_footer(node: Column) -> Column:
    """A node with text or tail, not a style element, whose class names a foot."""
    return (
        has_text(node)
        & ~is_own_style(node)
        & F.coalesce(node["attrs"]["class"].contains("foot"), F.lit(False))
    )


def footer_subtrees(parsed: DataFrame) -> DataFrame:
    return select_subtrees(parsed, is_footer)
