"""Personal data in texts: base patterns, and what a random field adds.

Base kinds are matched by their patterns, leftmost and without overlap within a
kind; a match that fails its test is dropped. A linear-chain conditional random
field over word shapes adds spans of other kinds (secrets, and contacts in other
forms) where no base span lies. Positions are code points, the end exclusive.

A null text is empty; an empty text has no spans. Lines are sequences of their
own for the field; very long ones are cut between plain words. Repeated rows
have a row each. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from filings.llm.common import whole
from filings.llm.crf import EDGE, KINDS, LABELS, Field, shape_class, train

# The base kinds, in this order, and their patterns. The patterns
# of long runs are anchored where a leftmost match must begin.
BASE = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

ORDER = {kind: i for i, kind in enumerate((*BASE, *KINDS))}

Span = tuple[int, int, str]

# A line of more words than this is cut at the next place between plain words.
LINE = 200
# Words that are decoded at a time, and classes of words that are remembered.
WORDS = 1 << 18
REMEMBERED = 1 << 18


def emails(text: str) -> list[Span]:
    """Every @ is tried once: what stands before it cannot contain another."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((start, end, "email"))
        at = text.find("@", max(end, at + 1))
    return out


def _octet(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start and then by kind."""
    out = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_octet, m[0].split("."))):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda span: (span[0], ORDER[span[2]], span[1]))


class Finder:
    """Finds spans in batches of texts."""

    def __init__(self, field: Field):
        self.field, self.known = field, {}

    def _class(self, word: str) -> int:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = self.known[word] = shape_class(word)
        return found

    def _sequences(self, text: str) -> Iterator[tuple[int, int, list[int]]]:
        """(line, first word, classes) of what the field has to look at."""
        for line_no, line in enumerate(text.split("\n")):
            classes = list(map(self._class, line.split()))
            if not classes or (self.field.plain_is_outside and not any(classes)):
                continue
            start = 0
            for i in range(LINE, len(classes) - 1):
                if i - start >= LINE and not any(classes[i - 1 : i + 2]):
                    yield line_no, start, classes[start:i]
                    start = i
            yield line_no, start, classes[start:]

    def added(self, texts: list[str]) -> dict[int, list[Span]]:
        """Spans of the field by the number of the text."""
        out: dict[int, list[Span]] = {}
        waiting, n = [], 0
        for i, text in enumerate(texts):
            for line_no, start, classes in self._sequences(text):
                waiting.append((i, line_no, start, classes))
                n += len(classes)
            if n >= WORDS:
                self._decode(texts, waiting, out)
                waiting, n = [], 0
        self._decode(texts, waiting, out)
        return out

    def _decode(self, texts: list[str], waiting: list, out: dict[int, list[Span]]) -> None:
        waiting.sort(key=lambda item: -len(item[3]))
        # Lines of similar length share a padded table.
        at = 0
        while at < len(waiting):
            width = len(waiting[at][3])
            rows = max(1, WORDS // width)
            group = [w for w in waiting[at : at + rows] if len(w[3]) * 2 >= width]
            at += len(group)
            lengths = np.array([len(w[3]) for w in group])
            classes = np.full((len(group), width), EDGE)
            for row, item in zip(classes, group, strict=True):
                row[: len(item[3])] = item[3]
            labels = self.field.viterbi(classes, lengths)
            for row in np.flatnonzero(labels.any(axis=1)):
                i, line_no, start, _ = group[row]
                spans = _spans_of_line(texts[i], line_no, start, labels[row, : lengths[row]])
                out.setdefault(i, []).extend(spans)

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """(base, all) spans of each text."""
        added, out = self.added(texts), []
        for i, text in enumerate(texts):
            base = base_spans(text)
            more = [s for s in added.get(i, ()) if not any(s[0] < b[1] and b[0] < s[1] for b in base)]
            every = sorted(base + more, key=lambda span: (span[0], ORDER[span[2]], span[1]))
            out.append((base, every))
        return out


def _spans_of_line(text: str, line_no: int, first: int, labels: np.ndarray) -> list[Span]:
    """Labelled words as spans of the text, without punctuation at their ends."""
    begin = 0
    for _ in range(line_no):
        begin = text.index("\n", begin) + 1
    end = text.find("\n", begin)
    words = [m.span() for m in re.compile(r"\S+").finditer(text, begin, len(text) if end < 0 else end)]
    out, t = [], 0
    while t < len(labels):
        name = LABELS[labels[t]]
        stop = t + 1
        if name != "O":
            kind = name[2:]
            while stop < len(labels) and LABELS[labels[stop]] == f"I-{kind}":
                stop += 1
            low, high = words[first + t][0], words[first + stop - 1][1]
            while low < high and not (text[low].isalnum() or text[low] == "("):
                low += 1
            while low < high and not (text[high - 1].isalnum() or text[high - 1] in ")]"):
                high -= 1
            if low < high:
                out.append((low, high, kind))
        t = stop
    return out


def printed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    field = train()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(field)
        for batch in batches:
            spans = finder.spans(batch["text"].to_pylist())
            counts = [
                pa.array([sum(s[2] == kind for s in base) for base, _ in spans], pa.int64())
                for kind in BASE
            ]
            digests = [hashlib.sha256(printed(base).encode()).hexdigest() for base, _ in spans]
            every = [printed(all_) for _, all_ in spans]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *counts, pa.array(digests, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    counts = ", ".join(f"n_{kind} long" for kind in BASE)
    return rows.mapInArrow(found, f"doc_id long, {counts}, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlaps are one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(text: Column) -> Column:
    """The text without personal data; null stays null."""
    field = train()

    @F.pandas_udf(StringType())
    def mask(texts: pd.Series) -> pd.Series:
        given = [text or "" for text in texts]
        found = Finder(field).spans(given)
        return pd.Series([
            None if text is None else masked(text, every)
            for text, (_, every) in zip(texts, found, strict=True)
        ], dtype=object)

    return mask(text)
