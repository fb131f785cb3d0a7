"""Fill-in-the-middle: texts cut in three at whole units, and put together anew.

A text is a sequence of character classes: white space, line feeds and word
characters, each either before a boundary or not. Over these a wavelet matrix
answers how often a class stands before a position; sums of such ranks count the
units (tokens or lines) that end there, and bisection on these counts finds where
a number of units ends. All texts of a batch share a matrix and are cut at once.

A token is a run of word characters with the white space before it; white space
at the end of a text is one more. A line ends after its line feed, or with the
text. The numbers that place the cuts and choose the form come from the SHA-256
of a seed and doc_id, so reruns agree and equal rows have equal results.

A null text is empty; an empty text, and one that holds a marker, stays plain. A
null doc_id counts as an empty one. Only doc_id and text are read. Repeated rows
have a row each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.llm.common import SPACES, whole

# Markers, seed, and shares in per cent of texts that are cut, and
# of these of texts whose suffix comes first.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "42"
CUT_SHARE = 50
SUFFIX_FIRST_SHARE = 80

# Character classes: twice the kind, and one more before a boundary. A boundary
# follows the last character, and a word character before white space.
SPACE, FEED, WORD = 0, 1, 2
LEVELS = 3
# Classes that end a unit; sums of their ranks count units.
UNITS = {
    "token": (2 * SPACE + 1, 2 * FEED + 1, 2 * WORD + 1),
    "line": (2 * FEED, 2 * FEED + 1),
}
# Code points that a matrix holds, unless one text has more.
POINTS = 1 << 22


class Bits:
    """Bits in words of 64, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        octets = np.zeros((len(bits) // 64 + 1) * 8, dtype=np.uint8)
        packed = np.packbits(bits, bitorder="little")
        octets[: len(packed)] = packed
        self.words = octets.view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)


class WaveletMatrix:
    """Ranks of symbols of `levels` bits: one row of bits a level, zeros first."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.rows: list[tuple[int, Bits, int]] = []
        for level in reversed(range(levels)):
            one = (symbols >> level & 1).astype(bool)
            symbols = np.concatenate([symbols[~one], symbols[one]])
            self.rows.append((level, Bits(one), len(one) - int(one.sum())))

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before each position."""
        low, high = np.zeros(1, dtype=np.int64), at
        for level, bits, zeros in self.rows:
            ones_low, ones_high = bits.rank(low), bits.rank(high)
            if symbol >> level & 1:
                low, high = zeros + ones_low, zeros + ones_high
            else:
                low, high = low - ones_low, high - ones_high
        return high - low


class Units:
    """Counts and ends of the units of many texts."""

    def __init__(self, texts: list[str], unit: str = "token"):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        self.ends = np.cumsum([len(text) for text in texts], dtype=np.int64)
        self.starts = np.r_[0, self.ends[:-1]].astype(np.int64) if len(texts) else self.ends
        white = np.isin(points, [ord(c) for c in SPACES])
        kind = np.where(white, np.where(points == 10, FEED, SPACE), WORD)
        boundary = np.zeros(len(points), dtype=bool)
        boundary[:-1] = ~white[:-1] & white[1:]
        boundary[self.ends[self.ends > self.starts] - 1] = True
        self.matrix, self.ending = WaveletMatrix((2 * kind + boundary).astype(np.uint8)), UNITS[unit]
        self.first = self._ended(self.starts)
        counted = self._ended(self.ends) - self.first
        # The end of a text ends a line, too.
        last = self.ends[self.ends > self.starts] - 1
        open_end = np.zeros(len(texts), dtype=np.int64)
        open_end[self.ends > self.starts] = ~np.isin((2 * kind[last] + 1), self.ending)
        self.n = counted + open_end

    def _ended(self, at: np.ndarray) -> np.ndarray:
        """Units that end before each position, from the first text on."""
        return sum(self.matrix.rank(symbol, at) for symbol in self.ending)

    def end_of(self, units: np.ndarray) -> np.ndarray:
        """Characters of each text up to the end of its first so many units."""
        low, high = self.starts.copy(), self.ends.copy()
        while (low < high).any():
            middle = (low + high) // 2
            enough = self._ended(middle) - self.first >= units
            # A search that is over keeps its place.
            low, high = np.where(enough | (low == high), low, middle + 1), np.where(enough, middle, high)
        return low - self.starts


def cuts(texts: list[str], one: np.ndarray, other: np.ndarray, unit: str = "token") -> np.ndarray:
    """Rows (units, end of prefix, end of middle) of each text, in characters.

    Of n units, the cuts are after `one` and `other` modulo n + 1, the smaller first.
    """
    out, at = np.zeros((len(texts), 3), dtype=np.int64), 0
    lengths = np.cumsum([len(text) for text in texts])
    while at < len(texts):
        done = lengths[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(lengths, done + POINTS, "right")))
        units = Units(texts[at:end], unit)
        a, b = one[at:end] % (units.n + 1), other[at:end] % (units.n + 1)
        out[at:end] = np.stack(
            [units.n, units.end_of(np.minimum(a, b)), units.end_of(np.maximum(a, b))], axis=1
        )
        at = end
    return out


def _located(unit: str):
    @F.pandas_udf("n long, first long, second long")
    def located(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, one, other in batches:
            found = cuts(list(texts), one.to_numpy(), other.to_numpy(), unit)
            yield pd.DataFrame(found, columns=["n", "first", "second"])

    return located


def filled_in(docs: DataFrame, unit: str = "token", seed: str = SEED) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output.

    Forms: plain; psm, prefix, suffix and middle; spm, suffix, prefix and middle.
    """
    text = whole("text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda i: F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", text.alias("text"), digest.alias("_digest"))
    rows = rows.select("doc_id", "text", *[number(i).alias(f"h{i + 1}") for i in range(4)])
    rows = rows.withColumn("_cut", _located(unit)("text", "h1", "h2"))
    marked = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(marker))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= CUT_SHARE)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SUFFIX_FIRST_SHARE, "spm").otherwise("psm")
    first, second = F.col("_cut.first").cast("int"), F.col("_cut.second").cast("int")
    rows = rows.select(
        "doc_id", "text", F.col("_cut.n").alias("n"), form.alias("form"), first.alias("_first"), second.alias("_second")
    )
    length = F.col("_second") - F.col("_first")
    prefix = F.substring("text", F.lit(1), F.col("_first"))
    middle = F.substring("text", F.col("_first") + 1, length)
    suffix = F.substring("text", F.col("_second") + 1, F.char_length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id", "n", "form",
        F.when(cut, F.col("_first").cast("long")).alias("prefix_chars"),
        F.when(cut, length.cast("long")).alias("middle_chars"),
        F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Cut texts hold no marker."""
    middle = F.substring_index(output, MIDDLE, -1)
    ahead = F.substring_index(output, MIDDLE, 1)

    def parts(first: str, second: str) -> tuple[Column, Column]:
        one = F.substring_index(ahead, second, 1)
        return F.substring(one, F.lit(len(first) + 1), F.char_length(one)), F.substring_index(ahead, second, -1)

    prefix, suffix = parts(PREFIX, SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix = parts(SUFFIX, PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
