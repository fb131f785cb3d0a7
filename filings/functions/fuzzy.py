"""Edit distance with free ends, for many pairs of texts at a time.

The distance of a pattern from a text is the fewest edits that make it a part of
the text: what stands before and after that part costs nothing. A column of the
table of distances is a pair of bit vectors, the differences between neighbours,
so one step of a few operations on words of 64 bits advances a whole column, and
of a batch of pairs all columns of one place at once.
"""

from __future__ import annotations

import numpy as np

WORD = 64
_ONE, _ALL = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
# Words of bits (pairs x characters x words of a pattern) that a batch holds.
BITS = 1 << 22
# Characters of texts, each as long as the longest, that a batch holds.
CELLS = 1 << 20


def free_end_distances(patterns: list[str], texts: list[str]) -> np.ndarray:
    """Edits that make each pattern a part of its text."""
    out = np.array([len(pattern) for pattern in patterns], dtype=np.int64)
    # Pairs of alike sizes share a batch; the longest texts come first.
    size = lambda row: (-len(patterns[row]) // WORD, -len(texts[row]))
    order = sorted((row for row in range(len(out)) if patterns[row] and texts[row]), key=size)
    at = 0
    while at < len(order):
        words = (len(patterns[order[at]]) + WORD - 1) // WORD
        room = max(1, min(BITS // (words * 256), CELLS // len(texts[order[at]])))
        rows = [row for row in order[at : at + room] if (len(patterns[row]) + WORD - 1) // WORD == words]
        out[rows] = _batch([patterns[row] for row in rows], [texts[row] for row in rows], words)
        at += len(rows)
    return out


def _numbered(patterns: list[str], texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Characters as numbers; 0 for those of texts that no pattern holds."""
    points = [np.frombuffer(text.encode("utf-32-le"), dtype="<u4") for text in (*patterns, *texts)]
    known = np.unique(np.concatenate(points[: len(patterns)]))

    def numbers(text: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(known, text), len(known) - 1)
        return np.where(known[place] == text, place + 1, 0)

    found = [numbers(text) for text in points]
    return found[: len(patterns)], found[len(patterns) :], len(known) + 1


def _batch(patterns: list[str], texts: list[str], words: int) -> np.ndarray:
    """As `free_end_distances`; texts by falling length, patterns of so many words."""
    pairs = len(patterns)
    pattern_chars, text_chars, alphabet = _numbered(patterns, texts)
    # Bits of the places at which each pattern has a character.
    where = np.zeros((pairs, alphabet, words), dtype=np.uint64)
    lengths = np.array([len(chars) for chars in pattern_chars])
    row, place = np.repeat(np.arange(pairs), lengths), np.concatenate([np.arange(n) for n in lengths])
    bits = _ONE << (place % WORD).astype(np.uint64)
    np.bitwise_or.at(where, (row, np.concatenate(pattern_chars), place // WORD), bits)
    ends = np.array([len(chars) for chars in text_chars])
    columns = np.zeros((pairs, int(ends[0])), dtype=np.int64)
    for out, chars in zip(columns, text_chars, strict=True):
        out[: len(chars)] = chars
    last_word, last_bit = (lengths - 1) // WORD, ((lengths - 1) % WORD).astype(np.uint64)
    up, down = np.full((pairs, words), _ALL), np.zeros((pairs, words), dtype=np.uint64)
    score, least = lengths.astype(np.int64), lengths.astype(np.int64)
    # Texts that have ended leave from the end of the batch.
    active = np.searchsorted(-ends, -np.arange(int(ends[0])), side="left")
    for column, n in enumerate(active):
        same = where[np.arange(n), columns[:n, column]]
        vp, vn, rows = up[:n], down[:n], np.arange(n)
        carry = np.zeros(n, dtype=np.uint64)
        more, fewer = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
        rises, falls = np.empty((n, words), np.uint64), np.empty((n, words), np.uint64)
        for word in range(words):
            eq, p, m = same[:, word], vp[:, word].copy(), vn[:, word].copy()
            masked = eq & p
            total = masked + p
            sum_ = total + carry
            carry = ((total < p) | (sum_ < total)).astype(np.uint64)
            diagonal = (sum_ ^ p) | eq | m
            rise, fall = m | ~(diagonal | p), diagonal & p
            rises[:, word], falls[:, word] = rise, fall
            rise_on, fall_on = (rise << _ONE) | more, (fall << _ONE) | fewer
            more, fewer = rise >> np.uint64(WORD - 1), fall >> np.uint64(WORD - 1)
            vp[:, word] = fall_on | ~(diagonal | rise_on)
            vn[:, word] = rise_on & diagonal
        up_bit = (rises[rows, last_word[:n]] >> last_bit[:n]) & _ONE
        down_bit = (falls[rows, last_word[:n]] >> last_bit[:n]) & _ONE
        score[:n] += up_bit.astype(np.int64) - down_bit.astype(np.int64)
        np.minimum(least[:n], score[:n], out=least[:n])
    return least


def matched_shares(left: list[str], right: list[str]) -> np.ndarray:
    """Twice the matched characters as a share of both lengths.

    The shorter text is matched with a part of the longer: its characters but for
    the edits count as matched. Two empty texts are alike.
    """
    pairs = [(a, b) if len(a) <= len(b) else (b, a) for a, b in zip(left, right, strict=True)]
    distances = free_end_distances([a for a, _ in pairs], [b for _, b in pairs])
    short = np.array([len(a) for a, _ in pairs], dtype=float)
    both = np.array([len(a) + len(b) for a, b in pairs], dtype=float)
    return np.where(both > 0, 2 * (short - distances) / np.maximum(both, 1), 1.0)
