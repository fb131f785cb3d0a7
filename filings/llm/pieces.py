"""Sampled SentencePiece encodings without replacement, and their decoding.

All segmentations of a text into pieces form a lattice; the weight of a piece is
1 / (rank + 1), its rank being its place in the vocabulary (a BPE vocabulary has
no probabilities). Perturbing the log-probability of every segmentation with
Gumbel noise and taking the `k` largest samples `k` different ones without
replacement. A-star search finds them from the top: a node of the search is a
set of segmentations with its largest perturbed value; a complete one splits
off, and for each of its steps the set that departs there stays in the queue,
with a Gumbel value truncated at that of its parent. Sums over the lattice from
the end give the exact chance of every step.

No piece crosses the start of a run of spaces, nor, in vocabularies that keep
marks apart, the place between a word and a mark. So the lattice is a chain of
the lattices of units between such places, which are built once for many texts. A
unit of more than `UNIT` code points is cut further, at each place that no piece of
the vocabulary crosses in it; what is left whole is one lattice, however long, and
built backwards in windows. Noise comes from a hash of the row's key, the number of
the sample, the unit and the step: reruns and other partitions agree.

Characters that no piece holds are spelled in byte pieces; decoding restores
every text exactly. A null or empty text has one segmentation, without pieces.
A text with fewer than `k` segmentations gives as many rows as it has, with
inclusion 1 (log 0). Repeated rows give the same samples; a null key is a key. An
empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain, compress, pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from filings.llm.common import whole

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
# Code points of texts that are encoded together, and lattice nodes remembered.
CHUNK = 1 << 18
UNIT = 500
# Code points of a longer unit that are looked at together.
WINDOW = 1 << 15
REMEMBERED = 700_000
# `uniform` gives Gumbel values above -3.7 and below 36.8.
SPREAD = 41.0

# Marks that a vocabulary may keep apart from other characters.
MARKS = ".,;:!?%&*$#|\"()'-/=+[]{}<>"
_BITS = 21  # of a code point
_SCHEMA = (
    "doc_id long, sample int, n_pieces long, ids array<int>, log_prob double, "
    "perturbed double, log_inclusion double, exact boolean"
)


class Vocabulary:
    """Pieces of a model, with a trie over their code points."""

    def __init__(self, pieces: Sequence[str], kinds: Sequence[str]):
        self.octets: list[bytes] = []
        self.first_byte = None
        texts = {}
        for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == "byte":
                self.first_byte = i if self.first_byte is None else self.first_byte
                self.octets.append(bytes([int(piece[3:5], 16)]))
            else:
                text = piece.replace("▁", " ") if kind == "text" else ""
                self.octets.append(text.encode())
                if text:
                    texts[text] = i
        if any(" " in text.lstrip(" ") for text in texts):
            raise ValueError("a piece spans the start of a run of spaces")
        self.unit = self._units(texts)
        self.longest = max(map(len, texts), default=1)
        self.flat = np.frombuffer(b"".join(self.octets), dtype=np.uint8)
        self.lengths = np.array([len(octets) for octets in self.octets], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        rank = np.maximum(np.arange(len(pieces)) - (self.first_byte or 0) - 255, 1)
        self.scores = -np.log(rank + 1.0)
        self.byte_score = -np.log(len(pieces) + 1.0)
        nodes, edges, self_piece = {"": 0}, {}, [-1]
        for text, i in texts.items():
            for end in range(1, len(text) + 1):
                if text[:end] not in nodes:
                    nodes[text[:end]] = len(nodes)
                    self_piece.append(-1)
                    edges[nodes[text[: end - 1]] << _BITS | ord(text[end - 1])] = nodes[text[:end]]
            self_piece[nodes[text]] = i
        self._hash(np.array(list(edges)), np.array(list(edges.values())))
        self.piece_at = np.array(self_piece)

    @staticmethod
    def _units(texts: Sequence[str]) -> re.Pattern:
        """Units: what no piece crosses the ends of, as a pattern.

        They begin at runs of spaces, and between marks and other characters
        where no piece has a mark beside another character. Characters that
        pieces do join to marks count as marks.
        """
        marks, words = set(MARKS), [text.lstrip(" ") for text in texts]
        words = [word for word in words if len(word) > 1]
        while more := {c for w in words if marks.intersection(w) for c in w} - marks:
            marks |= more
        if any(mark.isalpha() and mark.isascii() for mark in marks):
            return re.compile(" *[^ ]+| +")
        own = "".join(map(re.escape, sorted(marks)))
        return re.compile(f" *(?:[^ {own}]+|[{own}]+)| +")

    def _hash(self, keys: np.ndarray, children: np.ndarray) -> None:
        """Open addressing: a key is in its slot, or in the next free one."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.children = np.full(1 << self.bits, -1), np.full(1 << self.bits, -1)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            _, winner = np.unique(slot[free], return_index=True)
            placed = np.flatnonzero(free)[winner]
            self.keys[slot[placed]], self.children[slot[placed]] = keys[placed], children[placed]
            left = np.ones(len(keys), dtype=bool)
            left[placed] = False
            keys, children = keys[left], children[left]
            slot = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The trie node below each node by a code point, -1 for none."""
        keys = nodes << _BITS | codes
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.children[slot], -1)
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            found = held == keys[open_]
            out[open_[found]] = self.children[slot[open_[found]]]
            open_ = open_[~found & (held >= 0)]
        return out

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        kind = lambda i: (
            "byte" if model.is_byte(i) else "none" if model.is_control(i) or model.is_unknown(i) else "text"
        )
        return cls([model.id_to_piece(i) for i in ids], [kind(i) for i in ids])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of piece sequences that lie one after the other in `ids`.

        The first space of each is not part of its text.
        """
        length = self.lengths[ids]
        ends = np.cumsum(length)
        at = np.repeat(self.begins[ids] - ends + length, length)
        at += np.arange(len(at))
        octets = self.flat.take(at).tobytes()
        stops = np.r_[0, ends][np.cumsum(sizes)].tolist()
        return [
            octets[low + 1 : high].decode("utf-8", "replace")
            for low, high in zip([0, *stops[:-1]], stops, strict=True)
        ]

    def spelled(self, character: int) -> list[int]:
        return [self.first_byte + octet for octet in chr(character).encode("utf-8", "surrogatepass")]


class Table:
    """A column that grows in place, with room to spare."""

    def __init__(self, kind: type):
        self.room, self.size = np.zeros(1 << 16, dtype=kind), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros(max(end, len(self.room) * 3 // 2), dtype=self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : end] = values
        self.size = end

    def keep(self, chosen: np.ndarray) -> None:
        """Leave only the chosen values, in their order."""
        values = self.room[: self.size][chosen]
        self.room[: len(values)] = values
        self.size = len(values)

    def __getitem__(self, at):
        return self.room.take(at) if isinstance(at, np.ndarray) else self.room[at]


class Lattices:
    """Lattices of units in flat tables.

    Node 0 is the end of every unit. The edges of a node lie together, the likeliest
    first; `cumulative` is the chance of the edges of a node so far. Beyond
    `REMEMBERED` nodes, those of units that were not looked up again are forgotten.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.first = Table(np.int32)  # first edge of each node, and the end of all
        self.first.extend(np.zeros(2))
        self.owner, self.again = Table(np.int32), Table(bool)  # start node of the unit; looked up again
        self.target = Table(np.int32)
        self.piece = Table(np.int32)  # below zero: a spelled character
        self.chance = Table(np.float64)  # logarithms, zero for an only edge
        self.cumulative = Table(np.float32)
        self.owner.extend(np.zeros(1))
        self.again.extend(np.ones(1))

    def nodes_of(self, units: list[str]) -> np.ndarray:
        """Start nodes of units; the lattices of new ones are built."""
        if self.first.size > REMEMBERED:
            self._forget()
        nodes = np.fromiter(map(self.start.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        known, unknown = nodes[nodes >= 0], np.flatnonzero(nodes < 0)
        self.again.room[known] = True
        if len(unknown):
            new = list(map(units.__getitem__, unknown.tolist()))
            self._build(list(dict.fromkeys(new)))
            nodes[unknown] = list(map(self.start.__getitem__, new))
        return nodes

    def _forget(self) -> None:
        """Drop the units that were not looked up again, or all if most were."""
        sizes = np.diff(self.first[: self.first.size])
        kept = self.again[self.owner[: self.owner.size]]
        if kept.sum() > REMEMBERED // 2:
            self.clear()
            return
        edges, number = np.repeat(kept, sizes), np.cumsum(kept) - 1
        for table in (self.target, self.piece, self.chance, self.cumulative):
            table.keep(edges)
        for table in (self.owner, self.again):
            table.keep(kept)
        for table in (self.target, self.owner):
            table.room[: table.size] = number[table[: table.size]]
        sizes, self.first.size = sizes[kept], 0
        self.first.extend(np.r_[0, np.cumsum(sizes)])
        self.again.room[1 : len(sizes)] = False
        nodes = np.fromiter(self.start.values(), dtype=np.int64, count=len(self.start))
        renumbered = zip(self.start, number[nodes].tolist(), strict=True)
        self.start = dict(compress(renumbered, kept[nodes].tolist()))

    def rest(self, chance: np.ndarray) -> np.ndarray:
        """Log-chance of all other edges of a node, given that of one."""
        with np.errstate(divide="ignore"):
            return np.log(-np.expm1(chance))

    def nodes_before(self, edges: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first[: self.first.size], edges, side="right") - 1

    def divided(self, units: list[str]) -> list[str]:
        """Units of a text, with those of more than `UNIT` code points cut further."""
        if max(map(len, units), default=0) <= UNIT:
            return units
        return [part for unit in units for part in (self._cut(unit) if len(unit) > UNIT else (unit,))]

    def _cut(self, unit: str) -> list[str]:
        """Parts of a unit between the places that no piece crosses."""
        codes, crossed = _codes(unit), np.zeros(len(unit) + 1, dtype=np.int64)
        for low in range(0, len(codes), WINDOW):
            at, length, _, _ = self._window(codes, low, min(low + WINDOW, len(codes)))
            np.add.at(crossed, at + 1, 1)
            np.add.at(crossed, at + length, -1)
        places = [0, *(np.flatnonzero(np.cumsum(crossed)[1:-1] == 0) + 1).tolist(), len(unit)]
        return [unit[low:high] for low, high in pairwise(places)]

    def _window(self, codes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, ...]:
        """`_edges` of one unit that begin in a window of it."""
        part = codes[low : high + self.vocabulary.longest]
        at, *others = self._edges(part, np.full(len(part), len(part)))
        inside = at < high - low
        return at[inside] + low, *(values[inside] for values in others)

    def _edges(self, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(position, length, piece, score) of all pieces in the units."""
        v = self.vocabulary
        found, at, node, depth = [], np.arange(len(codes)), np.zeros(len(codes), dtype=np.int64), 0
        single = np.zeros(len(codes), dtype=bool)
        while len(at):
            node = v.child(node, codes[at + depth])
            known = node >= 0
            at, node, depth = at[known], node[known], depth + 1
            piece = v.piece_at[node]
            here = piece >= 0
            found.append((at[here], np.full(here.sum(), depth), piece[here], v.scores[piece[here]]))
            if depth == 1:
                single[at[here]] = True
            inside = at + depth < ends[at]
            at, node = at[inside], node[inside]
        spelled = np.flatnonzero(~single)
        code = codes[spelled]
        size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        piece = np.where(size == 1, v.first_byte + code, -code)
        found.append((spelled, np.ones(len(spelled), dtype=int), piece, size * v.byte_score))
        return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))

    def _build(self, units: list[str]) -> None:
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        for at in np.flatnonzero(lengths > UNIT).tolist():
            self._build_long(units[at])
        if lengths.max() > UNIT:
            units, lengths = list(compress(units, lengths <= UNIT)), lengths[lengths <= UNIT]
        if not units:
            return
        codes = _codes("".join(units))
        ends = np.repeat(np.cumsum(lengths), lengths)
        at, length, piece, score = self._edges(codes, ends)
        # Nodes by their distance from the end of their unit; ends come first.
        distance = ends - np.arange(len(codes))
        order = np.argsort(distance.astype(np.uint16), kind="stable")
        number = np.empty(len(codes), dtype=np.int64)
        number[order] = np.arange(len(codes)) + 1
        reached = at + length
        target = np.where(reached == ends[at], 0, number[np.minimum(reached, len(codes) - 1)])
        cuts = np.searchsorted(distance[order], np.arange(1, distance.max() + 2)) + 1
        # Node 0 of these is the end; the others follow on the nodes there are.
        base, begins = self.first.size - 2, np.cumsum(lengths) - lengths
        self.owner.extend(np.repeat(base + number[begins], lengths)[order])
        self._add(base, 1, number[at], target, piece, score, np.zeros(len(codes) + 1), cuts)
        self.start.update(zip(units, (base + number[begins]).tolist(), strict=True))

    def _build_long(self, unit: str) -> None:
        """The lattice of one unit, from its end, window by window."""
        codes, n = _codes(unit), len(unit)
        base, total = self.first.size - 2, np.zeros(n + 1)
        self.owner.extend(np.full(n, base + n))
        for high in range(n, 0, -WINDOW):
            low = max(high - WINDOW, 0)
            at, length, piece, score = self._window(codes, low, high)
            cuts = np.arange(n - high + 1, n - low + 2)
            self._add(base, n - high + 1, n - at, n - at - length, piece, score, total[: n - low + 1], cuts)
        self.start[unit] = base + n

    def _add(self, base, begin, source, target, piece, score, total, cuts) -> None:
        """Append the nodes from `begin` on to those after `base`, and their edges.

        `total` has the log-sum over all ways to the end for each node, and gets
        those of the new ones; no edge joins two nodes between the same cuts.
        """
        by_source = np.sort(source << 32 | np.arange(len(source))) & (1 << 32) - 1
        source, target, piece, score = source[by_source], target[by_source], piece[by_source], score[by_source]
        first = np.r_[0, np.cumsum(np.bincount(source - begin))]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            a, b = first[low - begin], first[high - begin]
            value = score[a:b] + total[target[a:b]]
            groups = first[low - begin : high - begin] - a
            top = np.maximum.reduceat(value, groups)
            value = np.exp(value - np.repeat(top, np.diff(np.r_[groups, b - a])))
            total[low:high] = top + np.log(np.add.reduceat(value, groups))
        only = (first[1:] - first[:-1])[source - begin] == 1
        chance = np.where(only, 0.0, np.minimum(score + total[target] - total[source], -1e-16))
        share = np.exp(chance)
        falling = ((1 - share) * ((1 << 20) - 1)).astype(np.int64)
        bits, own = self.vocabulary.longest.bit_length(), first[source - begin]
        keys = np.sort((source << 20 | falling) << bits | np.arange(len(source)) - own)
        likeliest = own + (keys & (1 << bits) - 1)
        chance, target, piece = chance[likeliest], target[likeliest], piece[likeliest]
        sums = np.cumsum(share[likeliest])
        sums -= np.r_[0, sums][own]
        sums[first[1:] - 1] = 2.0  # the last edge of each node takes what is left
        edges = self.target.size
        self.first.size -= 1
        self.first.extend(edges + first)
        self.target.extend(np.where(target > 0, base + target, 0))
        self.piece.extend(piece)
        self.chance.extend(chance)
        self.cumulative.extend(sums)
        self.again.extend(np.zeros(len(total) - begin))

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a way from each node to the end of its unit.

        Edges of all ways, one way after the other, and the length of each.
        """
        way, steps = np.flatnonzero(nodes), []
        node, seed = nodes[way], seeds[way]
        while len(way):
            drawn, edge = uniform(seed + np.uint64(2 * len(steps))), self.first[node].astype(np.int64)
            later = np.flatnonzero(drawn >= self.cumulative[edge])
            while len(later):
                at = edge[later] + 1
                edge[later] = at
                later = later[drawn[later] >= self.cumulative[at]]
            steps.append((way, edge))
            node = self.target[edge]
            inside = np.flatnonzero(node)
            way, node, seed = way[inside], node[inside].astype(np.int64), seed[inside]
        counts = np.zeros(len(nodes), dtype=np.int64)
        for step, (way, _) in enumerate(steps, start=1):
            counts[way] = step
        begin, edges = np.cumsum(counts) - counts, np.zeros(counts.sum(), dtype=np.int64)
        for step, (way, edge) in enumerate(steps):
            edges[begin[way] + step] = edge
        return edges, counts


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible pattern."""
    with np.errstate(over="ignore"):
        x = np.asarray(x, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def uniform(keys: np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1."""
    out = (mixed_bits(keys) >> np.uint64(12)).astype(np.float64)
    out += 0.5
    out /= 1 << 52
    return out


def truncated(place: np.ndarray, bound: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Gumbel values at `place` (a log-mass), given that none is above `bound`.

    Where there is no mass there is no value.
    """
    out, some = np.full(len(place), -np.inf), np.flatnonzero(place > -np.inf)
    bound = np.broadcast_to(bound, len(place))[some]
    out[some] = -np.logaddexp(-bound, np.log(-np.log(uniform(keys[some]))) - place[some])
    return out


class Path:
    """A sampled segmentation of a row, and the sets that depart from it.

    Of these only the ones that may be among the best: the steps they depart
    at, with units, log-probabilities before each step and perturbed values.
    """

    def __init__(self, edges, log_prob, steps, units, before, waiting, value, branch, excluded):
        self.edges, self.log_prob = edges, log_prob
        self.steps, self.units, self.before, self.waiting = steps, units, before, waiting
        self.value, self.branch, self.excluded = value, branch, excluded


class Sampler:
    def __init__(self, vocabulary: Vocabulary, k: int = SAMPLES):
        self.vocabulary, self.lattices, self.k = vocabulary, Lattices(vocabulary), k

    def encode(self, keys: list[int], texts: list[str]) -> list[list[tuple]]:
        """For each row up to k of (ids, log_prob, perturbed, log_inclusion)."""
        find = self.vocabulary.unit.findall
        units = [self.lattices.divided(find(" " + text)) if text else [] for text in texts]
        flat = list(chain.from_iterable(units))
        nodes = self.lattices.nodes_of(flat)
        starts = np.cumsum([0, *map(len, units)])
        seeds = mixed_bits(np.array(keys, dtype=np.int64).view(np.uint64))
        paths = self._first(nodes, starts, seeds)
        rows = range(len(texts))
        for sample in range(1, self.k):
            self._next(sample, paths, nodes, starts, seeds)
        return [self._result(paths[row]) for row in rows]

    def _unit_keys(self, seeds: np.ndarray, sample: int, units: np.ndarray) -> np.ndarray:
        """A key for each unit; its even followers draw edges, the odd ones noise."""
        return mixed_bits(seeds ^ mixed_bits(units.astype(np.uint64) * np.uint64(1 << 16) + np.uint64(sample)))

    def _first(self, nodes, starts, seeds) -> list[list[Path]]:
        sizes = np.diff(starts)
        row = np.repeat(np.arange(len(sizes)), sizes)
        keys = self._unit_keys(seeds[row], 0, np.arange(len(nodes)) - starts[row])
        edges, counts = self.lattices.walk(nodes, keys)
        values = -np.log(-np.log(uniform(seeds)))  # the best of all, at log-mass 0
        cuts = np.r_[0, np.cumsum(counts)][starts]
        before, log_probs, steps, place = self._departures(edges, cuts, np.zeros(len(sizes)), self.k)
        unit, noise = self._noise(steps, counts, keys)
        own = row[unit]
        waiting = truncated(place, values[own], noise)
        unit, step, stops = unit - starts[own], steps - cuts[own], np.searchsorted(steps, cuts)
        out = []
        for r in range(len(sizes)):
            near = slice(stops[r], stops[r + 1])
            out.append([Path(
                edges[cuts[r] : cuts[r + 1]], log_probs[r], step[near], unit[near], before[near], waiting[near],
                values[r], -1, (),
            )])
        return out

    def _departures(self, edges, cuts, start, n: int) -> tuple[np.ndarray, ...]:
        """Steps of ways where the `n` best sets depart, whatever the noise.

        The ways lie between the cuts, and begin at log-probability `start`. For
        each step: log-probability before it, place, log-mass of the set; for each
        way: its log-probability. A set whose log-mass is by `SPREAD` less than that
        of `n` others is below them, and no set has more than the way had before it.
        """
        t = self.lattices
        chance = t.chance[edges]
        sums = np.r_[0, np.cumsum(chance)]
        shift = start - sums[cuts[:-1]]
        steps = np.flatnonzero(chance < 0)
        begin = np.searchsorted(steps, cuts)
        sizes = np.diff(begin)
        before = sums[steps] + np.repeat(shift, sizes)
        bound = np.full(len(sizes), -np.inf)
        many = np.flatnonzero(sizes >= n)
        firsts = begin[many, None] + np.arange(n)
        bound[many] = (before[firsts] + t.rest(chance[steps[firsts]])).min(axis=1, initial=np.inf) - SPREAD
        near = np.flatnonzero(before >= np.repeat(bound, sizes))
        before, steps = before[near], steps[near]
        log_probs = start + np.add.reduceat(np.r_[chance, 0.0], cuts[:-1]) * (cuts[1:] > cuts[:-1])
        return before, log_probs, steps, before + t.rest(chance[steps])

    @staticmethod
    def _noise(steps, counts, keys) -> tuple[np.ndarray, np.ndarray]:
        """The unit of each step, and the key of its noise."""
        ends = np.cumsum(counts)
        unit = np.searchsorted(ends, steps, side="right")
        within = steps - (ends - counts)[unit]
        return unit, keys[unit] + (2 * within + 1).astype(np.uint64)

    def _next(self, sample: int, paths, nodes, starts, seeds) -> None:
        """Add the next best segmentation of every row that has one."""
        t = self.lattices
        chosen = []
        for r, own in enumerate(paths):
            tops = [(p.waiting.max(), i) for i, p in enumerate(own) if len(p.waiting)]
            if len(own) == sample and tops and max(tops)[0] > -np.inf:
                value, i = max(tops)
                path, at = own[i], int(own[i].waiting.argmax())
                path.waiting[at] = -np.inf
                chosen.append((r, path, at, value))
        if not chosen:
            return
        row = np.array([r for r, *_ in chosen])
        unit, step, start, value = (np.array(column) for column in zip(
            *((path.units[at], path.steps[at], path.before[at], value) for _, path, at, value in chosen), strict=True
        ))
        departed = [int(path.edges[path.steps[at]]) for _, path, at, _ in chosen]
        excluded = [
            path.excluded if path.steps[at] == path.branch else (edge,)
            for (_, path, at, _), edge in zip(chosen, departed, strict=True)
        ]
        seed = seeds[row]
        branch_keys = self._unit_keys(seed, sample, unit + (1 << 40))
        branches, remain = self._branch(np.array(departed), excluded, uniform(branch_keys))
        # Units from that of the branch on; their ways begin behind it.
        sizes = starts[row + 1] - starts[row] - unit
        stops = np.cumsum(sizes)
        units = np.arange(stops[-1]) - np.repeat(stops - sizes - unit, sizes)
        ways = nodes[units + np.repeat(starts[row], sizes)]
        ways[stops - sizes] = t.target[branches]
        way_keys = self._unit_keys(np.repeat(seed, sizes), sample, units)
        edges, counts = t.walk(ways, way_keys)
        cuts = np.r_[0, np.cumsum(counts)][np.r_[0, stops]]
        before, log_probs, steps, place = self._departures(edges, cuts, start + t.chance[branches], self.k - sample)
        way, noise = self._noise(steps, counts, way_keys)
        stops = np.searchsorted(steps, cuts)
        own = np.repeat(np.arange(len(chosen)), np.diff(stops))
        waiting = truncated(place, value[own], noise)
        at_branch = truncated(start + remain, value, branch_keys + np.uint64(1))
        # The set that departs at the branch comes before those of its way.
        steps, units, before, waiting = (
            np.insert(later, stops[:-1], at)
            for later, at in (
                (steps - cuts[own] + step[own] + 1, step), (units[way], unit), (before, start), (waiting, at_branch)
            )
        )
        stops += np.arange(len(stops))
        for n, (r, path, _, _) in enumerate(chosen):
            near = slice(stops[n], stops[n + 1])
            paths[r].append(Path(
                np.concatenate([path.edges[: step[n]], [branches[n]], edges[cuts[n] : cuts[n + 1]]]),
                log_probs[n], steps[near], units[near], before[near], waiting[near], value[n], step[n],
                (*excluded[n], int(branches[n])),
            ))

    def _branch(self, departed, excluded, drawn) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn at the nodes of others, and the log-chance of all that are left."""
        t = self.lattices
        node = t.nodes_before(departed)
        first, stop = t.first[node].astype(np.int64), t.first[node + 1]
        options = first[:, None] + np.arange((stop - first).max())
        chance = np.where(options < stop[:, None], t.chance[np.minimum(options, stop[:, None] - 1)], -np.inf)
        row = np.repeat(np.arange(len(node)), list(map(len, excluded)))
        chance[row, np.array(list(chain.from_iterable(excluded))) - first[row]] = -np.inf
        weight = np.cumsum(np.exp(chance - chance.max(axis=1, keepdims=True)), axis=1)
        taken = (weight <= (drawn * weight[:, -1])[:, None]).sum(axis=1)
        chance[np.arange(len(node)), taken] = -np.inf
        return first + taken, np.logaddexp.reduce(chance, axis=1)

    def _result(self, own: list[Path]) -> list[tuple]:
        """Samples with the chance that a segmentation is among the best k.

        That is given the perturbed value of the best one that is not.
        """
        threshold = max((p.waiting.max() for p in own if len(p.waiting)), default=-np.inf)
        out = []
        for path in own:
            log_prob = float(path.log_prob)
            if len(own) < self.k or threshold == -np.inf:
                inclusion = 0.0
            else:
                rate = np.exp(min(log_prob - threshold, 700.0))
                # log(1 - exp(-rate)), which is log(rate) for small rates.
                inclusion = log_prob - threshold if rate < 1e-12 else float(np.log(-np.expm1(-rate)))
            out.append((self._ids(path.edges), log_prob, float(path.value), inclusion))
        return out

    def _ids(self, edges: np.ndarray) -> np.ndarray:
        ids = self.lattices.piece[edges]
        where = np.flatnonzero(ids < 0)
        if len(where):
            spelled = [self.vocabulary.spelled(-i) for i in ids[where].tolist()]
            sizes = np.ones(len(ids), dtype=np.int64)
            sizes[where] = list(map(len, spelled))
            ids = np.repeat(ids, sizes)
            ids[ids < 0] = list(chain.from_iterable(spelled))
        return ids


def encoded(docs: DataFrame, k: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """Up to k rows for each document: ids, scores, and whether ids decode exactly.

    The driver reads the model; executors get its pieces.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(vocabulary.value, k)
        for batch in batches:
            low, size = 0, 0
            for high, length in enumerate(pc.utf8_length(batch["text"]).to_pylist(), start=1):
                size += length
                if size >= CHUNK or high == batch.num_rows:
                    part = batch.slice(low, high - low)
                    texts = part["text"].to_pylist()
                    found = sampler.encode(part["seed"].to_pylist(), texts)
                    yield _batch(sampler, part["doc_id"], texts, found)
                    low, size = high, 0

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("seed"), whole("text").alias("text")
    )
    return rows.mapInArrow(encode, _SCHEMA)


def _batch(sampler: Sampler, keys: pa.Array, texts: list[str], found: list[list[tuple]]) -> pa.RecordBatch:
    row = np.repeat(np.arange(len(found)), [len(samples) for samples in found])
    every = [sample for samples in found for sample in samples]
    ids = [sample[0] for sample in every]
    sizes = np.array([len(i) for i in ids])
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
    texts_again = sampler.vocabulary.decode(flat, sizes)
    exact = [again == texts[r] for r, again in zip(row.tolist(), texts_again, strict=True)]
    columns = {
        "doc_id": keys.take(pa.array(row)),
        "sample": pa.array([n for samples in found for n in range(1, len(samples) + 1)], pa.int32()),
        "n_pieces": pa.array(sizes, pa.int64()),
        "ids": pa.ListArray.from_arrays(
            pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()),
            pa.array(flat, pa.int32()),
        ),
        "log_prob": pa.array([s[1] for s in every], pa.float64()),
        "perturbed": pa.array([s[2] for s in every], pa.float64()),
        "log_inclusion": pa.array([s[3] for s in every], pa.float64()),
        "exact": pa.array(exact, pa.bool_()),
    }
    return pa.RecordBatch.from_pydict(columns)


def decoded(docs: DataFrame, ids: Column, model: str = MODEL) -> Column:
    """The text of a column of ids; null for null."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf(StringType())
    def decode(rows: pd.Series) -> pd.Series:
        ids = [np.zeros(0, dtype=np.int64) if r is None else np.asarray(r, dtype=np.int64) for r in rows]
        sizes = np.array([len(i) for i in ids], dtype=np.int64)
        texts = vocabulary.value.decode(np.concatenate(ids), sizes) if ids else []
        return pd.Series(
            [None if r is None else text for r, text in zip(rows, texts, strict=True)], dtype=object
        )

    return decode(ids)
