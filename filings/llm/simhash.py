"""Near-duplicates by SimHash fingerprints linked through BK-trees.

A fingerprint has 64 bits; two link if they differ in at most `RADIUS` bits.
Fingerprints are first made distinct, so copies cost one row. If two differ in at
most three bits, one of four blocks of 16 bits is equal. Shards are therefore the
first bits of each block, as many as leave about `TREE` fingerprints in a shard;
beyond 16 bits, and for shards of more than `SHARD` fingerprints, these are
divided by parts of the other 48 bits (of four, one is equal, too). What is still
larger is cut into chunks of one tree each; nothing is capped. Every chunk
becomes a BK-tree (children keyed by their Hamming distance to the parent), which
is joined to the chunks of its shard: by a broadcast of the trees up to
`BROADCAST_CODES` fingerprints, else by a shuffle. A search follows only edges
within the radius. Tasks return a spanning star for each group they find, never
all pairs, and distributed star contraction joins the stars into components.

`one_of_each`, which removes near-copies, links more: texts of which five-word
shingles are alike to `ALIKE` or more (Jaccard). Such texts differ in too many
bits for the keys above, so their shards are by `KEYS` smallest shingle hashes
under different orders (two texts alike to 0.8 share none of five with a chance
of 0.0003). A key that more than `SHARD` texts share is divided by each of `MORE`
other such keys (of two texts alike to 0.8 it parts one in two million). What
is still larger is cut by the number of shingles into bands that only meet their
neighbours, and these into chunks. All texts of a shard are compared whose
numbers of distinct shingles allow it: a pair is set aside if the sketches of
both (for `BINS` bins the smallest shingle hash in each) agree in less than
`APART`. Groups that overlap are joined while they fit a shard, and their texts
are moved, past a Bloom filter of their keys, to compare their sets of distinct
shingle hashes exactly. Documents that are alone in their group are kept where
they lie: only those that a second filter takes for members of a group move.

A null or empty text, or one without words, has the fingerprint zero, which
links like any other. Repeated rows have a row each. A component whose doc_ids
are all null has a null id. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.llm.common import parallelism, whole
from filings.operators.bloom import Filter, possible
from filings.operators.storage import materialise, release

WORDS_IN_SHINGLE = 3
SEED = 42
RADIUS = 3
# Fingerprints in a tree, about, and the most; the most texts in a shard.
TREE = 1024
SHARD = 4096
# Trees of so many fingerprints in all are sent to every executor (24 MB).
BROADCAST_CODES = 1_000_000
# Near-copies: see above.
NEAR_WORDS = 5
ALIKE = 0.8
# Sketches that agree in less are clearly apart: six deviations below `ALIKE`.
APART = 0.65
KEYS = 5
MORE = 9
BINS = 256
# Just above 1 / ALIKE: sizes of texts that are alike are of one band or of neighbours.
BAND = 1.2501
# Pairs of sketches that are compared at a time.
SKETCHES = 1 << 13
# Shingles of a text that count as one text when chunks are cut.
LOAD = 512
# Node visits that a search holds in memory at a time.
VISITS = 2_000_000
# Hashes that are counted bit by bit, and that are put in all orders, at a time.
HASHES = 1 << 16
PIECE = 1 << 14


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hash of every run of n words; of all words where there are fewer."""
    if len(words) < n:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8")


def fingerprint(text: bytes) -> int:
    """64-bit fingerprint of a UTF-8 text, as a signed number."""
    # lower() and split() of bytes treat ASCII only.
    return majority(shingle_hashes(text.lower().split(), WORDS_IN_SHINGLE))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), HASHES):
        octets = hashes[at : at + HASHES].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(text or b"") for text in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["text_hash"], pa.array(found, pa.int64())],
            ["doc_id", "text_hash", "fingerprint"],
        )


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The smallest of the distinct hashes in each bin, as 16 bits; 0 for none."""
    # The bin is moved to the highest bits, so that sorting puts bins apart.
    bits = np.uint64(BINS.bit_length() - 1)
    turned = np.sort(hashes << (np.uint64(64) - bits) | hashes >> bits)
    places = (turned >> (np.uint64(64) - bits)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, places[1:] != places[:-1]]) if len(places) else places
    out = np.zeros(BINS, dtype="<u2")
    out[places[first]] = (turned[first] & np.uint64(0xFFFF)).astype(np.uint16) | 1
    return out


_ORDERS = np.random.default_rng(SEED).integers(0, 1 << 64, KEYS + MORE, dtype=np.uint64)


def smallest_hashes(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each of `KEYS` and `MORE` orders, none where there is no hash."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    # Orders by one multiplication each are not independent, which loses pairs of short texts.
    least = np.full((len(_ORDERS), 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), PIECE):
        mixed = (hashes[at : at + PIECE] ^ _ORDERS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
        np.minimum(least, (mixed ^ mixed >> np.uint64(32)).min(axis=1, keepdims=True), out=least)
    return (least[:, 0] ^ _ORDERS).view(np.int64)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes, sizes, keys, more, sketches = [], [], [], [], []
        for text in batch["text"].to_pylist():
            words = (text or b"").lower().split()
            codes.append(majority(shingle_hashes(words, WORDS_IN_SHINGLE)))
            hashes = np.unique(shingle_hashes(words, NEAR_WORDS))
            sizes.append(len(hashes))
            smallest = smallest_hashes(hashes)
            keys.append(smallest[:KEYS])
            more.append(smallest[KEYS:])
            sketches.append(sketch(hashes).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"], batch["text_hash"], pa.array(codes, pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                pa.array(more, pa.list_(pa.int64())), pa.array(sketches, pa.binary()),
            ],
            ["doc_id", "text_hash", "fingerprint", "size", "keys", "more", "sketch"],
        )


def text_key(text: str = "text") -> Column:
    return F.xxhash64(whole(text))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_hash"),
        whole("text").cast("binary").alias("text"),
    )


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and fingerprint of each document."""
    return _texts(docs).mapInArrow(_fingerprints, "doc_id long, text_hash long, fingerprint long")


def with_sketches(docs: DataFrame) -> DataFrame:
    """As `with_fingerprints`, and what near-copies are found by."""
    return _texts(docs).mapInArrow(
        _described,
        "doc_id long, text_hash long, fingerprint long, size long, keys array<long>, more array<long>, sketch binary",
    )


def prefix_bits(n: int) -> int:
    """Bits of a shard's key that leave about `TREE` of n fingerprints in a shard."""
    return max(0, min(28, int(math.log2(max(1, n / TREE)))))


def shard_keys(code: Column, bits: int) -> Column:
    """The shards of a fingerprint: 4 of up to 16 bits, 16 of more.

    A key holds the block (and part) above bit 28, below it the bits.
    """
    keys = []
    for i in range(4):
        block = F.shiftrightunsigned(code, 16 * i).bitwiseAND(F.lit(0xFFFF))
        if bits <= 16:
            keys.append(F.shiftrightunsigned(block, 16 - bits).bitwiseOR(F.lit(i << 28).cast("long")))
            continue
        low = code.bitwiseAND(F.lit((1 << 16 * i) - 1))
        high = F.shiftrightunsigned(code, 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(high, 16 * i).bitwiseOR(low)
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            key = F.shiftrightunsigned(F.shiftleft(block, 12).bitwiseOR(part), 28 - bits)
            keys.append(key.bitwiseOR(F.lit((4 * i + j) << 28).cast("long")))
    return F.array(*keys)


def finer_keys(code: Column, key: Column, bits: int) -> Column:
    """The shards of 28 bits that a shard of fewer is divided into."""
    finest, number = shard_keys(code, 28), F.shiftrightunsigned(key, 28).cast("int")
    return F.slice(finest, 4 * number + 1, 4) if bits <= 16 else F.slice(finest, number + 1, 1)


class Forest:
    """A BK-tree for each group of sorted rows, built and searched by levels."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes, n = codes, len(codes)
        starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.arange(0)
        self.root = np.repeat(starts, np.diff(np.r_[starts, n]))
        edges, children = [], []
        rows = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        parents = self.root[rows]
        while len(rows):
            edge = parents * 65 + np.bitwise_count(codes[rows] ^ codes[parents])
            # The first row at each distance becomes the child; others go below it.
            keys, first, member = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(keys)
            children.append(rows[first])
            below = np.ones(len(rows), dtype=bool)
            below[first] = False
            rows, parents = rows[below], rows[first][member][below]
        order = np.argsort(np.concatenate(edges)) if edges else []
        self.edges = np.concatenate(edges)[order] if edges else np.arange(0)
        self.children = np.concatenate(children)[order] if edges else np.arange(0)

    def search(self, rows: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, node) of one tree within the radius, in pieces."""
        for found, nodes in self.find(self.codes[rows], self.root[rows], radius):
            other = rows[found] != nodes
            if other.any():
                yield rows[found][other], nodes[other]

    def find(
        self, asked: np.ndarray, roots: np.ndarray, radius: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in `asked`, node) below its root within the radius, in pieces."""
        stack = [(np.arange(len(asked)), roots)]
        while stack:
            rows, nodes = stack.pop()
            if len(rows) > VISITS:
                half = len(rows) // 2
                stack += [(rows[half:], nodes[half:]), (rows[:half], nodes[:half])]
                continue
            distance = np.bitwise_count(asked[rows] ^ self.codes[nodes]).astype(np.int64)
            hit = distance <= radius
            if hit.any():
                yield rows[hit], nodes[hit]
            low = np.searchsorted(self.edges, nodes * 65 + np.maximum(distance - radius, 0))
            high = np.searchsorted(self.edges, nodes * 65 + np.minimum(distance + radius, 64), "right")
            n = high - low
            rows = np.repeat(rows, n)
            if len(rows):
                at = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                stack.append((rows, self.children[at]))


def link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of a and b; `label` is the first row of each row's group."""
    while len(a):
        a, b = label[a], label[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, above := label[label]):
            label[:] = above


def _codes(value: bytes) -> np.ndarray:
    return np.frombuffer(value, dtype="<u8")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A BK-tree for each chunk of codes."""
    for batch in batches:
        trees = []
        for codes in batch["codes"].to_pylist():
            codes = np.array(codes, dtype="<i8").view("<u8")
            tree = Forest(codes, np.zeros(len(codes), dtype=np.int64))
            trees.append([part.astype("<i8").tobytes() for part in (tree.codes.view("<i8"), tree.edges, tree.children)])
        parts = [pa.array(part, pa.binary()) for part in (zip(*trees, strict=True) if trees else ([], [], []))]
        yield pa.RecordBatch.from_arrays(
            [batch["shard"], batch["own"], *parts], ["shard", "own", "nodes", "edges", "children"]
        )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, first): the first code of its group, among a tree and the codes asked of it."""
    for batch in batches:
        out = [(np.arange(0), np.arange(0))]
        names = ("same", "asked", "nodes", "edges", "children")
        for same, asked, nodes, edges, children in zip(*(batch[n].to_pylist() for n in names), strict=True):
            tree = Forest.__new__(Forest)
            tree.codes = _codes(nodes)
            tree.edges, tree.children = np.frombuffer(edges, "<i8"), np.frombuffer(children, "<i8")
            codes = tree.codes if same else np.r_[tree.codes, np.array(asked, dtype="<i8").view("<u8")]
            label, ahead = np.arange(len(codes)), 0 if same else len(tree.codes)
            asked = codes[ahead:]
            for places, found in tree.find(asked, np.zeros(len(asked), dtype=np.int64), RADIUS):
                link(label, places + ahead, found)
            tied = np.flatnonzero(label != np.arange(len(codes)))
            out.append((codes[tied].view("<i8"), codes[label[tied]].view("<i8")))
        code, first = (np.concatenate(parts) for parts in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(first, pa.int64())], ["code", "first"])


def links(codes: DataFrame, shard: int = SHARD, broadcast_codes: int = BROADCAST_CODES) -> DataFrame:
    """Star edges (code, first) among distinct fingerprints `code`."""
    n = codes.count()
    bits = prefix_bits(n)
    keys = F.array_distinct(shard_keys(F.col("code"), bits))
    placed = codes.select("code", F.explode(keys).alias("key"), F.lit(bits).alias("bits"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = placed.join(sizes, "key")
    if bits < 28:
        hot = placed.filter(F.col("n") > shard)
        finer = hot.select("code", F.explode(finer_keys(F.col("code"), F.col("key"), bits)).alias("key")).distinct()
        finer = finer.join(finer.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key")
        finer = finer.select("key", "code", F.lit(28).alias("bits"), "n")
        placed = placed.filter(F.col("n") <= shard).select("key", "code", "bits", "n").union(finer)
    chunks = F.ceil(F.col("n") / F.lit(shard)).cast("long")
    own = F.pmod(F.xxhash64("code"), chunks)
    chunked = placed.select(F.struct("bits", "key").alias("shard"), own.alias("own"), "code")
    chunked = materialise(chunked.groupBy("shard", "own").agg(F.collect_list("code").alias("codes")), "chunks")
    kind = "shard struct<bits:int,key:long>, own long, nodes binary, edges binary, children binary"
    trees = materialise(chunked.mapInArrow(_trees, kind), "trees")
    small = 4 * n <= broadcast_codes
    asked = chunked.select("shard", F.col("own").alias("_own"), F.col("codes").alias("asked"))
    met = asked.join(F.broadcast(trees) if small else trees, "shard").filter("_own <= own")
    met = met.withColumn("same", F.col("own") == F.col("_own"))
    # A tree holds the codes of its own chunk already.
    asked = F.when(~F.col("same"), F.col("asked")).alias("asked")
    met = met.select("same", asked, "nodes", "edges", "children")
    found = materialise(met.mapInArrow(_stars, "code long, first long").distinct(), "stars")
    release(trees)
    release(chunked)
    return found


def alike(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard index of pairs of rows."""
    left, right = sketches[a], sketches[b]
    same = ((left == right) & (left > 0)).sum(axis=1)
    return same / np.maximum(((left | right) > 0).sum(axis=1), 1)


def _members(table: pa.Table, label: np.ndarray) -> pa.RecordBatch:
    """Rows of groups with several texts; `key` is the same for equal groups."""
    hashes = table["text_hash"].to_numpy()
    order = np.lexsort((hashes, label))
    own, texts = label[order], hashes[order]
    # A repeated row is one text.
    new = np.r_[True, (own[1:] != own[:-1]) | (texts[1:] != texts[:-1])]
    order, own, texts = order[new], own[new], texts[new]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    n = np.diff(np.r_[first, len(own)])
    key = np.repeat(np.bitwise_xor.reduceat(texts, first), n)
    several = np.repeat(n > 1, n)
    rows = pa.array(order[several])
    columns = [table[name].take(rows).combine_chunks() for name in ("code", "size", "doc_id", "text_hash")]
    return pa.RecordBatch.from_arrays(
        [pa.array(key[several]), *columns], ["key", "code", "size", "doc_id", "text_hash"]
    )


def pairs_by_size(groups: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one group whose sizes allow an index of `ALIKE`, in pieces."""
    order = np.lexsort((sizes, groups))
    groups, sizes = groups[order], sizes[order]
    # Groups lie apart by more than any size.
    base = np.cumsum(np.r_[0, groups[1:] != groups[:-1]]) << 40
    last = np.searchsorted(base + sizes, base + np.floor(sizes / ALIKE + 1e-6).astype(np.int64), "right")
    n = last - np.arange(len(order)) - 1
    ends, low = np.cumsum(n), 0
    while low < len(n):
        done = ends[low] - n[low]
        high = max(low + 1, int(np.searchsorted(ends, done + VISITS, "right")))
        rows = np.repeat(np.arange(low, high), n[low:high])
        others = rows + 1 + np.arange(len(rows)) - (ends - n)[rows] + done
        yield order[rows], order[others]
        low = high


def _near_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of texts in each shard whose sketches are not clearly apart."""

    def linked(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), dtype="<u2").reshape(-1, BINS)
        label = np.arange(table.num_rows)
        for rows, others in pairs_by_size(table["shard"].to_numpy(), table["size"].to_numpy()):
            # None whose texts are linked by now.
            for at in range(0, len(rows), SKETCHES):
                a, b = rows[at : at + SKETCHES], others[at : at + SKETCHES]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                good = alike(sketches, a, b) >= APART
                link(label, a[good], b[good])
        return _members(table, label)

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held["shard"].to_numpy()
        # The last shard of the batch may go on in the next.
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done:
            yield linked(held.slice(0, done))
            held = held.slice(done)
    if held is not None and held.num_rows:
        yield linked(held)


def link_alike(hashes: list[np.ndarray]) -> np.ndarray:
    """Labels of sets of distinct hashes, linked where Jaccard is `ALIKE` or more."""
    sizes = np.array([len(own) for own in hashes])
    names, number = np.unique(np.concatenate(hashes), return_inverse=True)
    order = np.argsort(number, kind="stable")
    holders = np.repeat(np.arange(len(sizes)), sizes)[order]
    first = np.searchsorted(number[order], np.arange(len(names) + 1))
    ends, label = np.cumsum(sizes), np.arange(len(sizes))
    for i, size in enumerate(sizes):
        # The smaller size over the larger bounds the index from above.
        others = (np.minimum(sizes, size) / np.maximum(sizes, size) >= ALIKE) & (label != label[i])
        if others.any():
            own = number[ends[i] - size : ends[i]]
            n = first[own + 1] - first[own]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[own], n)
            shared = np.bincount(holders[at], minlength=len(sizes))
            good = np.flatnonzero(others & (shared / (sizes + size - shared) >= ALIKE))
            link(label, np.full(len(good), i), good)
    return label


def _near_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As `_stars`, for near-copies: (code, first) of texts that are alike."""

    def linked(codes: list[int], hashes: list[np.ndarray]) -> pa.RecordBatch:
        codes, label = np.array(codes), link_alike(hashes)
        tied = np.flatnonzero(codes != codes[label])
        return pa.RecordBatch.from_arrays(
            [pa.array(codes[tied]), pa.array(codes[label[tied]])], ["code", "first"]
        )

    shard, codes, hashes = None, [], []
    for batch in batches:
        rows = zip(*(batch[name].to_pylist() for name in ("shard", "code", "text")), strict=True)
        for key, code, text in rows:
            if key != shard and codes:
                yield linked(codes, hashes)
                codes, hashes = [], []
            shard = key
            codes.append(code)
            hashes.append(np.unique(shingle_hashes(text.lower().split(), NEAR_WORDS)))
    if codes:
        yield linked(codes, hashes)


# What tells the row of a text: its hash and the document's id, in columns that
# are never null, so that joins and grouping by them share a partitioning.
PLACE = ["text_hash", "id0", "none"]


def _placed(rows: DataFrame) -> DataFrame:
    none = F.col("doc_id").isNull()
    return rows.withColumn("id0", F.coalesce("doc_id", F.lit(0).cast("long"))).withColumn("none", none)


def _divided(shared: DataFrame, rows: DataFrame, shard: int) -> DataFrame:
    """`key`, `n` and place of texts in shards; keys of many texts are divided by `MORE` others."""
    hot = shared.filter(F.col("n") > shard)
    if hot.isEmpty():
        return shared
    held = possible(rows.select(*PLACE, "more"), hot, "text_hash")
    placed = hot.join(held, PLACE).select("key", *PLACE, F.posexplode("more").alias("at", "other"))
    placed = placed.select(F.xxhash64("key", "at", "other").alias("key"), *PLACE).distinct()
    sizes = placed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    placed = placed.join(sizes, "key").select("key", "n", *PLACE)
    return shared.filter(F.col("n") <= shard).unionByName(placed)


def _dealt(members: DataFrame, shard: int, load: Column) -> DataFrame:
    """`shard` and place of texts, from their `key`, its load `n` and their `size`.

    A key of a larger load than `shard` is cut into bands of sizes, and these into
    chunks. Chunks of a band meet, and meet those of the next band.
    """
    band = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(math.log(BAND))).cast("int")
    hot = members.filter(F.col("n") > shard).withColumn("band", band)
    counts = hot.groupBy("key", "band").agg(F.ceil(load / F.lit(shard)).cast("int").alias("parts"))
    # One entry for each band: there are as many as powers of `BAND` up to the largest size.
    parts = counts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("parts"))
    own = F.pmod(F.xxhash64("text_hash"), F.col("parts")[F.col("band")]).cast("int").alias("own")
    hot = hot.join(parts, "key").select("key", *PLACE, "band", "parts", own)

    def pairs(other: Column, make) -> Column:
        there = F.coalesce(F.col("parts")[other], F.lit(0))
        return F.when(there > 0, F.transform(F.sequence(F.lit(0), there - 1), make)).otherwise(F.array())

    at = F.col("band")
    named = lambda a, p, b, q: F.struct(a.alias("a"), p.alias("p"), b.alias("b"), q.alias("q"))
    every = F.concat(
        pairs(at, lambda q: named(at, F.least("own", q), at, F.greatest("own", q))),
        pairs(at + 1, lambda q: named(at, F.col("own"), at + 1, q)),
        pairs(at - 1, lambda q: named(at - 1, q, at, F.col("own"))),
    )
    hot = hot.select("key", *PLACE, F.explode(every).alias("pair"))
    whole_ones = members.filter(F.col("n") <= shard)
    return whole_ones.select(F.xxhash64("key", F.lit("whole")).alias("shard"), *PLACE).union(
        hot.select(F.xxhash64("key", "pair").alias("shard"), *PLACE)
    )


def _laid(dealt: DataFrame) -> DataFrame:
    laid = dealt.repartition(parallelism(dealt.sparkSession), "shard")
    return laid.sortWithinPartitions("shard", "code")


def _joined_groups(groups: DataFrame, shard: int, load: Column) -> DataFrame:
    """Members with `key` and load `n`: groups that overlap are one, if it fits a shard."""
    firsts = groups.groupBy("key").agg(F.min("text_hash").alias("first"))
    edges = groups.join(firsts, "key").select(F.col("text_hash").alias("code"), "first").filter("code <> first")
    nodes = components(edges.distinct())
    columns = ["code", "size", *PLACE]
    rooted = groups.select(*columns).distinct().join(nodes.withColumnRenamed("code", "text_hash"), "text_hash", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "text_hash"))
    rooted = materialise(rooted, "rooted")
    release(nodes)
    loads = rooted.groupBy("root").agg(load.alias("n"))
    joined = rooted.join(loads.filter(F.col("n") <= shard), "root").select(
        F.xxhash64("root", F.lit("root")).alias("key"), "n", *columns
    )
    large = rooted.join(loads.filter(F.col("n") > shard), "root").select(*PLACE)
    own = groups.join(groups.groupBy("key").agg(load.alias("n")), "key").join(large, PLACE, "left_semi")
    members = materialise(joined.unionByName(own.select("key", "n", *columns)), "members")
    release(rooted)
    return members


def near_links(rows: DataFrame, docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Star edges (code, first) between texts that are alike.

    `rows` is a stored table as `with_sketches` makes it of `docs`. Copies of a
    text are merged before anything is counted; only texts that share a key with
    another have their sketches moved, and only those of groups their texts.
    """
    rows = _placed(rows)
    keyed = rows.select("doc_id", "text_hash", F.explode("keys").alias("key"))
    texts = _placed(keyed.groupBy("key", "text_hash").agg(F.min("doc_id").alias("doc_id")))
    sizes = texts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = materialise(texts.join(sizes, "key").select("key", "n", *PLACE), "shared")
    near = Filter(shared, "text_hash")
    sized = _divided(shared, rows, shard).join(near.possible(rows.select(*PLACE, "size")).distinct(), PLACE)
    dealt = _dealt(sized, shard, F.count("*"))
    held = rows.select(*PLACE, F.col("fingerprint").alias("code"), "size", "sketch", "doc_id")
    held = near.possible(held).dropDuplicates(PLACE)
    columns = ["shard", "code", "size", "sketch", "doc_id", "text_hash"]
    laid = _laid(dealt.join(held, PLACE).select(*columns))
    kind = "key long, code long, size long, doc_id long, text_hash long"
    groups = _placed(materialise(laid.mapInArrow(_near_groups, kind).distinct(), "groups"))
    load = F.greatest(F.count("*"), F.ceil(F.sum("size") / F.lit(LOAD)))
    members = _joined_groups(groups, shard, load)
    release(shared)
    dealt = _dealt(members, shard, load)
    moved = possible(_placed(_texts(docs)).select(*PLACE, "text"), members, "text_hash")
    once = members.select(*PLACE, "code").distinct()
    moved = moved.join(once, PLACE).dropDuplicates(PLACE)
    laid = _laid(dealt.join(moved, PLACE).select("shard", "code", "text"))
    found = materialise(laid.mapInArrow(_near_stars, "code long, first long").distinct(), "near-stars")
    release(groups)
    release(members)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(code, root) of every node of the edges (code, first).

    Alternates large-star and small-star contraction until nothing changes.
    """
    low, high = F.least("code", "first"), F.greatest("code", "first")
    stars = materialise(edges.select(high.alias("u"), low.alias("v")).distinct(), "links")
    mark, seen = F.struct(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))), None
    while (now := stars.agg(mark.alias("mark")).head().mark) != seen:
        seen, last = now, stars
        both = stars.union(stars.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        ))).filter("u <> v").distinct()
        stars = materialise(small, "links")
        release(last)
    return stars.select(F.col("u").alias("code"), F.col("v").alias("root"))


def near_duplicates(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """fingerprint, root and component_id; one row for each fingerprint.

    `rows` is a stored table of doc_id and fingerprint; `more` has more edges.
    """
    codes = rows.groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("first_id"))
    codes = materialise(codes, "codes")
    edges = links(codes)
    nodes = components(edges if more is None else edges.union(more))
    rooted = codes.join(nodes, "code", "left").withColumn("root", F.coalesce("root", "code"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = rooted.join(ids, "root").select(
        F.col("code").alias("fingerprint"), "root", "first_id", "component_id"
    )
    found = materialise(found, "components")
    for table in (edges, nodes, codes):
        release(table)
    return found


def with_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    rows = materialise(with_fingerprints(docs), "fingerprints")
    found = near_duplicates(rows).select("fingerprint", "component_id")
    return rows.join(found, "fingerprint").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each group of near-copies, unchanged.

    Ids, hashes and sketches are grouped. Documents that a filter of all members
    of groups rules out stay where they lie; the others move once, keyed by place.
    """
    rows = materialise(with_sketches(docs), "sketches")
    more = near_links(rows, docs)
    found = near_duplicates(rows, more).select("fingerprint", "root", "component_id")
    placed = _placed(rows.select("doc_id", "text_hash", "fingerprint")).join(found, "fingerprint")
    placed = materialise(placed.select(*PLACE, "doc_id", "root", "component_id"), "placed")
    several = placed.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root")
    members = placed.join(several, "root")
    first = members.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("root").agg(F.min(F.struct("none", *PLACE[:2])).alias("_first"))
    first = first.select(*[F.col("_first")[name].alias(name) for name in PLACE], F.lit(1).alias("kept"))
    every = members.select(*PLACE, F.lit(0).alias("kept")).unionByName(first)
    status = materialise(every.groupBy(*PLACE).agg(F.max("kept").alias("kept")), "status")
    for table in (rows, more, found, placed):
        release(table)
    key = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_hash"))
    key, grouped = _placed(key).drop("doc_id"), Filter(status, "text_hash")
    alone = grouped.impossible(key).select("_row.*")
    # One of each kept place; the filter also lets some through that are alone.
    moved = grouped.possible(key).join(status, PLACE, "left").filter(F.coalesce("kept", F.lit(1)) == 1)
    return alone.unionByName(moved.dropDuplicates(PLACE).select("_row.*"))
