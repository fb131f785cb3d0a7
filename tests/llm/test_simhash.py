import itertools

import numpy as np
import xxhash

from filings.llm import simhash as s


def brute_fingerprint(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_components(rows):
    codes = {i: brute_fingerprint(t) for i, t in rows}
    label = {i: i for i in codes}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(codes, 2):
            if (codes[a] ^ codes[b]).bit_count() <= 3 and label[a] != label[b]:
                low = min(label[a], label[b])
                for k in codes:
                    if label[k] in (label[a], label[b]) and label[k] != low:
                        label[k] = low
                        changed = True
    return {(i, format(codes[i], "016x"), label[i]) for i in codes}


def some_texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(words, 300)) for _ in range(6)]
    rows = []
    for b in base:
        for edit in range(8):
            text = list(b)
            for at in rng.integers(0, 300, edit):
                text[at] = "changed"
            rows.append(" ".join(text))
    rows += ["", None, " \t\n", "One", "oNe ", "one two", "É é", "É  É", "one two three", "x " * 70_000]
    return list(enumerate(rows, start=5))


def test_components_like_brute_force(spark):
    rows = some_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {tuple(r) for r in s.with_components(docs).collect()}
    assert found == brute_components(rows)


def test_chunks_of_a_large_shard_lose_no_link(spark):
    rows = [(i, brute_fingerprint(t)) for i, t in some_texts()]
    codes = sorted({c - (1 << 64) if c >> 63 else c for _, c in rows})
    frame = spark.createDataFrame([(c,) for c in codes], "code long")
    one = {tuple(r) for r in s.components(s.links(frame)).collect()}
    many = {tuple(r) for r in s.components(s.links(frame, shard=2)).collect()}
    assert one == many and one
    assert one == {tuple(r) for r in s.components(s.links(frame, broadcast_codes=0)).collect()}


def test_trees_hold_codes_and_make_the_links(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (6000, 3), dtype=np.uint64)
    codes = np.unique(centres[rng.integers(0, 900, 6000)] ^ np.bitwise_xor.reduce(flips, axis=1))
    frame = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "code long")
    bits = s.prefix_bits(len(codes))
    sizes = frame.selectExpr("code").select(s.F.explode(s.shard_keys(s.F.col("code"), bits)).alias("k")).groupBy("k").count()
    assert bits == 2 and sizes.agg(s.F.max("count")).head()[0] > 1000
    label = np.arange(len(codes))
    for at in range(len(codes)):
        near = np.flatnonzero(np.bitwise_count(codes[at] ^ codes) <= 3)
        s.link(label, np.full(len(near), at), near)
    expected = {int(codes.view(np.int64)[i]): label[i] for i in range(len(codes))}

    def same(found):
        root = {r.code: r.root for r in found.collect()}
        groups = {}
        for code, own in expected.items():
            groups.setdefault(own, set()).add(root.get(code, code))
        return all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)

    assert same(s.components(s.links(frame)))
    assert same(s.components(s.links(frame, shard=300)))
    # Without the search of the trees there are no links.
    monkeypatch.setattr(s.Forest, "find", lambda *given: iter(()))
    assert s.links(frame).count() == 0


def test_keys_of_any_length_lose_no_link(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(-(1 << 63), 1 << 63, 300)
    b = a.copy()
    for _ in range(3):
        b ^= np.int64(1) << rng.integers(0, 64, 300)
    frame = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    for bits in (0, 3, 16, 17, 25, 28):
        keys = [s.shard_keys(s.F.col(name), bits) for name in "ab"]
        assert frame.filter(~s.F.arrays_overlap(*keys)).count() == 0
        fine = [s.F.flatten(s.F.transform(k, lambda x: s.finer_keys(s.F.col(n), x, bits))) for k, n in zip(keys, "ab")]
        assert frame.filter(~s.F.arrays_overlap(*fine)).count() == 0


def test_forest_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (300, 3), dtype=np.uint64)
    codes = centres[rng.integers(0, 20, 300)] ^ np.bitwise_xor.reduce(flips, axis=1)
    groups = np.sort(rng.integers(0, 5, 300))
    forest = s.Forest(codes, groups)
    found = {(a, b) for x, y in forest.search(np.arange(300), 3) for a, b in zip(x, y)}
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 3
    near &= (groups[:, None] == groups[None]) & ~np.eye(300, dtype=bool)
    assert found == set(zip(*np.nonzero(near)))


def test_odd_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "q"), (2, None)]
    docs = spark.createDataFrame(
        [(i, t, 7, "x") for i, t in rows], "doc_id long, text string, fingerprint int, root string"
    )
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in s.with_components(docs).collect())
    assert found == [(0, 0), (0, 1), (1, 1), (1, 1), (2, 2)]
    kept = s.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, "q"), (1, "a b c"), (2, "")]
    assert s.with_components(docs.limit(0)).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_texts():
    """Families around a base whose members differ in some words, and lone texts."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for family in range(12):
        base = list(rng.choice(words, int(rng.integers(40, 900))))
        texts.append(" ".join(base))
        for edit in range(6):
            text = list(base)
            for at in rng.integers(0, len(base), 1 + len(base) * edit // 150):
                text[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(text))
    common = " ".join(rng.choice(words, 60))
    texts += [common + " " + " ".join(rng.choice(words, 200)) for _ in range(30)]
    return texts


def test_near_copies_go_and_others_stay(spark):
    texts = near_texts() + ["", " ", None, "one two"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, near int")
    kept = {r.doc_id for r in s.one_of_each(docs).collect()}
    label = list(range(len(texts)))
    sure, maybe = [], []
    for a, b in itertools.combinations(range(len(texts)), 2):
        x, y = shingles(texts[a] or ""), shingles(texts[b] or "")
        j = len(x & y) / len(x | y) if x | y else 1.0
        (sure if j >= 0.85 else maybe if j >= 0.75 else []).append((a, b))
    # Each sure link joins; what is far from all others stays.
    for a, b in sure:
        label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
    for family in {v for v in label}:
        members = [i for i, v in enumerate(label) if v == family]
        assert len(kept & set(members)) <= 1
    linked = {i for pair in sure + maybe for i in pair}
    lone = set(range(len(texts))) - linked - {len(texts) - 4, len(texts) - 3, len(texts) - 2}
    assert lone <= kept and 30 < len(lone)
    assert len(kept & set(range(len(texts) - 4, len(texts) - 1))) == 1


def test_sketch_estimates_the_jaccard_index():
    rng = np.random.default_rng(9)
    for n, shared in ((20, 18), (150, 130), (2000, 1800), (2000, 0)):
        every = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * n - shared, dtype=np.uint64)
        a, b = np.unique(every[:n]), np.unique(every[n - shared :])
        table = np.array([s.sketch(a), s.sketch(b)])
        (found,) = s.alike(table, np.array([0]), np.array([1]))
        assert abs(found - shared / (2 * n - shared)) < 0.1
    assert s.alike(np.zeros((2, s.BINS), dtype="<u2"), np.array([0]), np.array([1]))[0] == 0


def close_pairs():
    """Pairs of texts just at, above and below the bound, and their Jaccard index."""
    rng = np.random.default_rng(10)
    rows = []
    for pair in range(150):
        n = int(rng.integers(30, 500))
        cut = round(n * float(rng.uniform(0.1, 0.13))) if pair % 5 else (n := n // 9 * 9) // 9
        a = [f"p{pair}w{i}" for i in range(n + 4)]
        # The last `cut` shingles differ: Jaccard (n - cut) / (n + cut).
        rows.append((" ".join(a), " ".join(a[: n + 4 - cut] + [f"p{pair}x{i}" for i in range(cut)])))
    return rows


def test_near_copies_are_those_of_the_exact_index(spark):
    pairs = close_pairs()
    docs = spark.createDataFrame(
        [(2 * i + j, text) for i, pair in enumerate(pairs) for j, text in enumerate(pair)], "doc_id long, text string"
    )
    kept = {r.doc_id for r in s.one_of_each(docs).collect()}
    index = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    assert sum(j == 0.8 for j in index) >= 30 and 20 < sum(j < 0.8 for j in index) < 130
    # Fingerprints within the radius link, too.
    bits = [(brute_fingerprint(a) ^ brute_fingerprint(b)).bit_count() for a, b in pairs]
    apart = {2 * i + 1 for i, j in enumerate(index) if j < 0.8 and bits[i] > s.RADIUS}
    assert kept == {2 * i for i in range(len(pairs))} | apart and len(apart) > 20


def test_groups_in_chunks_lose_no_near_copy(spark):
    docs = spark.createDataFrame(list(enumerate(near_texts() * 2)), "doc_id long, text string")
    rows = s.materialise(s.with_sketches(docs), "sketches")
    one = {tuple(r) for r in s.components(s.near_links(rows, docs)).collect()}
    assert one == {tuple(r) for r in s.components(s.near_links(rows, docs, shard=2)).collect()} and one


def test_a_key_in_thousands_of_texts(spark):
    """A passage that most texts share is divided by other keys and by size; no near-copy is lost."""
    rng = np.random.default_rng(14)
    passage = " ".join(f"common{i}" for i in range(40))
    texts = [f"{passage} " + " ".join(f"d{i}w{j}" for j in range(int(rng.integers(5, 60)))) for i in range(1500)]
    texts += [text + " end" for text in texts[:200]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = s.materialise(s.with_sketches(docs), "sketches")
    sets = [shingles(text) for text in texts]
    alike = {(i, 1500 + i) for i in range(200)}
    assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a, b in alike)
    hottest = rows.select(s.F.explode("keys").alias("k")).groupBy("k").count().agg(s.F.max("count")).head()[0]
    assert hottest > 500
    found = [
        {tuple(r) for r in s.components(s.near_links(rows, docs, shard=n)).collect()} for n in (s.SHARD, 100)
    ]
    assert found[0] == found[1]
    code = {r.doc_id: r.fingerprint for r in rows.collect()}
    root = dict(found[0])
    assert all(root.get(code[a], code[a]) == root.get(code[b], code[b]) for a, b in alike)


def test_pairs_by_size_are_all_that_can_be_alike(monkeypatch):
    rng = np.random.default_rng(11)
    groups, sizes = np.sort(rng.integers(-3, 3, 200)), rng.integers(1, 60, 200)
    monkeypatch.setattr(s, "VISITS", 50)
    found = [tuple(sorted(p)) for a, b in s.pairs_by_size(groups, sizes) for p in zip(a.tolist(), b.tolist())]
    expected = {
        (a, b) for a, b in itertools.combinations(range(200), 2)
        if groups[a] == groups[b] and min(sizes[a], sizes[b]) / max(sizes[a], sizes[b]) >= s.ALIKE
    }
    assert len(found) == len(set(found)) and set(found) == expected


def test_keys_and_sketches_lose_few_short_texts():
    """Of pairs that share four of five shingles 0.032% have no key in common."""
    rng, n, lost = np.random.default_rng(12), 20_000, 0
    for _ in range(n):
        every = rng.integers(0, 1 << 64, 5, dtype=np.uint64)
        one, two = np.unique(every), np.unique(every[:4])
        shared = np.intersect1d(s.smallest_hashes(one), s.smallest_hashes(two))
        estimate = s.alike(np.array([s.sketch(one), s.sketch(two)]), np.array([0]), np.array([1]))[0]
        lost += not len(shared) or estimate < s.APART
    assert lost < 0.0008 * n


def test_smallest_hashes_in_pieces(monkeypatch):
    hashes = np.random.default_rng(3).integers(0, 1 << 64, 1000, dtype=np.uint64)
    expected = s.smallest_hashes(hashes)
    monkeypatch.setattr(s, "PIECE", 7)
    assert np.array_equal(s.smallest_hashes(hashes), expected) and len(expected) == s.KEYS + s.MORE


def test_short_near_copies_of_distant_fingerprints_go(spark):
    rows = []
    for i in itertools.count():
        words = [f"s{i}w{j}" for j in range(9)]
        a, b = " ".join(words), " ".join(words[:8])
        near = [s.majority(s.shingle_hashes(t.encode().split(), 5)) % (1 << 64) for t in (a, b)]
        if (near[0] ^ near[1]).bit_count() > 18:
            rows += [(len(rows), a), (len(rows) + 1, b)]
        if len(rows) == 40:
            break
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in s.one_of_each(docs).collect()} == set(range(0, 40, 2))
