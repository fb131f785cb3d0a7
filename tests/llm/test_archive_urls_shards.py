import hashlib
import zlib

import numpy as np

from pyspark.sql import functions as F

from filings.llm import queries, shards, urls, warc

PAGES = [
    (1, "http://A.org/x", "p" * 200, 0),
    (2, "http://b.org/\r\nx", "p" * 200, 0),
    (2, "http://b.org/", "p" * 200, 0),
    (3, None, None, 0),
    (4, "", "", 0),
    (5, "http://c.org/", "short", 0),
    (6, "http://c.org/", "short", 0),
    (None, "http://c.org/", "p" * 200, 0),
    (7, "http://é.org/", "é" * 50_000, 0),
    (8, "http://é.org/", "é" * 50, 0),
    (8, "http://é.org/", "é" * 50, 0),
]
PAGE_SCHEMA = "page_id long, url string, html string, digest int"


def test_archive_reads_back(spark):
    pages = spark.createDataFrame(PAGES, PAGE_SCHEMA)
    archive = warc.new_archive(spark)
    warc.write_archive(pages, archive)
    assert spark.read.parquet(archive.payloads).count() == 5
    records = [bytes(r.record) for r in warc.read_records(spark, archive).collect()]
    assert len(records) == len(PAGES)
    for record in records:
        header, _, block = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in header.decode().split("\r\n")[1:])
        assert len(block) - 4 == int(fields["Content-Length"])
        http, _, payload = block[:-4].partition(b"\r\n\r\n")
        if fields["WARC-Type"] == "response":
            assert "sha256:" + hashlib.sha256(payload).hexdigest() == fields["WARC-Payload-Digest"]
        else:
            assert payload == b"" and fields["WARC-Refers-To"] != fields["WARC-Record-ID"]
    found = warc.archived_pages(pages).collect()
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in found)
    assert kinds == [
        (0, "revisit", 1, 200), (1, "response", None, 200), (2, "revisit", 1, 200),
        (2, "revisit", 1, 200), (3, "response", None, 0), (4, "response", None, 0),
        (5, "response", None, 5), (6, "response", None, 5), (7, "response", None, 100_000),
        (8, "response", None, 100), (8, "response", None, 100),
    ]
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_list_of_the_query_needs_the_filter_and_the_join(spark):
    """Hosts do not decide; the filter rules most urls out, lets all listed ones pass and some others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    listed = queries.listed_of(pages)
    judged = urls.judge_urls(pages, listed).filter("rule IS NULL AND host <> ''")
    mixed_hosts = judged.groupBy("host").agg(F.countDistinct("verdict").alias("n")).filter("n = 2").count()
    assert mixed_hosts > 3
    parts = urls.url_parts(pages)
    here = {r.canonical for r in listed.join(parts, "canonical", "left_semi").collect()}
    assert listed.count() > len(here) > 100
    rows = urls.possible_hits(parts, listed).collect()
    possible = {r.canonical for r in rows if r.possible}
    every = {r.canonical for r in rows}
    assert here <= possible and len(possible - here) < 0.02 * len(every)
    # A filter of few bits passes others: only the exact join removes them.
    few = spark.createDataFrame([(f"u{i}",) for i in range(4000)], "canonical string")
    urls_ = spark.createDataFrame([(i, f"u{i * 2}") for i in range(4000)], "page_id long, canonical string")
    kept, urls.BITS_PER_URL = urls.BITS_PER_URL, 2
    try:
        passed = urls.possible_hits(urls_, few).filter("possible").count()
        hits = urls.listed_urls(urls_, few).filter("listed").count()
    finally:
        urls.BITS_PER_URL = kept
    assert hits == 2000 < passed


def test_urls(spark):
    rows = [
        (1, "HTTP://Sub.Example.ORG/es/1?x#y"), (2, "http://example.org/en/12"),
        (3, "http://example.org/en/2"), (4, "no scheme"), (5, None), (6, "http://bad.net"),
        (7, "http://bad.net/"), (7, "http://bad.net/"), (8, "http://good.net/?u=://bad.net/"),
        (9, "http://notexample.org/es/"), (10, "http://x.com/de/" + "a" * 90_000),
    ]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, host int")
    listed = spark.createDataFrame([("bad.net",), ("bad.net",)], "canonical string")
    found = {(r.page_id, r.host, r.rule, r.verdict) for r in urls.judge_urls(pages, listed).collect()}
    assert found == {
        (1, "sub.example.org", "example.org/es/", "block"),
        (2, "example.org", "example.org/en/1", "block"),
        (3, "example.org", "org/", "allow"), (4, "", None, "allow"), (5, "", None, "allow"),
        (6, "bad.net", None, "block"), (7, "bad.net", None, "block"),
        (8, "good.net", None, "allow"), (9, "notexample.org", "org/", "allow"),
        (10, "x.com", "com/de/", "block"),
    }
    assert urls.judge_urls(pages, listed).count() == len(rows)
    assert urls.judge_urls(pages, listed.limit(0)).filter("listed").count() == 0
    assert urls.judge_urls(pages.limit(0), listed).count() == 0


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).selectExpr("concat('in/', id) AS canonical")
    tried = listed.union(spark.range(3000).selectExpr("concat('out/', id)"))
    found = urls.possible_hits(tried, listed).groupBy("possible").count().collect()
    counts = {r["possible"]: r["count"] for r in found}
    assert 3000 <= counts[True] < 3120


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        index = shards.hilbert_index(grid, bits)
        path = grid[np.argsort(index)]
        assert sorted(index) == list(range(1 << bits * dims))
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def documents(spark, n):
    rows = [(i, "é" * (i % 50), "en" if i % 3 else None, "s0" if i % 3 == 0 else f"s{i % 7}", 0) for i in range(n)]
    rows += [(None, None, None, None, 0), (3, "same", "de", "s", 0), (3, "same", "de", "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, curve int")


def test_shards_by_rows_and_bytes(spark, tmp_path):
    docs = documents(spark, 500)
    for law in ("rows", "bytes"):
        rows = shards.with_shards(docs, law=law).collect()
        assert len(rows) == 503
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r)
        for own in by.values():
            assert sorted(r.slot for r in own) == list(range(len(own)))
        if law == "rows":
            counts = [len(by[k]) for k in range(24)]
            assert max(counts) - min(counts) <= 1
        else:
            sizes = [sum(r.size for r in by[k]) for k in range(24)]
            assert max(sizes) - min(sizes) <= 2 * max(r.size for r in rows)
        assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {
            (r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode()))
            for r in docs.collect()
        }
    few = shards.with_shards(docs.limit(5)).collect()
    assert all(r.slot == 0 for r in few) and len({r.shard for r in few}) == 5
    assert shards.with_shards(docs.limit(0)).count() == 0
    path = str(tmp_path / "shards")
    shards.write_shards(docs, shards.with_shards(docs), path)
    assert spark.read.parquet(path).count() == 503


def cell_of_index(index, dims, bits):
    """The cell of an index of the Hilbert curve, bit by bit (Skilling's inverse transform)."""
    x = [0] * dims
    for at in range(dims * bits):
        bit = index >> (dims * bits - 1 - at) & 1
        x[at % dims] |= bit << (bits - 1 - at // dims)
    t = x[-1] >> 1
    for i in range(dims - 1, 0, -1):
        x[i] ^= x[i - 1]
    x[0] ^= t
    q = 2
    while q != 1 << bits:
        for i in range(dims - 1, -1, -1):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q <<= 1
    return x


def test_curve_like_its_inverse():
    rng = np.random.default_rng(4)
    for dims, bits in ((2, 5), (3, 4), (4, 6)):
        cells = rng.integers(0, 1 << bits, (400, dims))
        for cell, index in zip(cells.tolist(), shards.hilbert_index(cells, bits).tolist()):
            assert cell_of_index(index, dims, bits) == cell


def test_shards_like_brute_force(spark):
    rng = np.random.default_rng(12)
    rows = [
        (None if i % 41 == 0 else int(rng.integers(0, 900)), "t" * int(rng.integers(0, 200)) if i % 29 else None,
         None if i % 17 == 0 else f"l{rng.integers(0, 3)}", None if i % 23 == 0 else f"s{rng.integers(0, 90):02}")
        for i in range(700)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = shards.with_shards(docs).collect()
    cells = 1 << shards.BITS

    def string_firsts(values):
        values = sorted({v for v in values if v is not None})
        by = {}
        for at, value in enumerate(values):
            by.setdefault(at * cells // len(values), value)
        return [first for cell, first in sorted(by.items()) if cell > 0]

    def quantiles(values):
        values = sorted(v for v in values if v is not None)
        return sorted({values[max(0, -(-i * len(values) // cells) - 1)] for i in range(1, cells)})

    size = [len((t or "").encode()) + 8 for _, t, _, _ in rows]
    sources, langs = string_firsts(r[3] for r in rows), string_firsts(r[2] for r in rows)
    sizes, ids = quantiles(size), quantiles(r[0] for r in rows)
    upto = lambda bounds, v: 0 if v is None else sum(b <= v for b in bounds)
    below = lambda bounds, v: 0 if v is None else sum(b < v for b in bounds)
    keyed = []
    for (doc_id, text, lang, source), n in zip(rows, size):
        cell = np.array([[upto(sources, source), upto(langs, lang), below(sizes, n), below(ids, doc_id)]])
        index = int(shards.hilbert_index(cell, shards.BITS)[0])
        assert cell_of_index(index, 4, shards.BITS) == cell[0].tolist()
        # Nulls come first.
        keyed.append((index, doc_id is not None, doc_id or 0, zlib.crc32((text or "").encode()), n))
    expected, starts = [], {}
    for at, (index, known, doc_id, crc, n) in enumerate(sorted(keyed)):
        shard = at * 24 // len(rows)
        expected.append((doc_id if known else None, crc, n, shard, at - starts.setdefault(shard, at)))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.text_crc32, r.size, r.shard, r.slot)) for r in found)
