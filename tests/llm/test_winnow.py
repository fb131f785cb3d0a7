import hashlib
import re

from filings.llm import winnow
from filings.llm.queries import op10_fingerprints

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def chosen(hashes):
    """Winnowing by its definition, over hashes of runs."""
    out, n = [], max(1, len(hashes) - winnow.WINDOW + 1) if hashes else 0
    for start in range(n):
        window = hashes[start : start + winnow.WINDOW]
        at = max(i for i, h in enumerate(window) if h == min(window)) + start
        if (at, hashes[at]) not in out[-1:]:
            out.append((at, hashes[at]))
    return out


def word_hashes(spark, text):
    words = WORD.findall(text)
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    found = frame.selectExpr("i", "xxhash64(w) & 2147483647 AS h").orderBy("i").collect()
    return [r.h for r in found]


def brute(spark, text):
    h, m, b = word_hashes(spark, text), winnow.PRIME, winnow.BASE
    if not h:
        return ""
    if len(h) < 5:
        return None
    runs = []
    for i in range(len(h) - 4):
        value = 0
        for w in h[i : i + 5]:
            value = (value * b + w) % m
        runs.append(value)
    return ",".join(f"{at}:{value:X}" for at, value in chosen(runs))


TEXTS = {
    9: " ".join(f"w{i * i % 83}" for i in range(300)),
    8: "a b c d e f g h i j k l m",
    7: "same " * 60,
    6: "one two  three\tfour\nfive",
    5: "one two",
    4: "",
    3: None,
    2: "é" * 7,
    -1: "x y z u v w " * 20_000,
}


def test_fingerprints_like_brute_force(spark, tmp_path):
    docs = [(i, t, 0) for i, t in TEXTS.items()] + [(None, "last of all " * 9, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, bucket int").write.parquet(f"{tmp_path}/documents.parquet")
    rows = op10_fingerprints(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    ordered = [(i, t or "") for i, t, _ in docs]
    for place, (i, text) in enumerate(ordered):
        row = next(r for r in rows if r.doc_id == i)
        after = ordered[(place + 1) % len(ordered)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if i != -1:
            for found, source in ((row.fingerprint, text), (row.edited_fingerprint, edited)):
                assert brute(spark, source) in (None, found)
        sets = [{p.split(":")[1] for p in f.split(",") if p} for f in (row.fingerprint, row.edited_fingerprint)]
        union = sets[0] | sets[1]
        assert abs(row.near_edited - (len(sets[0] & sets[1]) / len(union) if union else 1)) < 1e-9
        assert 0 <= row.near_next <= 1


def test_rightmost_of_equal_hashes(spark):
    frame = spark.createDataFrame([("same " * 30,)], "text string")
    found = winnow.with_chosen(frame, "text", "c").select(winnow.printed(winnow.F.col("c"))).head()[0]
    assert [int(p.split(":")[0]) for p in found.split(",")] == list(range(7, 26))


def test_shared_passage_is_found(spark):
    passage = " ".join(f"p{i}" for i in range(winnow.GRAM + winnow.WINDOW - 1))
    texts = [" ".join(f"a{i}" for i in range(40)) + f" {passage} end", f"start {passage} " + "b c d " * 20]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    a, b = (set(r[0]) for r in winnow.with_chosen(frame, "text", "c").select(winnow.hashes_of(winnow.F.col("c"))).collect())
    assert a & b


def test_few_documents(spark, tmp_path):
    one = spark.createDataFrame([(1, "abcdef", 1)], "doc_id long, text string, tie int")
    assert winnow.compared(one).head().edited == "abcdab"
    assert winnow.compared(one.limit(0)).count() == 0
    twice = one.union(one).union(one)
    assert [r.edited for r in winnow.compared(twice).collect()] == ["abcdab"] * 3


def test_buckets_count_the_bounds_above(spark):
    ids = [None, -5, 0, 3, 4, 17, 18, 99, 100]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for bounds in ([], [4], [0, 3, 17, 18], list(range(0, 100, 3))):
        for row in winnow._bucketed(rows, bounds).collect():
            above = len(bounds) + 1 if row.doc_id is None else sum(b > row.doc_id for b in bounds)
            assert row.bucket == above
