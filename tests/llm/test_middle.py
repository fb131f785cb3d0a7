import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from filings.llm import middle
from filings.llm.queries import op13_middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text, digest = text or "", hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = [m[0] for m in TOKEN.finditer(text)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", f"<S>{s}<P>{p}<M>{m}"
    else:
        form, out = "psm", f"<P>{p}<S>{s}<M>{m}"
    chars = (None, None) if form == "plain" else (len(p), len(m))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, *chars, sha(out), sha(text))


def some_texts():
    rng = random.Random(11)
    parts = ["word", "é", "\U0001f600", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", "<", "S>", "<P", "<M>", "."]
    texts = ["".join(rng.choices(parts, [6, 2, 1, 6, 1, 2, 1, 1, 1, 1, 0.4, 0.4, 0.4, 0.02, 1], k=rng.randint(0, 60))) for _ in range(300)]
    return [*texts, None, "", " ", "\n\n", "x", " x ", "x" * 5000, " " * 5000, "ab cd " * 40_000, "a <S> b", "a<S", "<<S>x"]


def test_like_brute_force(spark, tmp_path, monkeypatch):
    rows = [(i, text, 1) for i, text in enumerate(some_texts())]
    rows += [(3, rows[3][1], 1), (None, "one two three", 1), (None, "one two three", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = op13_middle(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in found) == Counter(brute(i, text) for i, text, _ in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in found}
    assert middle.filled_in(frame.limit(0)).count() == 0


def test_small_matrices_give_the_same(monkeypatch):
    texts = [text or "" for text in some_texts()]
    one, other = np.arange(len(texts)) * 7 % 101, np.arange(len(texts)) * 13 % 97
    whole = middle.cuts(texts, one, other)
    monkeypatch.setattr(middle, "POINTS", 50)
    assert np.array_equal(middle.cuts(texts, one, other), whole)


def test_ranks_like_counting():
    rng = np.random.default_rng(5)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix, at = middle.WaveletMatrix(symbols), np.arange(n + 1)
        for symbol in range(8):
            assert np.array_equal(matrix.rank(symbol, at), np.r_[0, np.cumsum(symbols == symbol)])


@pytest.mark.parametrize("unit", ["token", "line"])
def test_every_end_of_a_unit(unit):
    for text in ["a b  c\nd \n", "\n\na\n", "a\nb", "x", " \n ", ""]:
        units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else [m[0] for m in TOKEN.finditer(text)]
        found = middle.Units([text], unit)
        assert found.n[0] == len(units)
        for k in range(len(units) + 1):
            assert found.end_of(np.array([k]))[0] == len("".join(units[:k]))


def test_whole_lines_are_restored(spark):
    docs = spark.createDataFrame([(i, f"one\ntwo {i}\n\nthree\nfour") for i in range(40)], "doc_id long, text string")
    out = middle.filled_in(docs, unit="line").join(docs, "doc_id")
    out = out.withColumn("back", middle.restored(F.col("output"), F.col("form")))
    rows = out.collect()
    assert all(r.back == r.text and r.n == 5 for r in rows)
    ends = {0, 4, 10, 11, 17, 21} | {11 + 1, 12, 18, 22}
    assert {r.prefix_chars for r in rows if r.prefix_chars is not None} <= ends
