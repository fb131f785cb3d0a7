import hashlib
import itertools
import random
import re
import time

import numpy as np

from filings.llm import crf, pii
from filings.llm.queries import op5_pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        total = sum(map(int, odd)) + sum(sum(map(int, str(2 * int(d)))) for d in even)
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), list(PLAIN).index(kind), m.end(), kind)
        for kind, pattern in PLAIN.items() for m in re.finditer(pattern, text) if valid(kind, m[0])
    ]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_base_like_plain_patterns():
    rng = random.Random(6)
    parts = ["a.b@c.d", "@", "x@y", "@z.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111-1111 1111",
             "4111111111111111", "+1 (286) 555-5136", "+49-30 1234567890123", " ", "\n", ".", "-", "é", "007", "+", "%"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("9" * 300_000 + "." + "a" * 300_000 + "+") == []


def test_viterbi_like_enumeration():
    field, rng = crf.train(), np.random.default_rng(7)
    lengths = np.array([5, 4, 4, 2, 1])
    classes = np.full((5, 5), crf.EDGE)
    for row, n in zip(classes, lengths):
        row[:n] = rng.integers(0, crf.EDGE, n)
    labels, moves = field.viterbi(classes, lengths), field.moves + field.allowed
    for row, n, found in zip(classes, lengths, labels):
        scores = field.emissions(row[None])[0]

        def total(path):
            inside = sum(moves[a, b] for a, b in zip(path, path[1:]))
            return field.start[path[0]] + inside + sum(scores[t, y] for t, y in enumerate(path))

        best = max(itertools.product(range(len(crf.LABELS)), repeat=int(n)), key=total)
        assert abs(total(best) - total(found[:n])) < 1e-6


def test_field_learns_shapes_and_leaves_plain_lines():
    field = crf.train()
    assert field.plain_is_outside
    finder = pii.Finder(field)
    held_out = {
        'wer token = "00aa11bb22cc33dd44ee55ff66778899aabbccdd" und': [(13, 53, "secret")],
        "Phone: (415) 555-7788, thanks": [(7, 21, "contact")],
        "call 555-444-3333 soon": [(5, 17, "contact")],
        "mail eve [at] post [dot] com": [(5, 28, "contact")],
        "the year 1999 and version 2. of it": [],
        "we sold 9807915762804491 of them": [],
    }
    for text, spans in held_out.items():
        assert finder.spans([f"first line\n{text}"])[0][1] == [(a + 11, b + 11, k) for a, b, k in spans], text


def test_rows(spark, tmp_path):
    texts = ["mail a@b.org, 10.0.0.1", None, "", "é 4111111111111111\ntoken = \"" + "a1" * 20 + "\"",
             "word " * 100_000 + "1.2.3.4", "plain"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, "plain", 1), (None, "+1 234 567 8901", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, spans int").write.parquet(f"{tmp_path}/documents.parquet")
    found = op5_pii(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    for r in found:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        base = brute(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for *_, k in base) for x in PLAIN]
        assert set(joined.split(",")) - {""} <= set(r.spans.split(","))
    assert "secret:28:68" in next(r for r in found if r.doc_id == 3).spans
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    assert pii.find_pii(docs.limit(0)).count() == 0
    masked = [r[0] for r in docs.select(pii.redacted(docs["text"])).collect()]
    assert masked[0] == "mail [EMAIL], [IP]" and masked[1] is None and masked[4].endswith("word [IP]")


def test_very_long_words_take_no_longer(spark):
    finder = pii.Finder(crf.train())
    texts = ["1" * 300_000, "a@" * 100_000, "x1" * 150_000, "(" * 300_000, "a" * 300_000 + "1", "-=" * 150_000]
    begun = time.process_time()
    assert [every for _, every in finder.spans(texts)] == [[]] * len(texts)
    assert time.process_time() - begun < 20


def test_masks_overlaps_once():
    assert pii.masked("0123456789", [(1, 4, "card"), (2, 6, "phone"), (7, 8, "ip")]) == "0[CARD]6[IP]89"


def test_long_words_have_the_shape_of_their_patterns(monkeypatch):
    rng = random.Random(13)
    parts = ["a", "Z", "1", "09", "x1y2", "+", "-", "/", "_", "\"", "'", ".", ":", "=", "(", "!", "é", "token", "5,5"]
    words = ["".join(rng.choice(rng.sample(parts, 4)) for _ in range(rng.randint(1, 30))) for _ in range(40_000)]
    words += [edge + "a1" * n + edge[::-1] for edge in ("", "-", "+(", "(+", "-(-") for n in range(2, 16)]
    expected = list(map(crf.shape_class, words))
    monkeypatch.setattr(crf, "LONG", 0)
    assert list(map(crf.shape_class, words)) == expected
    assert set(expected) >= {crf.CLASSES[name] for name in ("quoted code", "bare code", "short code", "number", "mixed")}


def test_long_secrets_are_found():
    finder = pii.Finder(crf.train())
    key = ("0f1e2d3c4b5a69788796" * 15)[:300]
    for before, after in (('und "', '" im text'), ('the token = "', '" was left in'), ("password: ", " do not share")):
        text = before + key + after
        assert finder.spans([text])[0][1] == [(len(before), len(before) + 300, "secret")]
    text = 'see "' + "a1" * 150_000 + '" here'
    begun = time.process_time()
    assert finder.spans([text])[0][1] == [(5, 300_005, "secret")]
    assert time.process_time() - begun < 10
