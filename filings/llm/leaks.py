"""Secrets in texts: base patterns, and what a network over characters adds.

Base kinds are matched by their patterns, leftmost and without overlap within a
kind; a match that fails its test is dropped. Every match, and every word that
looks like a code (12 characters or more with a digit, or 20 or more in mixed
case), is a candidate: the network of `charnet` reads it whole, with what stands
around it. Words that reach their threshold and overlap no base span are added as
kind `key`. Base spans stay whatever the network says; `n_likely` counts those
that it, too, takes for secrets. Positions are code points, the end exclusive.

The network is trained here on labelled findings: lines of two lists, filled
with codes and with words that only look like codes, drawn by rule from a seed.

A null text is empty; an empty text has no spans. Repeated rows have a row each.
An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filings.llm import charnet
from filings.llm.charnet import Finding, Network
from filings.llm.common import whole

# The base kinds, in this order, their patterns and least lengths.
BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Whole runs: what is shorter has no match to drop.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
LEAST_VALUE, LEAST_ACCESS = 8, 16
ADDED = "key"
ORDER = {kind: i for i, kind in enumerate((*BASE, ADDED))}
# Words that may be codes.
_WORD = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+={0,2}")
_DIGIT, _LOWER, _UPPER = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
LEAST_MIXED = 20
# Characters of candidates that the network judges at a time.
WAITING = 1 << 16

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start and then by kind."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_VALUE]
    if "AKIA" in text:
        found = (m.span() for m in _ACCESS.finditer(text))
        out += [(start, end, "access") for start, end in found if end - start >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda span: (span[0], ORDER[span[2]]))


def code_words(text: str) -> list[Span]:
    """Words that look like codes."""
    out = []
    for m in _WORD.finditer(text):
        word = m[0]
        mixed = len(word) >= LEAST_MIXED and _LOWER.search(word) and _UPPER.search(word, 1)
        if mixed or _DIGIT.search(word):
            out.append((m.start(), m.end(), ADDED))
    return out


def scanned(net: Network, texts: list[str]) -> list[tuple[list[Span], int, list[Span]]]:
    """(base spans, how many of them are likely, all spans) of each text."""
    base = [base_spans(text) for text in texts]
    likely, added = [0] * len(texts), [[] for _ in texts]
    waiting, held = [], 0

    def judge() -> None:
        accepted = net.accepts([finding for _, _, finding in waiting])
        for (i, span, _), good in zip(waiting, accepted, strict=True):
            if good and span[2] == ADDED:
                added[i].append(span)
            elif good:
                likely[i] += 1

    for i, text in enumerate(texts):
        free = _apart(code_words(text), base[i])
        for span in (*base[i], *free):
            waiting.append((i, span, Finding.of(text, *span)))
            held += span[1] - span[0] + charnet.BEFORE + charnet.AFTER
            if held >= WAITING:
                judge()
                waiting, held = [], 0
    judge()
    every = [sorted(own + more, key=lambda span: (span[0], ORDER[span[2]])) for own, more in zip(base, added, strict=True)]
    return list(zip(base, likely, every, strict=True))


def _apart(words: list[Span], base: list[Span]) -> list[Span]:
    """Words that overlap no base span; both are sorted by start."""
    out, at, reach = [], 0, 0
    for start, end, kind in words:
        while at < len(base) and base[at][0] < end:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= start:
            out.append((start, end, kind))
    return out


# Labelled findings. In a line, {} is the finding; lines of the second list hold
# words that only look like codes, or codes that are no secrets.
SECRET_LINES = (
    'token = "{}"', "token: {}", 'secret = "{}"', "the secret is {} so", "api_key={}", 'api key "{}" and', "password: {}",
    'password = "{}";', "passwd={}", "Authorization: Bearer {}", "export KEY={}", '"client_secret": "{}",',
    "access key {} was", "private key {}", "login with {} as key", 'key = "{}"', "auth {}", "{}", "und {} im", '"{}"',
    "credential {} leaked", "AWS_SECRET={}", "bearer {}", "use {} here", "({})", "x-api-key: {}", "la clave {} de",
)
OTHER_LINES = (
    "{}", "page {} of", "order {} came", "number {}", "file {}", "see {} for more", "at {}", "version {}", "http://host/{}",
    "id {}", "on {}", "und {} im", "build {}", "the {} was", "({})", '"{}"', "call {} now", "in {},", "name: {}", "path {}",
)
HASH_LINES = ("commit {}", "sha256 {} ok", "checksum: {}", "md5 {}", "digest {}", "revision {} of", "etag {}", "git hash {}")
PLACE_LINES = ("password: {}", "token = {}", "api_key={}", 'secret = "{}"')


def _text(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(low, high)))


HEX, UPPER, LOWER, DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _word(rng: random.Random) -> str:
    """A made-up word."""
    return "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiouäéó" if rng.random() < 0.2 else "aeiou") for _ in range(rng.randint(1, 4)))


def _plain(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))


def secret(rng: random.Random) -> str:
    every = LOWER + UPPER + DIGITS
    while True:
        kind = rng.randrange(8)
        out = (
            _text(rng, HEX, 20, 64) if kind == 0 else
            _text(rng, HEX.upper(), 20, 48) if kind == 1 else
            _text(rng, every + "+/", 20, 64) + rng.choice(["", "=", "=="]) if kind == 2 else
            "AKIA" + _text(rng, UPPER + DIGITS, 16, 16) if kind == 3 else
            rng.choice(["ghp_", "sk_live_", "xox-", "pk_", "glpat-"]) + _text(rng, every, 20, 36) if kind == 4 else
            "eyJ" + _text(rng, every + "-_", 24, 60) if kind == 5 else
            _text(rng, LOWER + DIGITS, 16, 40) if kind == 6 else
            _text(rng, every + "_-", 14, 24)
        )
        # Such as the scan takes for a code.
        if any(c in DIGITS for c in out):
            return out


def other(rng: random.Random) -> str:
    number = lambda low, high: _text(rng, DIGITS, low, high)
    kind = rng.randrange(11)
    return (
        number(12, 20) if kind in (0, 1) else
        f"{_plain(rng)}{number(1, 4)}_{_plain(rng)}_{_plain(rng)}" if kind == 2 else
        f"{_plain(rng)}-{_plain(rng)}-{number(1, 4)}-{_plain(rng)}" if kind == 3 else
        f"20{number(2, 2)}{number(4, 4)}T{number(6, 6)}Z" if kind == 4 else
        f"{_plain(rng)}/{_plain(rng)}/{number(2, 6)}/{_plain(rng)}" if kind == 5 else
        f"{number(4, 4)}-{number(4, 4)}-{number(4, 4)}-{number(4, 4)}" if kind == 6 else
        _plain(rng) + _plain(rng) + _plain(rng) + number(1, 4) if kind == 7 else
        (_plain(rng).title() + _plain(rng).title() + _plain(rng).title() + number(0, 2)).ljust(20, "s") if kind == 8 else
        rng.choice("x0*-=_"[:2]) * rng.randint(14, 40) + "1" if kind == 9 else
        f"20{number(2, 2)}-{number(2, 2)}-{number(2, 2)}_{number(2, 2)}-{number(2, 2)}"
    )


def placeholder(rng: random.Random) -> str:
    return rng.choice(["your_key_here_", "changeme_", "example_token_", "insert_secret_", "xxxxxxxxxxxx", "dummy_value_"]) + _text(
        rng, DIGITS, 1, 4
    )


def labelled_findings(n: int, seed: int) -> tuple[list[Finding], np.ndarray]:
    """Candidates of about n drawn lines, and whether each is a secret."""
    rng, findings, labels = random.Random(seed), [], []
    for _ in range(n):
        kind = rng.random()
        value, lines, label = (
            (secret(rng), SECRET_LINES, 1) if kind < 0.5 else
            (_text(rng, HEX, 32, 64), HASH_LINES, 0) if kind < 0.55 else
            (placeholder(rng), PLACE_LINES, 0) if kind < 0.62 else
            (other(rng), OTHER_LINES, 0)
        )
        words = lambda: " ".join(_word(rng) for _ in range(rng.randint(0, 6)))
        line = rng.choice(lines)
        if rng.random() < 0.2:
            line = line.title() if rng.random() < 0.5 else line.upper()
        ahead, behind = line.split("{}")
        ends = rng.choice(["", "", "###", "!!", ".", ","])
        text = f"{words()}{ends} {ahead}{value}{behind} {words()}"
        start = text.index(f"{ahead}{value}") + len(ahead)
        base = base_spans(text)
        for span in (*base, *_apart(code_words(text), base)):
            if span[0] < start + len(value) and start < span[1]:
                findings.append(Finding.of(text, *span))
                labels.append(label)
    return findings, np.array(labels)


# Lines for training, and for calibration and thresholds; their seeds.
TRAINED, APART = (4000, 11), (2500, 12)


@cache
def network() -> Network:
    return charnet.train(*labelled_findings(*TRAINED), *labelled_findings(*APART))


def printed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, digest of base spans, all spans, n_likely."""
    net = network()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = scanned(net, batch["text"].to_pylist())
            counts = [
                pa.array([sum(s[2] == kind for s in base) for base, _, _ in rows], pa.int64()) for kind in BASE
            ]
            digests = [hashlib.sha256(printed(base).encode()).hexdigest() for base, _, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], *counts, pa.array(digests, pa.string()),
                    pa.array([printed(every) for _, _, every in rows], pa.string()),
                    pa.array([n for _, n, _ in rows], pa.int64()),
                ],
                ["doc_id", *(f"n_{kind}" for kind in BASE), "base_sha256", "spans", "n_likely"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    counts = ", ".join(f"n_{kind} long" for kind in BASE)
    return rows.mapInArrow(found, f"doc_id long, {counts}, base_sha256 string, spans string, n_likely long")
