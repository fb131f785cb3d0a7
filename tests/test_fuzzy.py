"""Edit distance with free ends against its table."""

import random

import numpy as np

from filings.functions import fuzzy


def brute(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, start=1):
        above, row[0] = row[0], i
        for j, y in enumerate(text, start=1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return min(row)


def test_distances_like_the_table(monkeypatch):
    rng = random.Random(4)
    make = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    pairs = [(make(rng.randint(0, 9), "ab"), make(rng.randint(0, 12), "abc")) for _ in range(300)]
    for n in (1, 63, 64, 65, 127, 128, 129, 200):
        for letters in ("ab", "abcdefghé€\U0001f600"):
            pattern = make(n, letters)
            text = make(20, letters) + "".join(c if rng.random() < 0.9 else "x" for c in pattern) + make(30, letters)
            pairs += [(pattern, text), (pattern, make(90, letters)), (pattern, "")]
    expected = [brute(p, t) for p, t in pairs]
    patterns, texts = [p for p, _ in pairs], [t for _, t in pairs]
    assert fuzzy.free_end_distances(patterns, texts).tolist() == expected
    monkeypatch.setattr(fuzzy, "BITS", 1)
    assert fuzzy.free_end_distances(patterns, texts).tolist() == expected
    assert len(fuzzy.free_end_distances([], [])) == 0


def test_shares_of_contained_texts():
    fragment = "statement of the company's aim"
    assert len(fragment) == 30
    within = "here is the " + fragment + " and so on"
    assert len(within) == 52
    shares = fuzzy.matched_shares([fragment, within, "", "", "abcd"], [within, fragment, "", "x", "wxyz"])
    assert np.allclose(shares, [60 / 82, 60 / 82, 1.0, 0.0, 0.0])


def test_long_texts_are_quick():
    import time

    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    begun = time.process_time()
    assert fuzzy.free_end_distances([text[100:2100]] * 50, [text] * 50).tolist() == [0] * 50
    assert time.process_time() - begun < 20


def test_batches_of_long_texts_are_bounded(monkeypatch):
    patterns, texts = ["needle"] * 40, ["x" * 100_000 + "nedle" + "y" * i for i in range(40)]
    sizes, batch = [], fuzzy._batch
    monkeypatch.setattr(fuzzy, "_batch", lambda p, t, words: sizes.append(sum(map(len, t))) or batch(p, t, words))
    assert fuzzy.free_end_distances(patterns, texts).tolist() == [1] * 40
    assert max(sizes) <= fuzzy.CELLS and len(sizes) == 4
