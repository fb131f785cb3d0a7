import math
from collections import Counter

import numpy as np
import pytest

from filings.llm import pieces
from filings.llm.queries import op8_sentencepiece

PIECES = ["<unk>"] + [f"<0x{i:02X}>" for i in range(256)] + ["▁a", "ab", "b", "a", "▁", "▁ab", "bb", "!", "▁▁", "c"]
KINDS = ["none"] + ["byte"] * 256 + ["text"] * (len(PIECES) - 257)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(PIECES, KINDS)


def segmentations(v, text):
    """All segmentations of a text and their probabilities, by definition."""
    texts = {v.octets[i].decode(): i for i in range(257, len(PIECES))}

    def ways(rest):
        if not rest:
            yield (), 0.0
            return
        for text_, i in texts.items():
            if rest.startswith(text_):
                for ids, score in ways(rest[len(text_) :]):
                    yield (i, *ids), score + v.scores[i]
        if rest[0] not in texts:
            own = v.spelled(ord(rest[0]))
            for ids, score in ways(rest[1:]):
                yield (*own, *ids), score + len(own) * v.byte_score

    found = dict(ways(" " + text))
    total = math.log(sum(math.exp(s) for s in found.values()))
    return {ids: s - total for ids, s in found.items()}


def test_samples_are_distinct_and_exact(vocabulary):
    sampler = pieces.Sampler(vocabulary, 4)
    texts = ["abba ab", "", "a", "aé!b  ab▁", "bbbb!abab", "c"]
    for key in range(50):
        for text, found in zip(texts, sampler.encode([key] * len(texts), texts)):
            every = segmentations(vocabulary, text) if text else {(): 0.0}
            ids = [tuple(s[0].tolist()) for s in found]
            assert len(set(ids)) == len(ids) == min(4, len(every))
            assert [s[2] for s in found] == sorted((s[2] for s in found), reverse=True)
            for i, (_, log_prob, _, inclusion) in zip(ids, found):
                assert log_prob == pytest.approx(every[i], abs=1e-9)
                assert inclusion <= 0
                assert vocabulary.decode(np.array(i, dtype=int), np.array([len(i)])) == [text]


def test_order_follows_the_law_of_sampling_without_replacement(vocabulary):
    text, n = "abb ab", 30_000
    every = segmentations(vocabulary, text)
    found = pieces.Sampler(vocabulary, 3).encode(list(range(n)), [text] * n)
    seen = Counter(tuple(tuple(s[0].tolist()) for s in samples) for samples in found)
    chance = {i: math.exp(p) for i, p in every.items()}
    for (a, b, c), times in seen.most_common(12):
        left = 1 - chance[a]
        expected = chance[a] * chance[b] / left * chance[c] / (left - chance[b])
        assert abs(times / n - expected) < 5 * math.sqrt(expected / n)
    # Horvitz-Thompson: each segmentation's estimate is right on average.
    weight = Counter()
    for samples in found:
        for ids, log_prob, _, inclusion in samples[:3]:
            weight[tuple(ids.tolist())] += math.exp(log_prob - inclusion) / n
    for ids, p in sorted(chance.items(), key=lambda item: -item[1])[:5]:
        assert weight[ids] == pytest.approx(p, rel=0.1)


def test_batches_and_memory_do_not_matter(vocabulary, monkeypatch):
    texts = [" ".join(np.random.default_rng(i).choice(["ab", "abba", "c!", "é"], 30)) for i in range(20)]
    ids = lambda found: [[s[0].tolist() for s in samples] for samples in found]
    one = ids(pieces.Sampler(vocabulary, 3).encode(list(range(20)), texts))
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    sampler = pieces.Sampler(vocabulary, 3)
    assert one == [ids(sampler.encode([i], [t]))[0] for i, t in enumerate(texts)]


def test_query_and_odd_rows(spark, tmp_path):
    rows = [(1, "The quick brown fox, été!"), (2, None), (3, ""), (4, "x" * 60_000), (5, "日本語 \n\t  \U0001f600▁ |"),
            (6, " lead and trail  "), (6, " lead and trail  "), (None, "none")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, sample int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = op8_sentencepiece(spark, str(tmp_path)).collect()
    assert all(r.exact and len(r.ids) == r.n_pieces for r in found)
    assert Counter(r.doc_id for r in found) == {1: 2, 2: 1, 3: 1, 4: 2, 5: 2, 6: 4, None: 2}
    six = [tuple(r.ids) for r in found if r.doc_id == 6]
    assert len(set(six)) == 2
    frame = pieces.encoded(docs, 2)
    again = frame.select(pieces.decoded(frame, frame["ids"]).alias("t")).distinct().collect()
    assert {r.t for r in again} == {t or "" for _, t in rows}
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_long_runs_are_cut(vocabulary):
    sampler = pieces.Sampler(vocabulary, 2)
    texts = ["ab" * 200_000, " " * 50_000, "!" * 50_000, "é" * 30_000]
    # Only the first two have more than one segmentation in this vocabulary.
    for text, n, found in zip(texts, (2, 2, 1, 1), sampler.encode([1] * 4, texts)):
        assert len(found) == n
        for ids, *_ in found:
            assert vocabulary.decode(ids, np.array([len(ids)])) == [text]
    assert len(sampler.lattices.start) < 20


def test_real_vocabulary_encodes_known_pieces():
    import sentencepiece

    v = pieces.Vocabulary.load()
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    text = "Some words, (and marks) in été 2024!\nNew line"
    for samples in pieces.Sampler(v, 4).encode([1, 2, 3], [text] * 3):
        for ids, *_ in samples:
            assert model.decode(ids.tolist()) == text


def whole_lattice(v, text):
    """Log-sum over all segmentations of a text, by definition."""
    texts = {v.octets[i].decode(): v.scores[i] for i in range(257, len(PIECES))}
    text, total = " " + text, [0.0]
    for end in range(1, len(text) + 1):
        ways = [total[end - len(t)] + s for t, s in texts.items() if text[:end].endswith(t)]
        if text[end - 1] not in texts:
            ways.append(total[end - 1] + len(v.spelled(ord(text[end - 1]))) * v.byte_score)
        total.append(math.log(sum(math.exp(w - max(ways)) for w in ways)) + max(ways))
    return total[-1]


def test_long_runs_have_the_chances_of_the_whole_lattice(vocabulary, monkeypatch):
    texts = ["b" * 1_501, "a" + " " * 1_200 + "abb", "abbb" * 400, "é" * 600 + "ab" * 500, "b" * 499 + "ab" + "b" * 700]
    for window in (pieces.WINDOW, 64):
        monkeypatch.setattr(pieces, "WINDOW", window)
        for text, found in zip(texts, pieces.Sampler(vocabulary, 3).encode([1, 2, 3, 4, 5], texts)):
            total = whole_lattice(vocabulary, text)
            for ids, log_prob, _, inclusion in found:
                score = sum(vocabulary.scores[i] if i > 256 else vocabulary.byte_score for i in ids.tolist())
                assert log_prob == pytest.approx(score - total, abs=1e-6) and inclusion <= 0
                assert vocabulary.decode(ids, np.array([len(ids)])) == [text]


def test_pieces_cross_every_place_of_a_long_run(vocabulary):
    crossed = Counter()
    for samples in pieces.Sampler(vocabulary, 1).encode(list(range(40)), ["b" * 1_200] * 40):
        (ids, *_), = samples
        ends = np.cumsum(vocabulary.lengths[ids])
        crossed.update(set(range(1, 1_201)) - set(ends.tolist()))
    assert min(crossed[at] for at in range(2, 1_200)) > 0


def test_units_that_come_again_are_built_once(vocabulary, monkeypatch):
    rng = np.random.default_rng(7)
    texts = [f"abba abab {''.join(rng.choice(list('abc!é'), 25))} cab" for _ in range(60)]
    expected = [pieces.Sampler(vocabulary, 3).encode([i], [text])[0] for i, text in enumerate(texts)]
    monkeypatch.setattr(pieces, "REMEMBERED", 300)
    sampler, built = pieces.Sampler(vocabulary, 3), Counter()
    build = sampler.lattices._build
    monkeypatch.setattr(sampler.lattices, "_build", lambda units: (built.update(units), build(units)))
    for i, text in enumerate(texts):
        found = sampler.encode([i], [text])[0]
        assert [s[0].tolist() for s in found] == [s[0].tolist() for s in expected[i]]
        assert [s[1:] for s in found] == [pytest.approx(s[1:], abs=1e-9) for s in expected[i]]
        assert sampler.lattices.first.size < 400
    assert built[" abba"] == built[" abab"] == built[" cab"] == 1
    assert len(built) > len(sampler.lattices.start)  # others were forgotten


def test_noise_is_drawn_only_where_the_best_may_depart(vocabulary, monkeypatch):
    texts, drawn = ["abba ab! " * 800, "ab", "é", "abbabb " * 300], Counter()
    truncated = pieces.truncated
    monkeypatch.setattr(pieces, "truncated", lambda p, b, k: (drawn.update(all=len(p)), truncated(p, b, k))[1])
    found = pieces.Sampler(vocabulary, 4).encode([1, 2, 3, 4], texts)
    steps = sum(len(ids) for samples in found for ids, *_ in samples)
    assert drawn["all"] < steps / 10
    # The rest could not change anything: noise lies within the spread.
    ends = np.array([0.5, 2.0**52 - 0.5]) / 2.0**52
    assert np.ptp(-np.log(-np.log(ends))) < pieces.SPREAD
    monkeypatch.setattr(pieces, "SPREAD", np.inf)
    for some, every in zip(found, pieces.Sampler(vocabulary, 4).encode([1, 2, 3, 4], texts), strict=True):
        assert [s[0].tolist() for s in some] == [s[0].tolist() for s in every]
        assert [s[1:] for s in some] == [s[1:] for s in every]
