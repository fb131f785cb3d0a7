"""Counts by folder against counting everything at once, and versions of manifests."""

import os

import pytest

from filings.operators.increments import FolderCounts
from filings.operators.manifest import ConcurrentCommit, Manifest
from filings.operators.phrases import phrase_band
from filings.plans.jobs import count_folder, phrase_job
from filings.plans.sample_corpus import footer_envelopes


def frame(spark, rows):
    return spark.createDataFrame(rows, "phrase string, irmark string")


def banded(rows):
    return sorted((r.phrase, tuple(r.irmarks), r.n) for r in rows.collect())


def test_merged_folders_are_one_count(spark, tmp_path):
    folders = {
        "a": [("p", "m1"), ("p", "m1"), ("q", "m1"), ("hot", "m1")] + [("hot", f"m{i}") for i in range(300)],
        "b": [("p", "m2"), ("r", "m2"), ("hot", "m2")],
        "c": [("q", "m3"), ("p", "m1")],
    }
    counts = FolderCounts(spark, str(tmp_path / "counts"))
    assert counts.band(1, 9).count() == 0
    for name, rows in folders.items():
        counts.add(name, frame(spark, rows))
    everything = frame(spark, [row for rows in folders.values() for row in rows])
    for low, high in ((1, 1), (2, 4), (2, 500)):
        assert banded(counts.band(low, high)) == banded(phrase_band(everything, low, high))
    assert {r.folder: r.postings for r in counts.folders().collect()} == {n: len(r) for n, r in folders.items()}


def test_a_folder_again_replaces_itself_and_reads_no_other(spark, tmp_path):
    counts = FolderCounts(spark, str(tmp_path / "counts"))
    counts.add("a", frame(spark, [("p", "m1"), ("p", "m2")]))
    counts.add("b", frame(spark, [("p", "wrong")]))
    stored = {r.folder: r["table"] for r in counts.folders().collect()}
    # The table of the other folder is gone: adding must not need it.
    moved = tmp_path / "moved"
    os.rename(tmp_path / "counts" / stored["a"], moved)
    counts.add("b", frame(spark, [("p", "m3")]))
    os.rename(moved, tmp_path / "counts" / stored["a"])
    assert banded(counts.band(1, 9)) == [("p", ("m1", "m2", "m3"), 3)]
    again = {r.folder: r["table"] for r in counts.folders().collect()}
    assert again["a"] == stored["a"] and again["b"] != stored["b"]
    assert counts.vacuum() == 1 and not (tmp_path / "counts" / stored["b"]).exists()
    counts.remove("a")
    assert banded(counts.band(1, 9)) == [("p", ("m3",), 1)]
    counts.add("empty", frame(spark, []))
    assert banded(counts.band(1, 9)) == [("p", ("m3",), 1)]


def test_of_two_writers_one_fails(spark, tmp_path):
    one, two = (Manifest(spark, str(tmp_path / "m"), "a int") for _ in range(2))
    assert one.version() == 0 and one.rows().count() == 0
    one.commit(spark.range(1).selectExpr("cast(id as int) a"), 0)
    with pytest.raises(ConcurrentCommit):
        two.commit(spark.range(9).selectExpr("cast(id as int) a"), 0)
    assert two.rows().count() == 1 and two.commit(two.rows(), 1) == 2
    assert one.rows(1).count() == one.rows(2).count() == 1


def test_a_failed_folder_leaves_the_counts_as_they_were(spark, tmp_path):
    counts = FolderCounts(spark, str(tmp_path / "counts"))
    counts.add("a", frame(spark, [("p", "m1")]))
    broken = frame(spark, [("q", "m1")]).selectExpr("raise_error('broken') AS phrase", "irmark")
    with pytest.raises(Exception, match="broken"):
        counts.add("a", broken)
    assert banded(counts.band(1, 9)) == [("p", ("m1",), 1)]


def test_the_phrase_job_by_folder(spark, tmp_path):
    text = " ".join(f"word{chr(97 + i)}" for i in range(20))
    docs = spark.createDataFrame([(i, text, f"s{i % 2}") for i in range(6)], "doc_id long, text string, source string")
    envelopes = footer_envelopes(docs)
    counts = FolderCounts(spark, str(tmp_path / "counts"))
    for source in ("s0", "s1", "s0"):
        count_folder(counts, source, envelopes.filter(envelopes.path.startswith(source)))
    assert banded(counts.band(2, 9)) == banded(phrase_job(envelopes, low=2, high=9))
    assert counts.band(2, 9).count() == 1
