"""Sources and sinks on files."""

import csv
import glob
import os

import pytest
from pyspark.sql import functions as F

from filings.operators.phrases import phrase_band
from filings.operators.storage import materialise, release, shared_folder
from filings.operators.tables import DIVIDER
from filings.operators.terms import word_count
from filings.schemas import CELL_RECORD
from filings.sinks.export import encode_cp1252, export_tables, write_cells, write_phrases
from filings.sources.corpus import (
    read_cells,
    read_corpus,
    read_index,
    read_key_list,
    read_lines,
    read_phrases,
    read_stopwords,
    spread,
)


def test_corpus_of_many_folders(spark, tmp_path):
    wanted = {}
    for folder in ("one", "two"):
        (tmp_path / folder).mkdir()
        for n in range(3):
            content = f"<a>{folder}{n}\xff</a>".encode("latin-1")
            (tmp_path / folder / f"f{n}.xml").write_bytes(content)
            wanted[f"{folder}/f{n}.xml"] = content
    folders = [str(tmp_path / "one"), str(tmp_path / "two")]
    for options in ({}, {"min_partitions": 5}):
        corpus = read_corpus(spark, folders, **options)
        got = {
            "/".join(r.path.rsplit("/", 2)[1:]): (r.folder, bytes(r.content))
            for r in corpus.collect()
        }
        assert {k: v[1] for k, v in got.items()} == wanted
        assert {v[0].rsplit("/", 1)[1] for v in got.values()} == {"one", "two"}
    assert corpus.rdd.getNumPartitions() == 5
    assert read_corpus(spark, folders[0]).count() == 3


def test_lines_and_key_list(spark, tmp_path):
    path = tmp_path / "keys.csv"
    path.write_text('12,"a, b",x\n\n34\n12,again\nutr,name\n')
    assert read_lines(spark, str(path)).count() == 5
    keys = sorted(r.key for r in read_key_list(spark, str(path)).collect())
    assert keys == ["", "12", "34", "utr"]
    counted = word_count(read_lines(spark, str(path))).collect()
    assert {r.word: r.n for r in counted}["34"] == 1


def test_index_lines_as_json_or_single_quoted(spark, tmp_path):
    path = tmp_path / "index.txt"
    lines = [f"{{'irmark': 'M{i}', 'other': {i}}}" for i in range(12)]
    path.write_text("\n".join(lines + ['{"irmark": "M99"}']))
    marks = {r.irmark for r in read_index(spark, str(path)).collect()}
    assert marks == {f"M{i}" for i in range(12)} | {"M99"}


def test_phrases_are_stored_typed(spark, tmp_path):
    rows = [("p q", "m1"), ("p q", "m2"), ("r", "m1")]
    postings = spark.createDataFrame(rows, "phrase string, irmark string")
    path = str(tmp_path / "phrases")
    write_phrases(phrase_band(postings, 2, 9), path, readable=True)
    (row,) = read_phrases(spark, path).collect()
    assert (row.phrase, row.irmarks, row.n) == ("p q", ["m1", "m2"], 2)
    assert spark.read.json(path + "_json").count() == 1


def test_cells_are_stored_typed(spark, tmp_path):
    record = (
        "p", "m", "1", "2016", 0, [(1, [(2, ["a", ""])])], [["x", ""]],
    )
    path = str(tmp_path / "cells")
    write_cells(spark.createDataFrame([record], CELL_RECORD), path)
    (row,) = read_cells(spark, path).collect()
    assert row.tables[0].rows[0].cells == ["a", ""] and row.sections == [["x", ""]]


def test_cp1252_agrees_with_the_codec(spark):
    inside = bytes(
        b for b in range(256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
    ).decode("cp1252")
    texts = [inside, "a\x81b 漢😀é€", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    got = [r[0] for r in rows.select(encode_cp1252(F.col("t"), "ignore")).collect()]
    wanted = [t if t is None else t.encode("cp1252", "ignore") for t in texts]
    assert [g if g is None else bytes(g) for g in got] == wanted
    with pytest.raises(Exception, match="code page 1252"):
        rows.select(encode_cp1252(F.col("t"))).collect()


def test_one_file_per_document(spark, tmp_path):
    first = f"é€\tb\n1\t2\n\n\n{DIVIDER}\n\n\nq,\"r\"\t漢"
    rows = [("M1", 0, first), ("M1", 1, "only"), ("M2", 0, "x\ty")]
    rendered = spark.createDataFrame(rows, "irmark string, pos int, rendered string")
    export_tables(rendered, str(tmp_path / "csv"), sep=",")

    def only_file(*parts):
        return tmp_path.joinpath(*parts).with_suffix(".txt").read_bytes()

    lines = [line.split("\t") for line in first.split("\n")]
    with open(tmp_path / "wanted", "w", newline="", encoding="cp1252", errors="ignore") as f:
        csv.writer(f).writerows(lines)
    assert only_file("csv", "irmark=M1", "pos=0") == (tmp_path / "wanted").read_bytes()
    assert only_file("csv", "irmark=M2", "pos=0") == b"x,y\r\n"

    with pytest.raises(Exception, match="code page 1252"):
        export_tables(rendered, str(tmp_path / "bad"))
    export_tables(rendered.filter("pos = 1 OR irmark = 'M2'"), str(tmp_path / "tsv"))
    assert only_file("tsv", "irmark=M1", "pos=1") == b"only\n"
    assert only_file("tsv", "irmark=M2", "pos=0") == b"x\ty\n"


def test_documents_of_one_key_are_not_merged(spark, tmp_path):
    rows = [("a/1", "M1", 0, "x"), ("b/1", "M1", 0, "y")]
    twice = spark.createDataFrame(rows, "path string, irmark string, pos int, rendered string")
    export_tables(twice, str(tmp_path / "out"))
    files = glob.glob(str(tmp_path / "out" / "*" / "*" / "*.txt"))
    assert sorted(open(f).read() for f in files) == ["x\n", "y\n"]
    for bad in (twice.drop("path"), twice.withColumn("path", F.lit("same"))):
        with pytest.raises(ValueError, match="more than one document"):
            export_tables(bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()


def test_stop_words_are_a_list_file(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("# comment\nthe\n\n and \nthe\n")
    assert read_stopwords(spark, str(path)) == ("and", "the")


def test_released_tables_are_gone(spark):
    made = materialise(spark.range(5), "five")
    (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in made.inputFiles()}
    assert os.path.isdir(folder)
    release(made)
    assert not os.path.exists(folder)
    elsewhere = spark.read.parquet("/root/testdata/sf0.001/region.parquet")
    release(elsewhere)
    assert elsewhere.count() == 5


def test_intermediate_tables_go_to_the_shared_folder(spark):
    made = materialise(spark.range(5), "five")
    assert sorted(r.id for r in made.collect()) == list(range(5))
    (path,) = {f.rsplit("/", 2)[1] for f in made.inputFiles()}
    assert path.startswith("five-")
    assert any(shared_folder(spark).split(":")[-1] in f for f in made.inputFiles())


def test_only_small_sources_are_spread(spark):
    small = spark.range(100).coalesce(1)
    assert spread(small).rdd.getNumPartitions() == 4
    assert spread(small).count() == 100
    large = spark.range(0, 100, 1, 9)
    assert spread(large) is large


def test_partitions_of_spread_rows_do_not_grow_with_the_table(spark):
    rows = spark.range(0, 200_000, 1, 2)
    spread_rows = spread(rows)
    assert spread_rows.rdd.getNumPartitions() == 10 and spread_rows.count() == 200_000
    assert max(len(part) for part in spread_rows.rdd.glom().collect()) <= 20_100
