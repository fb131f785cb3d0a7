"""Files by name: whole or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from filings.sinks import named
from filings.sinks.named import DONE, checked, write_named
from filings.sources.corpus import read_corpus


def found(path):
    return {
        os.path.relpath(os.path.join(folder, name), path): open(os.path.join(folder, name), "rb").read()
        for folder, _, names in os.walk(path) for name in names if not name.endswith(".crc")
    }


def test_a_file_for_each_row(spark, tmp_path):
    rows = [(f"a{i % 3}/b/{i}.bin", bytes([i]) * i) for i in range(40)] + [("top", None), ("é x.txt", "ü".encode())]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(5)
    path = str(tmp_path / "out")
    write_named(files, path)
    assert found(path) == {name: content or b"" for name, content in rows} | {DONE: b""}
    write_named(spark.createDataFrame([("more", b"1")], "name string, content binary"), f"file:{path}")
    assert found(path)["more"] == b"1" and len(found(path)) == 44
    with pytest.raises(Exception, match="top"):
        write_named(spark.createDataFrame([("fresh", b"2"), ("top", b"2")], "name string, content binary"), path)
    assert len(found(path)) == 44 and found(path)["top"] == b""


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 100, 1, 4).select(F.col("id").cast("string").alias("name"), F.lit(b"x").alias("content"))
    broken = rows.withColumn("content", F.when(F.col("name") == "99", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        write_named(broken, path)
    assert not os.path.exists(path)
    with pytest.raises(Exception, match="more than one row"):
        write_named(rows.union(rows.limit(1)), path)
    assert not os.path.exists(path)
    write_named(rows, path)
    assert len(found(path)) == 101


def test_names_stay_below_the_folder(spark, tmp_path):
    for name in ("", None, "/etc/x", "a//b", "../x", "a/..", "_staging-1/x"):
        with pytest.raises(ValueError, match="no name"):
            checked(name)
    with pytest.raises(Exception, match="no name"):
        write_named(spark.createDataFrame([("../x", b"")], "name string, content binary"), str(tmp_path / "in"))
    assert os.listdir(tmp_path) == []


def test_names_are_stored_and_read_without_a_list(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [(f"a{i % 3}=é {i}/b [1]%20.bin", bytes([i]) * i) for i in range(40)]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(5)
    written = write_named(files, path)
    corpus = read_corpus(spark, written)
    assert {(r.path, r.folder, bytes(r.content)) for r in corpus.collect()} == {
        (f"file:{path}/{name}", f"file:{path}/{name.rpartition('/')[0]}", content) for name, content in rows
    }
    # Spark's scan, which is not made here, names them alike.
    assert {tuple(r) for r in corpus.collect()} >= {tuple(r) for r in read_corpus(spark, f"{path}/*/*").filter("length(content) > 0").collect()}
    assert "binaryFile" not in corpus._jdf.queryExecution().toString()
    empty = str(tmp_path / "empty")
    assert write_named(files.limit(0), empty).count() == 0 and found(empty) == {DONE: b""}


def test_moves_are_repeated_and_undone(spark, tmp_path):
    path = str(tmp_path / "out")
    files = spark.createDataFrame([("a", b"1"), ("b/c", b"2")], "name string, content binary")
    staged = files.mapInArrow(named._staged(path, "_staging-1"), named._STAGED).collect()
    rows = spark.createDataFrame(staged, named._STAGED)
    for _ in range(2):  # as another attempt would
        assert rows.mapInArrow(named._moved(path), named._STAGED).count() == 2
        assert found(path) == {"a": b"1", "b/c": b"2"}
    assert rows.mapInArrow(named._undone(path), named._STAGED).count() == 2 and found(path) == {}
    # A name within another: one move fails, and no file is left.
    with pytest.raises(Exception, match="x"):
        write_named(spark.createDataFrame([("x", b"1"), ("x/y", b"2")], "name string, content binary").coalesce(1), path)
    assert found(path) == {}
