"""Folders of exported files."""

import os
from urllib.parse import unquote_plus

import pytest
from pyspark.sql import functions as F

from filings.sinks.export import export_tables


def test_files_share_their_folders(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.concat(F.lit("order/"), "id").alias("path"), F.concat(F.lit("IR,/ é"), F.col("id") % 10_000).alias("irmark"),
        (F.col("id") % 2).cast("int").alias("pos"), F.col("id").cast("string").alias("rendered"),
    )
    written = export_tables(rows, str(tmp_path / "out"))
    folders, files = 0, {}
    for folder, _, names in os.walk(tmp_path / "out"):
        folders += 1
        files |= {os.path.join(folder, name): folder for name in names if name.endswith(".txt")}
    # A file for each document, and fewer folders than a quarter of them; there were two for each.
    assert len(files) == 20_000 and folders <= 16 + 4096 + 1
    assert {r.path.removeprefix("file:") for r in written.collect()} == set(files)
    expected = {(r.irmark, r.pos, r.document): r.rendered for r in rows.withColumn("document", F.md5("path")).collect()}
    for path, folder in files.items():
        name = os.path.basename(path).removesuffix(".txt")
        key = dict(part.split("=", 1) for part in name.split(","))
        key = (unquote_plus(key["irmark"]), int(key["pos"]), key["document"])
        assert folder.endswith(f"/{key[2][:1]}/{key[2][1:3]}")
        assert open(path).read() == expected.pop(key) + "\n"
    assert not expected
    with pytest.raises(ValueError, match="more than one document"):
        export_tables(rows.limit(3).union(rows.limit(3)), str(tmp_path / "twice"))


def test_a_long_key_keeps_folders(spark, tmp_path):
    rows = spark.createDataFrame([("a", "M" * 220, 0, "x")], "path string, irmark string, pos int, rendered string")
    (row,) = export_tables(rows, str(tmp_path / "out")).collect()
    assert f"/out/irmark={'M' * 220}/pos=0/document=" in row.path and open(row.path.removeprefix("file:")).read() == "x\n"
