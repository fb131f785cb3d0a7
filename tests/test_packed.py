"""Packed corpora: whole contents, even splits, and second runs that read what is new."""

import os

from filings.sources.corpus import read_corpus
from filings.sources.packed import PackedCorpus, in_splits, listed


def write(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def contents(rows):
    return {r.path.split("/in/")[1]: bytes(r.content) for r in rows.collect()}


def test_new_and_changed_files_alone_are_packed(spark, tmp_path):
    files = {f"f{i % 4}/d{i}.xml": bytes([i]) * (i * 37 % 500 + 1) for i in range(60)} | {"f0/large.xml": b"x" * 30_000}
    files["f1/odd [1]{2} é*.xml"] = b"odd"
    # A scan of Spark leaves out empty files.
    write(tmp_path / "in", files | {"f0/empty.xml": b""})
    packed = PackedCorpus(spark, str(tmp_path / "packed"), split_bytes=4_000)
    folders = str(tmp_path / "in" / "*")
    assert packed.corpus().count() == 0
    assert packed.add(folders) == len(files) and contents(packed.corpus()) == files
    assert packed.add(folders) == 0 and packed.manifest.version() == 1
    before = {r.path: r["table"] for r in packed.files().collect()}
    more = {"f9/new.xml": b"new", "f1/odd [1]{2} é*.xml": b"changed"}
    write(tmp_path / "in", more)
    assert packed.add(folders) == 2 and contents(packed.corpus()) == files | more
    after = {r.path: r["table"] for r in packed.files().collect()}
    moved = {p for p in after if after[p] != before.get(p)}
    assert len(moved) == 2 and len(after) == len(files) + 1
    columns = read_corpus(spark, folders).columns
    assert packed.corpus().columns == columns
    assert {tuple(r) for r in packed.corpus().select("path", "folder").collect()} == {
        tuple(r) for r in read_corpus(spark, folders).select("path", "folder").collect()
    }


def test_splits_are_even_and_are_files(spark, tmp_path):
    write(tmp_path / "in", {f"d{i:03}.xml": b"y" * (i * 91 % 800 + 1) for i in range(200)})
    rows = in_splits(listed(spark, str(tmp_path / "in")), 10_000).collect()
    loads = {}
    for r in rows:
        loads[r.split] = loads.get(r.split, 0) + r.length
    total = sum(i * 91 % 800 + 1 for i in range(200))
    assert len(loads) == -(-total // 10_000) and max(loads.values()) <= 10_800
    assert all(load >= 9_200 for split, load in loads.items() if split < max(loads))
    packed = PackedCorpus(spark, str(tmp_path / "packed"), split_bytes=10_000)
    packed.add(str(tmp_path / "in"))
    table = packed.files().head()["table"]
    parts = [name for name in os.listdir(tmp_path / "packed" / table) if name.startswith("part-")]
    assert len(parts) == len(loads)


def test_digests_tell_contents(spark, tmp_path):
    write(tmp_path / "in", {"a": b"same", "b": b"same", "c": b"other"})
    packed = PackedCorpus(spark, str(tmp_path / "packed"))
    packed.add(str(tmp_path / "in"))
    digests = {r.path[-1]: r.digest for r in packed.files().collect()}
    assert digests["a"] == digests["b"] != digests["c"]


def test_a_list_is_made_in_tasks_and_is_that_of_a_scan(spark, tmp_path):
    files = {f"f{i % 4}/d{i}.xml": bytes([65 + i]) * (i + 1) for i in range(20)}
    files |= {"top.xml": b"t", "f0/deep/x": b"x", "f1/_no": b"n", "f1/.no": b"n", "f2/a b é%20": b"z"}
    write(tmp_path / "in", files)
    root = str(tmp_path / "in")
    for paths in (f"{root}/*", f"{root}/*/*", f"{root}/f[123]", [f"{root}/f1/d*", f"{root}/top.xml"], f"{root}/{{f1,f2}}/*.xml"):
        scan = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else paths)
        scan = scan.selectExpr("path", "length", "modificationTime AS modified")
        found = listed(spark, paths)
        assert "binaryFile" not in found._jdf.queryExecution().toString()
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, scan.collect()))
    write(tmp_path / "parts", {"k=1/y": b"y", "k=2/z": b"z"})
    assert {r.path[-5:] for r in listed(spark, str(tmp_path / "parts")).collect()} == {"k=1/y", "k=2/z"}
    packed = PackedCorpus(spark, str(tmp_path / "packed"))
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert packed.add(f"{root}/f1/*") == 5
    write(tmp_path / "in", {f"f1/more{i}": b"m" for i in range(40)})
    assert packed.add(f"{root}/f1/*") == 40
    # A second run has no task for each new file.
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for job in tracker.getJobIdsForGroup(None) if job >= before for s in tracker.getJobInfo(job).stageIds]
    assert max(stage.numTasks for stage in stages if stage) < 40
