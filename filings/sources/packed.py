"""Many small files stored as a few large ones, and only new files read again.

Files are listed without their contents, folders in tasks; what the manifest does
not list yet is dealt to splits of about equal bytes, and each split is read and
written by one task, as one Parquet file: contents are not shuffled. The manifest has a row for each file (path, length,
time of change, digest and table), so a second run reads what is new or changed.
Empty files are left out, as by every scan of Spark.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.operators.manifest import Manifest
from filings.operators.storage import materialise, release
from filings.sinks.named import file_system
from filings.sources.corpus import with_contents

SPLIT_BYTES = 128 << 20
# Files that a task lists before it hands them on.
LISTED = 10_000

_FILES = "path string, length long, modified timestamp, digest string, `table` string, current boolean"


def _hidden(name: str) -> bool:
    """Names that scans of Spark leave out."""
    partition = name.startswith("_") and "=" in name
    return name.startswith((".", "_")) and not partition or name.endswith("._COPYING_")


def _roots(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """Paths to list in tasks, and whether the folders in them are listed as well.

    Of `folder/*` the driver sees the folder, not what is in it.
    """
    every = path.endswith("/*")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.removesuffix("/*") if every else path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(system.makeQualified(where)) or []
    roots = [(status.getPath().toString(), every) for status in found if status.isDirectory() or not every]
    if not roots:
        raise FileNotFoundError(path)
    return roots


def _in_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, length and microseconds of change of the files of each root."""

    def below(system: fs.FileSystem, root: str, inner: str, every: bool) -> Iterator[tuple[str, int, int]]:
        own = system.get_file_info(inner)
        infos = system.get_file_info(fs.FileSelector(inner)) if own.type == fs.FileType.Directory else [own]
        for info in infos:
            # Scans leave out empty files.
            if _hidden(info.base_name) or info.type == fs.FileType.File and not info.size:
                continue
            path = root if info is own else f"{root}/{info.base_name}"
            if info.type == fs.FileType.File:
                # Milliseconds, as scans have them.
                yield path, info.size, info.mtime_ns // 1_000_000 * 1_000
            elif every or "=" in info.base_name:
                yield from below(system, path, info.path, False)

    def batch_of(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        kinds = (pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "length", "micros"])

    for batch in batches:
        for root, every in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            system, inner = file_system(root)
            rows = []
            for row in below(system, root, inner, every):
                rows.append(row)
                if len(rows) == LISTED:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def listed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """path, length and modified of all files that are not empty; contents are not read.

    Paths and patterns are those of a scan. A task lists a folder.
    """
    roots = [root for path in ([paths] if isinstance(paths, str) else paths) for root in _roots(spark, path)]
    rows = spark.createDataFrame(roots, "root string, every boolean").repartition(min(len(roots), 1_000))
    files = rows.mapInArrow(_in_folders, "path string, length long, micros long")
    return files.select("path", "length", F.timestamp_micros("micros").alias("modified"))


def in_splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Add `split`: neighbours in the order of paths, of about so many bytes together.

    A file goes where the middle of its bytes lies in the bytes of all, so a split
    exceeds its size by less than its first and last file. Sums are taken
    within ranges of paths, and over the sums of the ranges.
    """
    partitions = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = files.repartitionByRange(partitions, "path").withColumn("_range", F.spark_partition_id())
    laid = materialise(laid, "listed")
    sizes = laid.groupBy("_range").agg(F.sum("length").alias("_bytes"))
    before = F.sum("_bytes").over(Window.orderBy("_range")) - F.col("_bytes")
    # One row for each range.
    starts = F.broadcast(sizes.select("_range", before.alias("_start")))
    own = Window.partitionBy("_range").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_start") + F.sum("length").over(own) - F.col("length") / 2
    placed = laid.join(starts, "_range").withColumn("split", F.floor(middle / split_bytes).cast("int"))
    return placed.drop("_range", "_start")


class PackedCorpus:
    """Files packed below `path`, which is empty or was written by this class."""

    def __init__(self, spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES):
        self.spark, self.split_bytes = spark, split_bytes
        self.manifest = Manifest(spark, path, _FILES)

    def files(self) -> DataFrame:
        """path, length, modified, digest and table of every file as it is now."""
        return self.manifest.rows().filter("current").drop("current")

    def add(self, paths: str | Sequence[str]) -> int:
        """Pack the files that are new or changed; returns how many."""
        before = self.manifest.version()
        known = self.manifest.rows(before)
        same = known.filter("current").select("path", "length", "modified")
        files = listed(self.spark, paths)
        fresh = materialise(files.join(same, ["path", "length", "modified"], "left_anti"), "fresh")
        n = fresh.count()
        if n:
            table = self.manifest.new_table()
            placed = materialise(in_splits(fresh, self.split_bytes), "splits")
            self._write(placed, table)
            made = self.spark.read.parquet(table)
            name = F.lit(table.rsplit("/", 1)[-1])
            rows = made.select("path", "length", "modified", "digest", name.alias("table"), F.lit(True).alias("current"))
            # Rows of changed files stay as marks of what to leave out.
            changed = known.join(fresh.select("path").distinct().withColumn("_new", F.lit(True)), "path", "left")
            kept = changed.withColumn("current", F.col("current") & F.col("_new").isNull()).drop("_new")
            self.manifest.commit(kept.unionByName(rows), before)
            release(placed)
        release(fresh)
        return n

    def _write(self, placed: DataFrame, table: str) -> None:
        """Contents by split: a task and a file for each."""
        splits = placed.agg(F.max("split")).head()[0] + 1
        dealt = placed.repartitionById(splits, F.col("split")).sortWithinPartitions("path")
        rows = with_contents(dealt).withColumn("digest", F.sha2("content", 256))
        rows.drop("split").write.parquet(table)

    def corpus(self) -> DataFrame:
        """`path`, `folder` and `content` of every file as it is now, as `read_corpus` has them."""
        tables = [row["table"] for row in self.files().select("table").distinct().collect()]
        if not tables:
            return self.spark.createDataFrame([], "path string, folder string, content binary")
        rows = self.spark.read.parquet(*[f"{self.manifest.path}/{name}" for name in tables])
        rows = rows.withColumn("table", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        # Few: only files that have changed since they were packed.
        old = self.manifest.rows().filter("NOT current").select("path", "table")
        folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")
        return rows.join(old, ["path", "table"], "left_anti").select("path", folder, "content")
