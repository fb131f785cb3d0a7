"""Phrase counts that are kept folder by folder and merge when they are read.

Counting has two levels: within a folder, when it is added, and over folders, when
the band is asked for. A folder's counts are a table of its own, listed in a
manifest; adding a folder reads nothing of the others, and adding it again puts
its new table in the place of the old one. Counts are rows (phrase, irmark, n), so
neither level collects a list before it is known to be short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.operators.bloom import Filter
from filings.operators.manifest import Manifest
from filings.operators.phrases import BAND
from filings.operators.storage import materialise

_COUNTS = "phrase string, irmark string, n long"
_FOLDERS = "folder string, `table` string, phrases long, postings long"


class FolderCounts:
    """Counts below `path`, which is empty or was written by this class."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.manifest = spark, Manifest(spark, path, _FOLDERS)

    def folders(self) -> DataFrame:
        """folder, table, phrases (rows of the table) and postings (their sum)."""
        return self.manifest.rows()

    def add(self, folder: str, postings: DataFrame) -> None:
        """Count the postings (phrase, irmark) of a folder, in place of earlier ones."""
        before = self.manifest.version()
        table = self.manifest.new_table()
        postings.groupBy("phrase", "irmark").agg(F.count("*").alias("n")).write.parquet(table)
        made = self.spark.read.schema(_COUNTS).parquet(table)
        row = made.agg(F.count("*").alias("phrases"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
        name = F.lit(table.rsplit("/", 1)[-1]).alias("table")
        others = self.manifest.rows(before).filter(F.col("folder") != folder)
        listed = others.unionByName(row.select(F.lit(folder).alias("folder"), name, "phrases", "postings"))
        self.manifest.commit(listed.coalesce(1), before)

    def remove(self, folder: str) -> None:
        before = self.manifest.version()
        self.manifest.commit(self.manifest.rows(before).filter(F.col("folder") != folder).coalesce(1), before)

    def vacuum(self) -> int:
        """Delete tables of folders that are counted anew or removed; returns how many.

        What was read from an earlier version can no longer be computed then.
        """
        kept = {row["table"] for row in self.folders().collect()}
        tables = {
            row["table"]
            for version in range(1, self.manifest.version() + 1)
            for row in self.manifest.rows(version).collect()
        }
        for table in tables - kept:
            self.manifest.delete(f"{self.manifest.path}/{table}")
        return len(tables - kept)

    def counts(self) -> DataFrame:
        """phrase, irmark and n, a row for each folder that has them."""
        # One row for each folder.
        tables = [f"{self.manifest.path}/{row['table']}" for row in self.folders().collect()]
        if not tables:
            return self.spark.createDataFrame([], _COUNTS)
        return self.spark.read.schema(_COUNTS).parquet(*tables)

    def band(self, low: int = BAND[0], high: int = BAND[1]) -> DataFrame:
        """As `phrase_band` of the postings of all folders."""
        counts = self.counts()
        totals = counts.groupBy("phrase").agg(F.sum("n").alias("total"))
        in_band = materialise(totals.filter(F.col("total").between(low, high)), "in-band")
        rows = Filter(in_band, "phrase").possible(counts).join(in_band, "phrase")
        each = F.flatten(F.collect_list(F.array_repeat("irmark", F.col("n").cast("int"))))
        return rows.groupBy("phrase").agg(F.sort_array(each).alias("irmarks"), F.first("total").alias("n"))
