"""Tables in versions: what is stored, listed in manifests that appear whole.

A manifest is a stored table. A version of it counts once its commit file exists,
which the file system creates only if there is none of that number; so of two
writers that start from one version, the second fails and nothing is mixed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version first."""


class Manifest:
    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._jvm = spark.sparkContext._jvm
        self._commits = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_commits")
        self._fs = self._commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        if not self._fs.exists(self._commits):
            return 0
        names = (status.getPath().getName() for status in self._fs.listStatus(self._commits))
        return max((int(name) for name in names if name.isdigit()), default=0)

    def new_table(self) -> str:
        """A path below this one that nothing else uses."""
        return f"{self.path}/{uuid.uuid4().hex}"

    def rows(self, version: int | None = None) -> DataFrame:
        """The manifest as of a version, the last one by default."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._table_of(version))

    def commit(self, rows: DataFrame, after: int) -> int:
        """Make `rows` the manifest that follows version `after`."""
        table = self.new_table()
        rows.write.parquet(table)
        commit = self._jvm.org.apache.hadoop.fs.Path(self._commits, str(after + 1))
        if self.version() != after or self._fs.exists(commit):
            raise ConcurrentCommit(f"{self.path} is beyond version {after}")
        try:
            out = self._fs.create(commit, False)
        except Exception as failure:
            raise ConcurrentCommit(f"{self.path} is beyond version {after}") from failure
        # The name alone: the folder may be moved.
        out.write(bytearray(table.rsplit("/", 1)[-1].encode()))
        out.close()
        return after + 1

    def delete(self, table: str) -> None:
        """Delete a table below this path."""
        if not table.startswith(f"{self.path}/"):
            raise ValueError(f"{table} is not below {self.path}")
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(table), True)

    def _table_of(self, version: int) -> str:
        stream = self._fs.open(self._jvm.org.apache.hadoop.fs.Path(self._commits, str(version)))
        name = bytes(stream.readAllBytes()).decode()
        stream.close()
        return f"{self.path}/{name}"
