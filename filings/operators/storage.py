"""Intermediate tables on the shared folder of the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Folder below the warehouse for a session without spark.checkpoint.dir.
WAREHOUSE_FOLDER = "filings-tables"


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session, else a folder of its warehouse.

    The warehouse follows the default file system of the cluster, so executors
    share either. The session is left as it is.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/{WAREHOUSE_FOLDER}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path on the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write the rows once and read them back, for a result used several times.

    The written table cuts the lineage: lost executors re-read it instead of
    computing it again.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the stored tables that `df` reads; only tables written here go."""
    spark = df.sparkSession
    root = shared_folder(spark).rstrip("/").split(":", 1)[-1].lstrip("/")
    jvm = spark.sparkContext._jvm
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    for folder in sorted(folders):
        if folder.split(":", 1)[-1].lstrip("/").startswith(f"{root}/"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            conf = spark.sparkContext._jsc.hadoopConfiguration()
            path.getFileSystem(conf).delete(path, True)
