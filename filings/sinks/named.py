"""Writes each row as a file of its own name.

Tasks write below a staging folder of the job and tell what they wrote in a stored
table. Only when all have ended and the names are found to differ, and to be free,
do tasks move the files to their names; no name passes the driver. What fails
before leaves nothing but staged files, which go with the folder; if a move fails,
files moved before are deleted. Names are relative paths; a file that exists is
never replaced. A `_SUCCESS` file follows the last one.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.operators.storage import materialise, release

DONE = "_SUCCESS"

_STAGED = "staged string, name string"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an absolute path, which is not escaped, and the path within it."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    scheme, rest = path.split("://", 1)
    authority, _, inner = rest.partition("/")
    system, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return system, f"{root.rstrip('/')}/{inner}"


def qualified(spark: SparkSession, path: str) -> str:
    """A path as scans of Spark name it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(where).toString()


def checked(name: str | None) -> None:
    """A name is a relative path that stays below the folder."""
    parts = (name or "").split("/")
    if any(part in ("", ".", "..") for part in parts) or parts[0].startswith("_staging-"):
        raise ValueError(f"no name for a file: {name}")


def part_of_name(value: Column) -> Column:
    """A value as part of a file's name."""
    return F.coalesce(F.url_encode(value.cast("string")), F.lit("__null__"))


def _is_file(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type == fs.FileType.File


def _staged(path: str, staging: str):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        # Attempts of one task do not share a folder.
        folder, written = f"{root}/{staging}/{uuid.uuid4().hex}", 0
        for batch in batches:
            if not written:
                system.create_dir(folder, recursive=True)
            names, staged = batch.column("name").to_pylist(), []
            for name, content in zip(names, batch.column("content"), strict=True):
                checked(name)
                staged.append(f"{folder}/{written}")
                written += 1
                with system.open_output_stream(staged[-1]) as out:
                    if content.is_valid:
                        out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(staged, pa.string()), pa.array(names, pa.string())], ["staged", "name"])

    return stage


def _taken(path: str):
    """Rows whose name a file has."""

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        for batch in batches:
            infos = system.get_file_info([f"{root}/{name}" for name in batch.column("name").to_pylist()])
            yield batch.filter(pa.array([info.type == fs.FileType.File for info in infos], pa.bool_()))

    return taken


def _moved(path: str):
    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        made = None
        for batch in batches:
            for staged, name in zip(batch.column("staged").to_pylist(), batch.column("name").to_pylist(), strict=True):
                target = f"{root}/{name}"
                if posixpath.dirname(target) != made:
                    made = posixpath.dirname(target)
                    system.create_dir(made, recursive=True)
                try:
                    system.move(staged, target)
                except OSError:
                    # An earlier attempt of the task has moved it.
                    if _is_file(system, staged) or not _is_file(system, target):
                        raise
            yield batch

    return move


def _undone(path: str):
    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        for batch in batches:
            for staged, name in zip(batch.column("staged").to_pylist(), batch.column("name").to_pylist(), strict=True):
                if not _is_file(system, staged) and _is_file(system, f"{root}/{name}"):
                    system.delete_file(f"{root}/{name}")
            yield batch

    return undo


def _clear(path: str, staging: str) -> None:
    system, root = file_system(path)
    if system.get_file_info(f"{root}/{staging}").type == fs.FileType.Directory:
        system.delete_dir(f"{root}/{staging}")


def _clear_if_empty(path: str) -> None:
    # A folder that held nothing but the staging one was made by this job.
    system, root = file_system(path)
    if system.get_file_info(root).type == fs.FileType.Directory and not system.get_file_info(fs.FileSelector(root)):
        system.delete_dir(root)


def write_named(files: DataFrame, path: str) -> DataFrame:
    """Write rows (name, content) as files below `path`; returns the stored `path` of each.

    The stored rows can be given to `read_corpus`, which then lists nothing, and to
    `release`.
    """
    path, staging = qualified(files.sparkSession, path).rstrip("/"), f"_staging-{uuid.uuid4().hex}"
    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    staged = None
    try:
        staged = materialise(rows.mapInArrow(_staged(path, staging), _STAGED), "staged")
        twice = staged.groupBy("name").count().filter("count > 1").head()
        if twice:
            raise ValueError(f"more than one row has the name {twice.name}")
        there = staged.mapInArrow(_taken(path), _STAGED).head()
        if there:
            raise FileExistsError(f"{path}/{there.name}")
        try:
            moved = staged.mapInArrow(_moved(path), _STAGED)
            written = materialise(moved.select(F.concat(F.lit(f"{path}/"), "name").alias("path")), "written")
        except Exception:
            staged.mapInArrow(_undone(path), _STAGED).write.format("noop").mode("overwrite").save()
            raise
    except Exception:
        _clear(path, staging)
        _clear_if_empty(path)
        raise
    finally:
        if staged is not None:
            release(staged)
    _clear(path, staging)
    system, root = file_system(path)
    system.create_dir(root, recursive=True)
    with system.open_output_stream(f"{root}/{DONE}"):
        pass
    return written
