"""Readers of corpora, lists and stored results."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.functions.literals import literal_json
from filings.operators.computed import computed
from filings.schemas import CELL_RECORD, PHRASE_RECORD
from filings.sinks.named import file_system

# Fixed value: stored lines of fewer characters hold no record.
SHORTEST_LINE = 6

# Rows of a table that one task parses.
SPREAD_ROWS = 20_000

# Bytes of files, and files, that a task reads before it hands them on.
READ_BYTES = 8 << 20
READ_FILES = 1_000


def _listed(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def with_contents(files: DataFrame) -> DataFrame:
    """Adds `content`, read in the task that has the row; rows keep their order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root, system, inner = None, None, None

        def content(path: str) -> bytes:
            nonlocal root, system, inner
            # Paths of one folder share a file system.
            folder, _, name = path.rpartition("/")
            if folder != root:
                root = folder
                system, inner = file_system(folder)
            with system.open_input_stream(f"{inner}/{name}") as file:
                return file.read()

        for batch in batches:
            at, contents, held = 0, [], 0
            for path in batch.column("path").to_pylist():
                contents.append(content(path))
                held += len(contents[-1])
                if held >= READ_BYTES or len(contents) >= READ_FILES or at + len(contents) == batch.num_rows:
                    part = batch.slice(at, len(contents))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.array(contents, pa.binary())], [*part.schema.names, "content"]
                    )
                    at, contents, held = at + len(contents), [], 0

    schema = ", ".join(f"`{name}` {kind}" for name, kind in files.dtypes)
    return files.mapInArrow(read, f"{schema}, content binary")


def read_corpus(
    spark: SparkSession,
    paths: str | Sequence[str] | DataFrame,
    min_partitions: int | None = None,
) -> DataFrame:
    """Whole files of one or many folders: `path`, `folder`, `content`.

    All folders are one scan. Spark packs small files into partitions of
    `spark.sql.files.maxPartitionBytes`; `min_partitions` spreads them further.
    Spark lists a scan on the driver. Very many files are better given as rows that
    have a `path`, which tasks read without a list.
    """
    if isinstance(paths, DataFrame):
        files = with_contents(paths.select("path"))
    else:
        files = spark.read.format("binaryFile").load(_listed(paths))
    corpus = files.select(
        "path",
        F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"),
        "content",
    )
    return corpus if min_partitions is None else corpus.repartition(min_partitions)


def spread_tasks(rows: DataFrame, n: int | None = None) -> int:
    """A task for each core at least, and for each `SPREAD_ROWS` of the `n` rows."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(cores, -(-(rows.count() if n is None else n) // SPREAD_ROWS))


def spread(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Rows over all cores, and at most about `SPREAD_ROWS` of them in a partition.

    A table of few columns has few splits for the work of parsing what is made of
    its rows: tasks would grow with the table. A source with enough splits is
    returned as it is, without a shuffle. `n` is the number of rows where it is known.
    """
    tasks = spread_tasks(rows, n)
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    return spark.read.text(_listed(paths))


def read_key_list(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Distinct first fields of a comma-separated file; it has no header."""
    first = F.substring_index("value", ",", 1)
    return read_lines(spark, paths).select(first.alias("key")).distinct()


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PHRASE_RECORD).parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Stored result of the table job: one row per attachment."""
    return spark.read.schema(CELL_RECORD).parquet(path)


def _literal_lines(spark: SparkSession, paths: str | Sequence[str], shortest: int) -> DataFrame:
    """`value` and `json` of the lines of at least so many characters."""
    lines = read_lines(spark, paths).filter(F.length(F.trim("value")) >= shortest)
    return computed(lines, json=literal_json(F.col("value")))


def read_records(
    spark: SparkSession, paths: str | Sequence[str], schema: str, required: Sequence[str] = ()
) -> DataFrame:
    """Fields of records that are printed one in a line, and `corrupt_record`.

    A record is a dict literal or a JSON object. A line that is neither, or that
    lacks a required field, has no fields: `corrupt_record` is the line as it
    stands, and null for all others. Blank lines are left out.
    """
    rows = _literal_lines(spark, paths, 1)
    keys = F.json_object_keys("json")
    whole = F.size(F.from_json(F.concat(F.lit("["), "json", F.lit("]")), "array<string>")) == 1
    good = whole & keys.isNotNull()
    for field in required:
        good = good & F.array_contains(keys, field)
    good = F.coalesce(good, F.lit(False))
    rows = computed(rows, record=F.when(good, F.from_json("json", schema)), corrupt_record=F.when(~good, F.col("value")))
    return rows.select("record.*", "corrupt_record")


def read_index(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """`irmark` of all records of a submission index, and `corrupt_record`."""
    return read_records(spark, paths, "irmark string", required=("irmark",))


def read_phrase_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Phrases that were stored as lines ('phrase', ('irmark,irmark', n)), and `corrupt_record`.

    Lines of up to five characters are left out.
    """
    rows = _literal_lines(spark, paths, SHORTEST_LINE)
    part = lambda path: F.get_json_object("json", path)
    phrase, irmarks, n = part("$[0]"), F.split(part("$[1][0]"), ","), part("$[1][1]").try_cast("long")
    good = phrase.isNotNull() & irmarks.isNotNull() & n.isNotNull() & part("$[2]").isNull()
    good = F.coalesce(good, F.lit(False))
    fields = F.struct(phrase.alias("phrase"), irmarks.alias("irmarks"), n.alias("n"))
    rows = computed(rows, record=F.when(good, fields), corrupt_record=F.when(~good, F.col("value")))
    return rows.select("record.*", "corrupt_record")


def read_stopwords(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Words of a list file, one in a line; lines that begin with # are comments.

    A stop-word list is a parameter of a job and goes into its plan, so it is
    read to the driver.
    """
    words = read_lines(spark, path).filter("value <> '' AND NOT startswith(value, '#')")
    return tuple(sorted({row.value.strip() for row in words.collect()}))
