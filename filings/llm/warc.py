"""Content-addressed archive of web pages.

Payload bytes are stored once, under their SHA-256. Record headers are stored
apart and exactly, one row for each page. Original records come back by a join.

Pages with equal payloads of at least `MIN_SHARED` bytes: the one with the
smallest page_id is a response, the others are revisits that refer to it.
Smaller payloads are all responses (their bytes are stored once, too). Null
html is the empty payload. A null url gives an empty target. Repeated rows each
have a record; those of the smallest page_id are all responses. A null page_id
is no page_id to refer to: such a page revisits one that has an id, else it is a
response. An empty table gives an empty archive. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.common import whole
from filings.operators.storage import new_path

MIN_SHARED = 100
DATE = "2024-01-01T00:00:00Z"

# Fixed values of the archive format.
_VERSION = "WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Paths of the two tables: `payloads` (digest, payload) and
    `headers` (header, http_header)."""

    payloads: str
    headers: str


def _uuid(*parts: Column) -> Column:
    """A record id that depends on the parts alone."""
    digest = F.md5(F.concat_ws("\x1f", *[whole(p.cast("string")) for p in parts]))
    groups = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """`Name: value` lines; fields that are null are left out."""
    return F.concat_ws(
        "", *[F.concat(F.lit(f"{name}: "), value, F.lit(_END)) for name, value in fields]
    )


def _target(url: Column) -> Column:
    """The url without characters that would end a header line."""
    return F.replace(F.replace(whole(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def digested(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and n_bytes of each page."""
    payload = whole("html").cast("binary")
    return pages.select(
        "page_id",
        "url",
        payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
    )


def payload_store(rows: DataFrame) -> DataFrame:
    """One row for each digest: its bytes and the smallest page_id.

    Map tasks merge equal payloads before the shuffle. The digest is verified:
    all payloads under it must agree in length and in a second hash.
    """
    second = F.xxhash64("payload")
    stored = rows.groupBy("digest").agg(
        F.first("payload").alias("payload"),
        F.min("page_id").alias("first_id"),
        F.min("n_bytes").alias("n_bytes"),
        (
            (F.min("n_bytes") == F.max("n_bytes")) & (F.min(second) == F.max(second))
        ).alias("same"),
    )
    clash = F.raise_error(F.lit("different payloads have one digest"))
    return stored.withColumn("digest", F.when(F.col("same"), F.col("digest")).otherwise(clash)).drop("same")


def record_headers(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The exact header of each record, and of the response inside it."""
    joined = rows.drop("payload").join(firsts.select("digest", "first_id"), "digest")
    revisit = (F.col("n_bytes") >= MIN_SHARED) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_END}"),
        _lines(
            ("Content-Type", F.lit("text/html; charset=utf-8")),
            ("Content-Length", F.col("n_bytes").cast("string")),
        ),
        F.lit(_END),
    )
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    header = F.concat(
        F.lit(f"{_VERSION}{_END}"),
        _lines(
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", _uuid(F.col("page_id"), F.col("digest"))),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", _target(F.col("url"))),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
            ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, _uuid(F.col("first_id"), F.col("digest")))),
            ("X-Page-ID", F.col("page_id").cast("string")),
            ("X-Refers-To-Page-ID", F.when(revisit, F.col("first_id").cast("string"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", block.cast("string")),
        ),
        F.lit(_END),
    )
    return joined.select(header.alias("header"), http.alias("http_header"))


def write_archive(pages: DataFrame, archive: Archive) -> None:
    rows = digested(pages)
    payload_store(rows).write.parquet(archive.payloads)
    firsts = pages.sparkSession.read.parquet(archive.payloads).select("digest", "first_id")
    record_headers(rows, firsts).write.parquet(archive.headers)


def new_archive(spark: SparkSession) -> Archive:
    return Archive(new_path(spark, "warc-payloads"), new_path(spark, "warc-headers"))


def _field(name: str) -> Column:
    """Value of a header line; null where the record has no such line."""
    value = F.regexp_extract("header", f"(?s)\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(F.contains("header", F.lit(f"\r\n{name}: ")), value)


def read_headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """The fields of the stored headers, parsed from their text."""
    return spark.read.parquet(archive.headers).select(
        _field("X-Page-ID").cast("long").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Target-URI").alias("target"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        _field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
        "header",
        "http_header",
    )


def read_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """Stored payloads, each checked against its digest while it is read."""
    stored = spark.read.parquet(archive.payloads).select("digest", "payload")
    good = F.sha2("payload", 256) == F.col("digest")
    damaged = F.raise_error(F.lit("a stored payload does not have its digest"))
    return stored.withColumn("digest", F.when(good, F.col("digest")).otherwise(damaged))


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, record_type and `record`: the whole bytes of every record."""
    headers, payloads = read_headers(spark, archive), read_payloads(spark, archive)
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit(_END + _END).cast("binary")
    record = F.concat(F.col("header").cast("binary"), F.col("http_header").cast("binary"), body, end)
    return headers.join(payloads, "digest").select("page_id", "record_type", record.alias("record"))


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write the pages to a new archive and read back what it says of each."""
    spark, archive = pages.sparkSession, new_archive(pages.sparkSession)
    write_archive(pages, archive)
    sizes = read_payloads(spark, archive).select(
        "digest", F.octet_length("payload").cast("long").alias("payload_bytes")
    )
    return read_headers(spark, archive).join(sizes, "digest").select(
        "page_id",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
