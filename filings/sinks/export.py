"""Writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.operators.storage import materialise, release
from filings.sinks.named import part_of_name, write_named

# The characters that code page 1252 puts at 0x80 to 0x9f. All
# others up to 0xff have the place that Latin-1 gives them.
_CP1252_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…",
    0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š",
    0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’",
    0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—",
    0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ",
    0x9E: "ž", 0x9F: "Ÿ",
}

# Places of the hash's digits in the names of folders: 4,096 folders at most.
HASH_FOLDERS = ((1, 1), (2, 2))
# Characters of a name, without its ending, that file systems take.
LONGEST_NAME = 240


def encode_cp1252(text: Column, errors: str = "strict") -> Column:
    """Bytes of the text in code page 1252, as a column of type binary.

    A character outside the page stops the job (`strict`) or is left out
    (`ignore`).
    """
    high = "".join(_CP1252_HIGH.values())
    outside = f"[^\\x00-\\x7f\\xa0-\\xff{high}]"
    if errors == "ignore":
        text = F.regexp_replace(text, outside, "")
    elif errors == "strict":
        message = F.concat(F.lit("not in code page 1252: "), text)
        text = F.when(text.rlike(outside), F.raise_error(message)).otherwise(text)
    else:
        raise ValueError(f"unknown error mode: {errors}")
    places = "".join(map(chr, _CP1252_HIGH))
    return F.encode(F.translate(text, high, places), "ISO-8859-1")


def csv_text(rendered: Column) -> Column:
    """Tab-separated lines as comma-separated ones, quoted where needed."""

    def field(value: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(value.rlike('[",\\r\\n]'), quoted).otherwise(value)

    def line(text: Column) -> Column:
        fields = F.array_join(F.transform(F.split(text, "\t", -1), field), ",")
        return F.when(text == "", F.lit('""')).otherwise(fields)

    return F.array_join(F.transform(F.split(rendered, "\n", -1), line), "\r\n")


def write_phrases(phrases: DataFrame, path: str, readable: bool = False) -> None:
    """Store phrases as Parquet; `readable` adds a copy as JSON lines."""
    phrases.write.parquet(path)
    if readable:
        phrases.sparkSession.read.parquet(path).write.json(path.rstrip("/") + "_json")


def write_cells(documents: DataFrame, path: str) -> None:
    columns = ("path", "irmark", "utr", "period_to", "pos", "tables", "sections")
    documents.select(*columns).write.parquet(path)


def export_tables(
    rendered: DataFrame,
    path: str,
    sep: str = "\t",
    key: tuple[str, ...] | None = None,
    errors: str | None = None,
) -> DataFrame:
    """One file per document, named by its key, in code page 1252.

    Meant for the documents of listed taxpayers, not for a whole corpus: it
    makes one file per document. The key is (irmark, pos), and `document`, a
    hash of the path, where there is one: a submission may be filed twice. The
    last part of a key names the file, the others its folders; with `document`, the
    whole key names the file, and folders are the first digits of that hash, as
    two folders for each file would take twice the disk that it takes itself (a key
    too long for one name keeps them). Two documents of one key are an error; after
    any error no file is left (`named`). Returns the stored `path` of each file, for
    `read_corpus`.
    """
    hashed = "path" in rendered.columns and key is None
    if hashed:
        rendered = rendered.withColumn("document", F.md5("path"))
        key = ("irmark", "pos", "document")
    key = key or ("irmark", "pos")
    rendered = materialise(rendered.select(*key, "rendered"), "rendered")
    twice = rendered.groupBy(*key).count().filter("count > 1").head()
    if twice:
        raise ValueError(f"more than one document has the key {tuple(twice)[:-1]}")
    text = F.col("rendered")
    if sep == ",":
        text, line_end, errors = csv_text(text), "\r\n", errors or "ignore"
    elif sep == "\t":
        line_end, errors = "\n", errors or "strict"
    else:
        raise ValueError("sep is a tab or a comma")
    content = F.concat(encode_cp1252(text, errors), F.lit(line_end.encode()))
    parts = [F.concat(F.lit(f"{name}="), part_of_name(F.col(name))) for name in key]
    name = F.concat_ws("/", *parts)
    if hashed:
        # A value has no comma in a name.
        digits = [F.substring("document", *place) for place in HASH_FOLDERS]
        flat = F.concat_ws(",", *parts)
        name = F.when(F.length(flat) <= LONGEST_NAME, F.concat_ws("/", *digits, flat)).otherwise(name)
    name = F.concat(name, F.lit(".txt"))
    written = write_named(rendered.select(name.alias("name"), content.alias("content")), path)
    release(rendered)
    return written
