"""Document fingerprints by winnowing, with DataFrame functions only.

Words are hashed, and every run of `GRAM` words gets the polynomial hash of its
words, composed from the hashes of shorter runs. Of every `WINDOW` neighbouring
runs the smallest hash is chosen, the rightmost where several are equal. A
fingerprint is the chosen (position, hash) pairs. Two texts that share
`GRAM + WINDOW - 1` words in a row share a chosen hash.

A text of fewer words than a run is one run; one of fewer runs than a window is
one window. A null text is empty; a text without words has an empty
fingerprint. Two empty fingerprints are alike (1), an empty one and another are
not (0). Equal texts have equal fingerprints.

The next document is the one with the next smaller doc_id, null last, and after
the last comes the first; a single document comes after itself. Repeated
doc_ids follow each other in the order of their texts' hashes. An empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filings.llm.common import parallelism, whole

GRAM = 5
WINDOW = 8
# Buckets of doc_id for each shuffle partition: several, so that they add up to
# partitions of about one size.
BUCKETS = 8

# Hashes are taken modulo this prime, and positions are below 2 ** 31, so that
# a hash and a position fit one long.
PRIME = (1 << 31) - 1
BASE = 1_000_003
_BITS = 31
_LAST = (1 << _BITS) - 1


def _pairs(values: Column, shift: int, combine) -> Column:
    """combine(value, the value `shift` places on); null beyond the end."""
    return F.zip_with(values, F.slice(values, shift + 1, F.size(values)), combine)


def _rolled(factor: int):
    return lambda left, right: (left * factor + right) % PRIME


def with_chosen(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Add `name`: the chosen runs as hash << 31 | (2^31 - 1 - position).

    The smallest of these has the smallest hash, then the largest position.
    Each step is a column of its own: a lambda would compute anew what it
    captures for every element.
    """
    h, two, four, runs = (f"_{name}_{part}" for part in ("h", "two", "four", "runs"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    hashes = F.transform(words, lambda w: F.xxhash64(w).bitwiseAND(F.lit(_LAST)))
    rows = rows.withColumn(h, hashes)
    rows = rows.withColumn(two, _pairs(F.col(h), 1, _rolled(BASE)))
    rows = rows.withColumn(four, _pairs(F.col(two), 2, _rolled(BASE * BASE % PRIME)))
    n = F.size(h)
    packed = F.transform(
        F.slice(four, F.lit(1), n - 4),
        lambda run, i: _packed((run * BASE + F.get(h, i + 4)) % PRIME, i),
    )
    short = F.array(_packed(F.xxhash64(h).bitwiseAND(F.lit(_LAST)) % PRIME, F.lit(0)))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn(runs, F.when(n >= GRAM, packed).when(n > 0, short).otherwise(none))
    least = runs
    for shift in (1, 2, 4):  # windows of 2, 4 and 8
        rows = rows.withColumn(f"{runs}{shift}", _pairs(F.col(least), shift, lambda x, y: F.least(x, y)))
        least = f"{runs}{shift}"
    windows = F.greatest(F.size(runs) - (WINDOW - 1), F.least(F.size(runs), F.lit(1)))
    chosen = F.array_distinct(F.slice(least, F.lit(1), windows))
    return rows.withColumn(name, chosen).drop(h, two, four, runs, *[f"{runs}{s}" for s in (1, 2, 4)])


def _packed(hash_: Column, position: Column) -> Column:
    return hash_ * (1 << _BITS) + (F.lit(_LAST) - position)


def hashes_of(chosen: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(chosen, lambda c: F.shiftright(c, _BITS)))


def printed(chosen: Column) -> Column:
    """A fingerprint as text: position:hash pairs in the order of position."""
    pair = lambda c: F.concat_ws(
        ":", F.lit(_LAST) - c.bitwiseAND(F.lit(_LAST)), F.hex(F.shiftright(c, _BITS))
    )
    return F.array_join(F.transform(chosen, pair), ",")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes of two sets of hashes, as a share of all."""
    shared = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - shared
    return F.when(every == 0, 1.0).otherwise(shared / every)


def _bucketed(rows: DataFrame, bounds: list[int]) -> DataFrame:
    """Add `bucket`, the number of bounds above doc_id; null comes after all.

    Every so many bounds are looked at first, and then those between two.
    """
    step = 1 + math.isqrt(len(bounds))
    every = lambda values: F.lit(values).cast("array<bigint>")
    reached = lambda values: F.size(F.filter(values, lambda bound: bound <= F.col("doc_id")))
    rows = rows.withColumn("_strides", reached(every(bounds[step - 1 :: step])) * step)
    near = F.slice(every(bounds), F.col("_strides") + 1, F.lit(step))
    bucket = len(bounds) - F.col("_strides") - reached(near)
    last = F.lit(len(bounds) + 1)
    return rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), last).otherwise(bucket)).drop("_strides")


def _in_order(docs: DataFrame) -> DataFrame:
    """Documents dealt to buckets of doc_id, high to low.

    Every bucket also gets, marked `guard`, the first document of the next, and
    the last bucket the very first with `wrap`; so the next document of each
    row lies in its own bucket, and texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    n = BUCKETS * parallelism(spark)
    shares = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", shares, 10_000).alias("b")).head().b or []
    rows = _bucketed(rows, sorted(set(bounds))).withColumn("tie", F.xxhash64("text"))
    firsts = _firsts(spark, rows)
    own = F.struct(F.col("bucket"), F.lit(0).alias("wrap"), F.lit(False).alias("guard"))
    before = F.struct(F.col("to_bucket").alias("bucket"), F.col("to_wrap").alias("wrap"), F.lit(True).alias("guard"))
    places = F.when(F.col("to_bucket").isNull(), F.array(own)).otherwise(F.array(own, before))
    key = F.struct("bucket", "doc_id", "tie").alias("key")
    return (
        rows.select("doc_id", "text", "tie", "bucket", key)
        .join(F.broadcast(firsts), "key", "left")
        .select("doc_id", "text", "tie", F.inline(places))
    )


def _firsts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """The key of each bucket's first row, and the bucket that it also goes to.

    One row for each bucket, so it is bounded by the number of buckets.
    """
    first = F.max(F.struct("doc_id", "tie")).alias("first")
    found = sorted(rows.groupBy("bucket").agg(first).collect(), key=lambda row: row.bucket)
    kept = [
        ((row.bucket, row.first.doc_id, row.first.tie), found[i - 1].bucket, int(i == 0))
        for i, row in enumerate(found)
    ]
    kind = "key struct<bucket:int,doc_id:bigint,tie:bigint>, to_bucket int, to_wrap int"
    return spark.createDataFrame(kept, kind)


def compared(docs: DataFrame) -> DataFrame:
    """Each document with its edited text, both fingerprints and likenesses.

    In the edited text the last third of the code points is replaced by as many
    from the start of the next document.
    """
    order = Window.partitionBy("bucket").orderBy("wrap", "guard", F.desc("doc_id"), F.desc("tie"))
    rows = _in_order(docs).withColumn("next_text", F.lead("text").over(order))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third),
        F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third),
    )
    rows = rows.withColumn("edited", edited).drop("next_text")
    rows = with_chosen(with_chosen(rows, "text", "chosen").drop("text"), "edited", "edited_chosen")
    rows = rows.withColumn("hashes", hashes_of(F.col("chosen")))
    rows = rows.withColumn("edited_hashes", hashes_of(F.col("edited_chosen")))
    rows = rows.withColumn("next_hashes", F.lead("hashes").over(order))
    return rows.filter(~F.col("guard")).select(
        "doc_id",
        "n_chars",
        "edited",
        "chosen",
        "edited_chosen",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
