"""Mixes sources to target weights, with DataFrame functions only.

Targets: sources in the order of their code points, null last, have the weights
5, 2, 1, repeating, and share the size of the whole corpus by weight. No target
exceeds `EPOCHS` times the size of its source; what is over is reshared by
weight until none does.

Documents: each has an exponential key, -ln(u) / quality, with u from a hash of
the document (Efraimidis and Spirakis). A source first gives complete epochs,
all its documents so many times; of the rest it gives, in the order of the keys,
the documents whose prefix sum of sizes fits the budget. The document at the
border is taken if its larger part fits.

Size is the number of words of the text; a null text has none. A document of
size zero takes part with zero words. Repeated rows have equal keys, and each
is counted. A null doc_id is a value like any other. Extra columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, NullType, StructType

from filings.llm.common import WORD, whole
from filings.operators.storage import materialise

# The weights of sources, in turn, and the most of each document.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
# Characters that are rare in prose.
MARKS = r"[#$%&*|<>{}\[\]=_~^!]"
# Documents in a bucket of keys, about; quantiles of each source that buckets divide.
BUCKET = 1_000
QUANTILES = 32
ACCURACY = 2_000
# Sources whose targets or quantiles are sent to every executor; beyond, Spark joins.
BROADCAST_SOURCES = 50_000


def quality(text: Column, size: Column) -> Column:
    """Weight of a document, from 0.5 to 1: the less markup, the higher."""
    marks = F.regexp_count(text, F.lit(MARKS))
    return 1 / (1 + F.least(marks / F.greatest(size, F.lit(1)), F.lit(1.0)))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size and key of every document.

    The only pass over the texts. A key is a number from 0 to 1 that grows with
    the exponential key.
    """
    text = whole("text")
    rows = docs.select(
        "doc_id",
        "source",
        F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        text.alias("text"),
    )
    weight = quality(F.col("text"), F.col("size"))
    # 53 bits of the hash, so that u is above 0 and below 1.
    bits = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit("mix")), 11)
    u = (bits + 0.5) / float(1 << 53)
    return rows.select(
        "doc_id", "source", "text_hash", "size", (1 - F.exp(F.log(u) / weight)).alias("key")
    )


def targets(sizes: DataFrame) -> DataFrame:
    """Add weight and target to (source, source_size); one row for each source.

    A source is capped if the water level, the target for one unit of weight,
    is above its cap for one unit. By rising cap, the level after capping the
    first sources follows from sums over those before and after.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1)
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * EPOCHS)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - capped) / open_weight
    # The level at the first source that it does not cap holds for all after it.
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(by_cap))
    within = F.col("cap") >= F.col("level") * F.col("weight")
    first = F.min(F.when(within, F.struct("place", "level"))).over(every)
    share = first["level"] * F.col("weight")
    return rows.select(
        "source", "source_size", "weight", F.least(F.col("cap").cast("double"), share).alias("target")
    )


def _key(source: str = "source") -> Column:
    """A source as a join key that is never null."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name"))


def _small(sources: DataFrame) -> DataFrame:
    """The rows, one for each source, as a broadcast if there are few."""
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return F.broadcast(sources) if few else sources


def bucketed(rows: DataFrame) -> DataFrame:
    """Add `part` and `bucket`, which rise with the key within a source.

    Parts lie between approximate quantiles of the keys of the source, and are
    divided evenly into as many buckets as its documents need. Where exactly the
    bounds lie has no effect on what is taken.
    """
    shares = F.array(*[F.lit(i / QUANTILES) for i in range(1, QUANTILES)])
    cuts = rows.groupBy("source_key").agg(
        F.percentile_approx("key", shares, ACCURACY).alias("cuts"),
        F.ceil(F.count("*") / F.lit(BUCKET * QUANTILES)).alias("each"),
    )
    rows = rows.join(_small(materialise(cuts, "mix-cuts")), "source_key")
    rows = rows.withColumn("part", F.size(F.filter("cuts", lambda cut: cut <= F.col("key"))))
    # Counted from 1, bound 1 is zero and the last one.
    bounds = F.concat(F.array(F.lit(0.0)), "cuts", F.array(F.lit(1.0)))
    low, high = F.element_at(bounds, F.col("part") + 1), F.element_at(bounds, F.col("part") + 2)
    within = F.when(high > low, (F.col("key") - low) / (high - low)).otherwise(F.lit(0.0))
    bucket = F.least(F.floor(within * F.col("each")), F.col("each") - 1)
    return rows.withColumn("bucket", bucket).drop("cuts", "each")


def with_taken(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size, source_size, target and taken.

    Prefix sums are taken within buckets of keys, over the sums of the buckets of
    a part, and over the sums of parts; so no task sees more than a bucket of a
    source, however large that is.
    """
    rows = materialise(measured(docs), "mix-rows").withColumn("source_key", _key())
    rows = bucketed(rows)
    place = ["source_key", "part", "bucket"]
    sums = materialise(rows.groupBy(*place, "source").agg(F.sum("size").alias("sum")), "mix-sums")
    parts = sums.groupBy("source_key", "part", "source").agg(F.sum("sum").alias("part_sum"))
    sizes = parts.groupBy("source").agg(F.sum("part_sum").alias("source_size"))
    aims = materialise(targets(sizes), "mix-targets")
    aims = _small(aims.select(_key().alias("source_key"), "source_size", "target"))

    def before(value: str, group: list[str], order: str) -> Column:
        earlier = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    parts = parts.select("source_key", "part", before("part_sum", ["source_key"], "part").alias("part_start"))
    starts = sums.withColumn("within", before("sum", ["source_key", "part"], "bucket")).join(parts, ["source_key", "part"])
    starts = starts.select(*place, (F.col("part_start") + F.col("within")).alias("start"))
    own = Window.partitionBy(*place).orderBy("key", "doc_id", "text_hash")
    upto = F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).join(starts, place)
    rows = rows.join(aims, "source_key")
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))
    budget = F.col("target") - epochs * F.col("source_size")
    middle = F.col("start") + F.col("upto") - F.col("size") / 2
    times = F.least(epochs + (middle <= budget).cast("long"), F.lit(EPOCHS))
    return rows.select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        times.alias("times"), (times * F.col("size")).alias("taken"),
    )


def _orderable(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _orderable(kind.elementType)
    return isinstance(kind, (AtomicType, NullType))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix: each document as often as it is taken, unchanged.

    Texts move once, keyed by document. A document without words is not taken.
    """
    chosen = with_taken(docs).filter((F.col("size") > 0) & (F.col("times") > 0))
    key = lambda hash_: F.struct(F.col("doc_id"), F.col("source"), hash_.alias("text_hash"))
    # Repeated rows may be taken differently often; they share what they get.
    shares = chosen.groupBy(key(F.col("text_hash")).alias("_key")).agg(F.sum("times").alias("_times"))
    # By what tells repeats apart, so that a repeated task takes the same.
    apart = [f.name for f in docs.schema.fields if f.name != "text" and _orderable(f.dataType)]
    order = Window.partitionBy("_key").orderBy(*[F.col("_row")[name] for name in apart])
    shares = materialise(shares, "mix-shares")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), key(F.xxhash64(whole("text"))).alias("_key"))
    rows = rows.join(shares, "_key")
    repeats = F.count("*").over(Window.partitionBy("_key"))
    extra = (F.row_number().over(order) <= F.col("_times") % repeats).cast("long")
    rows = rows.withColumn("_each", F.floor(F.col("_times") / repeats) + extra)
    return rows.filter("_each > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_each")))).select("_row.*")
