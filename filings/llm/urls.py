"""URL filter: rules of hosts and paths, then a list of canonical URLs.

Verdict of a url: that of the longest rule that fits it; where none fits, block
if its canonical form is listed, else allow. The list is met in two steps: a
blocked Bloom filter passes possible hits, an exact hash join removes its false
positives. A null url, or one without "://", has an empty host and path, fits no
rule and is allowed. Repeated pages each have a row. An empty list, or an empty
table, gives the verdicts of the rules alone. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filings.llm.common import ascii_lower, whole


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

# The filter: blocks of 4 words of 64 bits, two bits set in each word.
WORDS = 4
BITS_PER_URL = 16
# A filter of up to this many blocks (of 40 bytes) is sent to every executor.
BROADCAST_BLOCKS = 200_000

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(whole(url), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), _PARTS, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host and path; no scheme, query, fragment or slash at the end."""
    return F.concat(host, F.rtrim(path, F.lit("/")))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as struct(rule, verdict), else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda rule: len(rule.text)):
        on_host = (host == rule.host) | host.endswith(f".{rule.host}")
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(on_host & path.startswith(rule.path), value).otherwise(found)
    return found


def _masks(url: Column) -> list[Column]:
    """The bits of a url in each word of its block."""
    bits = F.xxhash64(url, F.lit(1))
    one = F.lit(1).cast("long")
    # shiftleft takes the lowest six bits of the distance.
    place = lambda at: F.shiftrightunsigned(bits, at).bitwiseAND(F.lit(63)).cast("int")
    return [
        F.call_function("shiftleft", one, place(12 * word)).bitwiseOR(
            F.call_function("shiftleft", one, place(12 * word + 6))
        )
        for word in range(WORDS)
    ]


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def bloom_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """Blocks that hold a bit: `block`, `w0` to `w3`. `listed` has `canonical`."""
    masks = [mask.alias(f"m{i}") for i, mask in enumerate(_masks(F.col("canonical")))]
    return (
        listed.select(_block(F.col("canonical"), blocks).alias("block"), *masks)
        .groupBy("block")
        .agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])
    )


def possible_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Add `possible`: false only where `canonical` is certainly not listed."""
    n = listed.count()
    blocks = max(1, math.ceil(n * BITS_PER_URL / (64 * WORDS)))
    table = bloom_filter(listed, blocks)
    # There are at most as many rows as blocks.
    table = F.broadcast(table) if blocks <= BROADCAST_BLOCKS else table
    masks = [mask.alias(f"m{i}") for i, mask in enumerate(_masks(F.col("canonical")))]
    rows = urls.select("*", _block(F.col("canonical"), blocks).alias("block"), *masks)
    set_bits = [F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}") for i in range(WORDS)]
    possible = set_bits[0]
    for word in set_bits[1:]:
        possible = possible & word
    return rows.join(table, "block", "left").select(
        *urls.columns, F.coalesce(possible, F.lit(False)).alias("possible")
    )


def listed_urls(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """Add `listed`: whether `canonical` is in the list, exactly.

    Urls that the filter rules out have no key in the join and are spread by
    their hash.
    """
    listed = listed.select("canonical").distinct()
    marked = possible_hits(urls, listed)
    spread = F.when(F.col("possible"), F.lit(0).cast("long")).otherwise(F.xxhash64("page_id", "canonical"))
    key = F.struct(
        F.when(F.col("possible"), F.col("canonical")).alias("url"), spread.alias("spread")
    )
    exact = listed.select(
        F.struct(F.col("canonical").alias("url"), F.lit(0).cast("long").alias("spread")).alias("_key"),
        F.lit(True).alias("_hit"),
    )
    return (
        marked.withColumn("_key", key)
        .join(exact, "_key", "left")
        .select(*urls.columns, F.coalesce("_hit", F.lit(False)).alias("listed"))
    )


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path and canonical form of every url."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.withColumn("canonical", canonical(F.col("host"), F.col("path")))


def judge_urls(
    pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    `listed` has the blocked urls in the column `canonical`.
    """
    found = listed_urls(url_parts(pages), listed)
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return found.withColumn("_rule", rule).select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", own).alias("verdict"),
        "listed",
    )
