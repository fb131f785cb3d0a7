"""Registered queries of the operators in this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filings.llm.leaks import find_secrets
from filings.llm.middle import filled_in, restored
from filings.llm.mixing import with_taken
from filings.llm.negatives import hard_negatives, usable_rows
from filings.llm.pieces import encoded
from filings.llm.pii import find_pii
from filings.llm.quality import scores
from filings.llm.shards import with_shards
from filings.llm.simhash import with_components
from filings.llm.topk import K, SCALE, top_k, usable_vectors
from filings.llm.urls import RULES, judge_urls, url_parts
from filings.llm.warc import MIN_SHARED, archived_pages
from filings.llm.winnow import compared, printed

# Searches take as queries the rows whose id this divides.
EVERY = 50
# The list of op9: canonical urls of pages whose html has a digest that begins
# with one of the first digits, and for the last digit urls that no page has.
LISTED_DIGITS, ABSENT_DIGIT = "01", "2"
ABSENT = "/no-such-page"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usable_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = top_k(rows.filter(F.col("id") % EVERY == 0), rows)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_taken(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_shards(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_components(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return judge_urls(pages, listed_of(pages)).drop("listed")


def listed_of(pages: DataFrame) -> DataFrame:
    """The list of op9, from what pages hold: their urls alone do not tell it."""
    digit = F.substring(F.sha2(F.coalesce("html", F.lit("")), 256), 1, 1)
    rows = url_parts(pages.withColumn("page_id", digit)).filter("canonical <> ''")
    listed = rows.filter(F.col("page_id").isin(*LISTED_DIGITS)).select("canonical")
    absent = rows.filter(F.col("page_id") == ABSENT_DIGIT).select(F.concat("canonical", F.lit(ABSENT)).alias("canonical"))
    return listed.union(absent).distinct()


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(_table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("chosen")).alias("fingerprint"),
        printed(F.col("edited_chosen")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable_rows(_table(spark, sf_dir, "embeddings"), "vec_id", label, "embedding")
    return hard_negatives(rows.filter(F.col("id") % EVERY == 0), rows)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filled_in(_table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


_OP1_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % {EVERY} = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n
  FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= {K}
"""

_OP6_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
         sha256(payload) AS payload_digest FROM p),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_SHARED} AND page_id <> first_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_SHARED} AND page_id <> first_id
            THEN first_id END AS refers_to
FROM f
"""


def _op9_sql() -> str:
    fits = " ".join(
        f"WHEN (host = '{rule.host}' OR ends_with(host, '.{rule.host}')) "
        f"AND starts_with(path, '{rule.path}') THEN '{rule.text}'"
        for rule in sorted(RULES, key=lambda rule: -len(rule.text))
    )
    verdicts = " ".join(f"WHEN '{rule.text}' THEN '{rule.verdict}'" for rule in RULES)
    digits = ", ".join(f"'{digit}'" for digit in LISTED_DIGITS)
    parts = "'(?s)^.*?://([^/?#]*)([^?#]*)'"
    return f"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), {parts}, 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), {parts}, 2) AS path,
         sha256(coalesce(html, ''))[1] AS digit
  FROM pages),
c AS (SELECT *, host || rtrim(path, '/') AS canonical FROM p),
listed AS (
  SELECT canonical FROM c WHERE canonical <> '' AND digit IN ({digits})
  UNION SELECT canonical || '{ABSENT}' FROM c WHERE canonical <> '' AND digit = '{ABSENT_DIGIT}'),
r AS (SELECT *, CASE {fits} END AS rule FROM c)
SELECT page_id, host, path, rule,
       coalesce(CASE rule {verdicts} END,
                CASE WHEN canonical IN (SELECT canonical FROM listed)
                     THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""


_OP12_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM v a, v c WHERE a.vec_id % {EVERY} = 0 AND c.vec_id <> a.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE alike),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (
           PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS n
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
  WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id,
       positive_score, negative_score
FROM n WHERE n <= 3
"""

_OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM d),
c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u),
k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM c),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix,
         array_to_string(units[a + 1:b], '') AS middle,
         array_to_string(units[b + 1:n], '') AS suffix
  FROM k)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


QUERIES = {
    query.__name__: query
    for query in (
        op1_topk,
        op2_mixing,
        op3_sharding,
        op4_simhash,
        op5_pii,
        op6_warc,
        op7_quality,
        op8_sentencepiece,
        op9_url_filters,
        op10_fingerprints,
        op11_secrets,
        op12_negatives,
        op13_middle,
    )
}

ORACLE_SQL = {
    "op1_topk": _OP1_SQL,
    "op6_warc": _OP6_SQL,
    "op9_url_filters": _op9_sql(),
    "op12_negatives": _OP12_SQL,
    "op13_middle": _OP13_SQL,
}
