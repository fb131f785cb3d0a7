"""Vectors, centres and dictionaries against brute force; checks that can fail."""

import math
import random
from collections import Counter

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F

from filings.operators.cluster import (
    cluster_means,
    fit_partitions,
    hash_vocabulary,
    hashed_tf,
    in_fixed_layout,
    nearest_centres,
    term_weights,
    vector_entries,
)
from filings.operators.vocabulary import id_vectors, numbered, term_ids, term_rows
from filings.plans.jobs import VARIANTS, cluster_texts

STOPWORDS = ("the", "a")


def prose(spark, n=120):
    rng = random.Random(3)
    topics = [[f"{t}{i}" for i in range(12)] for t in ("red", "green", "blue")]
    rows = [(i, [" ".join(rng.choice(topics[i % 3]) for _ in range(20)) + " the common"]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, fragments array<string>")


def test_a_wrong_centre_or_document_is_found(spark):
    clusters = cluster_texts(prose(spark), VARIANTS["stopworded"], STOPWORDS)
    centres = clusters.explain().select("cluster", "index", "weight").distinct()
    k = len(clusters.model.clusterCenters())
    found = nearest_centres(clusters.documents, ["doc_id"], centres, k)
    assert found.count() == 120 and found.filter("nearest").count() == 120
    by_model = {r.doc_id: r for r in clusters.documents.select("doc_id", "cluster", "tfidf").collect()}
    for r in found.collect():
        own = by_model[r.doc_id]
        exact = sum((x - y) ** 2 for x, y in zip(own.tfidf.toArray(), clusters.model.clusterCenters()[own.cluster]))
        assert math.isclose(r.distance, exact, rel_tol=1e-9, abs_tol=1e-9)
    moved = clusters.documents.withColumn("cluster", (F.col("cluster") + 1) % k)
    assert nearest_centres(moved, ["doc_id"], centres, k).filter("nearest").count() < 120
    shifted = centres.withColumn("weight", F.when(F.col("cluster") == 0, 100.0).otherwise(F.col("weight")))
    assert nearest_centres(clusters.documents, ["doc_id"], shifted, k).filter("nearest").count() < 120


def test_weights_and_means_from_terms(spark):
    clusters = cluster_texts(prose(spark), VARIANTS["stopworded"], STOPWORDS)
    entries = {(r.doc_id, r["index"]): r.value for r in vector_entries(clusters.documents, ["doc_id"], "tfidf").collect()}
    weights = term_weights(clusters.documents, clusters.vocabulary, ["doc_id"])
    again = {(r.doc_id, r["index"]): r.value for r in weights.collect()}
    assert entries.keys() == again.keys() and all(math.isclose(entries[k], again[k]) for k in entries)
    means = cluster_means(clusters.documents, weights, ["doc_id"]).collect()
    centres = clusters.model.clusterCenters()
    assert means and all(math.isclose(centres[r.cluster][r["index"]], r["mean"], rel_tol=1e-9) for r in means)


def test_terms_of_one_index_stay_apart_in_the_dictionary(spark):
    rows = [(i, [f"t{j}" for j in range(i % 7, 40)]) for i in range(30)]
    documents = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    hashed = hash_vocabulary(documents, 16)
    assert hashed.count() == 40 and hashed.select("index").distinct().count() <= 16
    ids = term_ids(term_rows(documents, "doc_id", F.col("terms")))
    df = Counter(t for _, terms in rows for t in set(terms))
    order = sorted(df, key=lambda t: (-df[t], t))
    assert {(r.term, r.df, r.term_id) for r in ids.collect()} == {(t, df[t], i) for i, t in enumerate(order)}


def test_vectors_by_id_with_a_hot_term(spark):
    rng = random.Random(9)
    rows = [(i, ["hot", "hot"] + [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 5))]) for i in range(400)]
    rows += [(900, []), (901, ["lone"])]
    documents = spark.createDataFrame(rows, "doc_id long, terms array<string>")
    made = term_rows(documents, "doc_id", F.col("terms"))
    ids = term_ids(made, 2)
    number = {r.term: r.term_id for r in ids.collect()}
    expected = {}
    for i, terms in rows:
        counts = sorted((number[t], n) for t, n in Counter(terms).items() if t in number)
        if counts:
            expected[i] = (tuple(k for k, _ in counts), tuple(n for _, n in counts))
    found = {r.doc_id: (tuple(r.ids), tuple(r["counts"])) for r in id_vectors(made, ids, "doc_id").collect()}
    assert found == expected and 901 not in found and number["hot"] == 0


def test_numbers_have_no_gap_and_ties_keep_their_order(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("a"), "id")
    found = numbered(rows, F.desc("a"), F.col("id")).collect()
    expected = sorted(((i % 7, i) for i in range(500)), key=lambda r: (-r[0], r[1]))
    assert {(r.a, r.id): r.position for r in found} == {row: at for at, row in enumerate(expected)}
    assert numbered(rows.limit(0), F.col("id")).count() == 0


def test_short_documents_are_fitted_in_few_partitions(spark):
    short = spark.range(60_000).select("id", F.array(F.lit("w")).alias("terms"))
    long = spark.range(3_000).select("id", F.transform(F.sequence(F.lit(1), F.lit(250)), lambda i: i.cast("string")).alias("terms"))
    parts = lambda rows: in_fixed_layout(hashed_tf(rows, 1 << 20), ["id"], "tf").rdd.getNumPartitions()
    assert parts(short) == 2 and parts(long) in (3, 4)


def test_sums_of_a_fit_grow_no_faster_than_documents():
    sizes = [fit_partitions(0, n) for n in (1_000_000, 2_000_000, 100_000_000, 400_000_000, 800_000_000)]
    assert sizes[0] == 5 and sizes[1] <= 9 and sizes[2] >= 50
    # Four times the values, twice the partitions that send their sums.
    assert sizes[3] <= 2 * sizes[2] + 1 and sizes[4] <= 200


def test_documents_without_entries_and_products_in_one_pass(spark):
    clusters = cluster_texts(prose(spark), VARIANTS["stopworded"], STOPWORDS)
    k = len(clusters.model.clusterCenters())
    centres = clusters.explain().select("cluster", "index", "weight").distinct()
    none = F.udf(lambda v: Vectors.sparse(v.size, []), VectorUDT())
    bare = clusters.documents.withColumn("tfidf", F.when(F.col("doc_id") == 7, none("tfidf")).otherwise(F.col("tfidf")))
    found = nearest_centres(bare, ["doc_id"], centres, k)
    own = clusters.model.clusterCenters()
    row = found.filter("doc_id = 7").head()
    assert found.count() == 120 and math.isclose(row.distance, sum(x * x for x in own[row.cluster]))
    # Documents are read once; the others are weights and norms of the centres.
    assert str(found._jdf.queryExecution().optimizedPlan().toString()).count("Relation [") == 3
    weights = term_weights(clusters.documents, clusters.vocabulary, ["doc_id", "cluster"])
    made = weights.groupBy("cluster").count()
    made.collect()
    # Terms move once for the frequencies and the weights.
    assert "ReusedExchange" in made._jdf.queryExecution().executedPlan().toString()
    plain = cluster_means(clusters.documents, weights.drop("cluster"), ["doc_id"])
    means = {(r.cluster, r["index"]): r["mean"] for r in cluster_means(clusters.documents, weights, ["doc_id"]).collect()}
    assert means and all(math.isclose(means[r.cluster, r["index"]], r["mean"]) for r in plain.collect())
