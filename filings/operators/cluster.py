"""Documents grouped by their weighted terms, and the terms behind each group."""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from filings.functions.text import term_counts
from filings.operators.computed import computed
from filings.operators.storage import materialise

# Centres with more values than this are joined instead of broadcast.
BROADCAST_CENTRE_VALUES = 2_000_000

# Documents, and values of their vectors, in a partition while centres are fitted,
# and most partitions. Every step of a fit is a job over all partitions, so short
# documents fill them up to the first bound. In every step each partition sends its
# sums for k centres, so beyond a few, partitions grow with the square root of these
# sizes: what is sent grows no faster, and a partition holds more.
FIT_ROWS = 50_000
FIT_VALUES = 250_000
FIT_FEW = 8
FIT_PARTITIONS = 10_000


def hashed_tf(documents: DataFrame, n_features: int, terms: str = "terms") -> DataFrame:
    """Adds `tf`: term counts in a hashed space of `n_features`."""
    return HashingTF(numFeatures=n_features, inputCol=terms, outputCol="tf").transform(
        documents
    )


def idf_weight(hashed: DataFrame, min_doc_freq: int = 5) -> DataFrame:
    """Adds `tfidf`; terms in fewer than `min_doc_freq` documents weigh 0."""
    model = IDF(minDocFreq=min_doc_freq, inputCol="tf", outputCol="tfidf").fit(hashed)
    return model.transform(hashed)


def fit_clusters(
    weighted: DataFrame, k: int, max_iter: int, runs: int = 1, seed: int = 1
) -> KMeansModel:
    """K-means from `runs` seeds; the model of the lowest cost is kept.

    Term vectors are sparse, and documents may have fewer distinct vectors than
    `k`: the row solver suits the first and copes with the second.

    Vectors are kept on the executors' disks alone, and read batch by batch in each
    step. In memory they would fill what Spark has for storage, as there are as many as
    documents; stored blocks there are of chunks that take up to twice their size of
    the heap, which then has no room for the tasks.
    """
    best = None
    weighted = weighted.persist(StorageLevel.DISK_ONLY)
    try:
        for run in range(runs):
            kmeans = KMeans(
                k=k,
                maxIter=max_iter,
                seed=seed + run,
                solver="row",
                featuresCol="tfidf",
                predictionCol="cluster",
            )
            model = kmeans.fit(weighted)
            if best is None or model.summary.trainingCost < best.summary.trainingCost:
                best = model
    finally:
        weighted.unpersist()
    return best


def fit_partitions(rows: int, values: int) -> int:
    """Partitions for so many documents with so many values."""
    full = 1 + max(rows // FIT_ROWS, values // FIT_VALUES)
    return min(FIT_PARTITIONS, full if full <= FIT_FEW else isqrt(FIT_FEW * full))


def in_fixed_layout(documents: DataFrame, key: Sequence[str], vector: str = "tfidf") -> DataFrame:
    """Documents in partitions that depend on their number, vectors and keys alone.

    Seeds draw from partitions, so a seed would else give other clusters on a
    cluster of another size or from files cut elsewhere.
    """
    values = F.sum(F.size(F.unwrap_udt(vector)["values"]))
    rows, values = documents.agg(F.count("*"), F.coalesce(values, F.lit(0))).head()
    partitions = fit_partitions(rows, values)
    return documents.repartition(partitions, *key).sortWithinPartitions(*key)


def cluster_documents(weighted: DataFrame, model: KMeansModel) -> DataFrame:
    """Adds `cluster`, the nearest centre of each document."""
    return model.transform(weighted)


def hash_vocabulary(
    documents: DataFrame, n_features: int, terms: str = "terms"
) -> DataFrame:
    """One row (index, term) per distinct term; terms may share an index."""
    listed = documents.select(F.explode(F.array_distinct(terms)).alias("term"))
    distinct = listed.distinct()
    alone = hashed_tf(distinct.withColumn("one", F.array("term")), n_features, "one")
    # The one index of its vector. A later join on the index must not hash terms
    # before they are distinct.
    index = F.get(F.unwrap_udt("tf")["indices"], F.lit(0))
    return computed(alone, index=index).select("index", "term")


def _entries(documents: DataFrame, key: Sequence[str], vector: str, expand) -> DataFrame:
    raw = computed(documents.select(*key, F.unwrap_udt(vector).alias("raw")), values=F.col("raw.values"))
    # A dense vector lists no indices.
    places = F.transform("values", lambda value, at: at)
    pairs = F.arrays_zip(F.coalesce("raw.indices", places).alias("index"), F.col("values").alias("value"))
    return raw.select(*key, expand(pairs).alias("index", "value"))


def vector_entries(documents: DataFrame, key: Sequence[str], vector: str) -> DataFrame:
    """Rows (key, index, value) of the values of a vector that are not zero."""
    return _entries(documents, key, vector, F.inline).filter("value <> 0")


def term_weights(
    documents: DataFrame, vocabulary: DataFrame, key: Sequence[str], min_doc_freq: int = 5
) -> DataFrame:
    """As `vector_entries` of `tfidf`, from the terms themselves.

    `documents` has `terms`. It is what vectors, weights and centres can be
    checked by, as no vector is read. Terms are counted in the document's own row.
    """
    rows = documents.select(*key, F.inline(term_counts(F.col("terms"))).alias("term", "tf"))
    rows = rows.join(vocabulary, "term").groupBy(*key, "index").agg(F.sum("tf").alias("tf"))
    total = documents.count()
    # Counted by `tf`, which the rows have anyway: so both sides share one shuffle of them.
    df = rows.groupBy("index").agg(F.count("tf").alias("df")).filter(F.col("df") >= min_doc_freq)
    value = F.col("tf") * F.log((F.lit(total) + 1) / (F.col("df") + 1))
    # One row for each index of the hashed space.
    return rows.join(F.broadcast(df), "index").select(*key, "index", value.alias("value")).filter("value <> 0")


def nearest_centres(
    documents: DataFrame, key: Sequence[str], centres: DataFrame, k: int
) -> DataFrame:
    """key, cluster, distance, and whether no other of the k centres is nearer.

    `centres` has rows (cluster, index, weight); what it lacks is zero. Distances
    are squared, from the products of entries that both sides have. Each entry meets
    the weights of its index in all centres at once, so one row for each document
    moves, and documents are read once.
    """
    centres = materialise(centres, "centres")
    own_centre = lambda c: F.when(F.col("cluster") == c, F.col("weight"))
    zero = lambda value: F.coalesce(value, F.lit(0.0))
    weights = centres.groupBy("index").agg(F.array(*[zero(F.sum(own_centre(c))) for c in range(k)]).alias("weights"))
    if k * weights.count() <= BROADCAST_CENTRE_VALUES:
        weights = F.broadcast(weights)
    # One row.
    norms = centres.agg(F.array(*[zero(F.sum(own_centre(c) * own_centre(c))) for c in range(k)]).alias("norms"))
    # A document without entries has one row, without an index.
    entries = _entries(documents, [*key, "cluster"], "tfidf", F.inline_outer)
    products = [zero(F.sum(F.col("value") * F.get("weights", F.lit(c)))) for c in range(k)]
    found = entries.join(weights, "index", "left").groupBy(*key, "cluster").agg(
        zero(F.sum(F.col("value") * F.col("value"))).alias("own_norm"), F.array(*products).alias("products")
    )
    to_each = F.zip_with("norms", "products", lambda norm, product: F.col("own_norm") + norm - 2 * product)
    found = found.crossJoin(F.broadcast(norms)).withColumn("to_each", to_each)
    found = found.withColumn("distance", F.get("to_each", F.col("cluster")))
    # Sums of many products agree to their rounding.
    size = F.col("own_norm") + F.array_max("norms")
    nearest = F.col("distance") <= F.array_min("to_each") + 1e-9 * (1 + size)
    return found.select(*key, "cluster", "distance", nearest.alias("nearest"))


def cluster_means(documents: DataFrame, entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows (cluster, index, mean): the mean of the entries of each cluster's documents.

    Entries that have a `cluster` are not joined with their documents.
    """
    # One row for each cluster.
    sizes = F.broadcast(documents.groupBy("cluster").agg(F.count("*").alias("n")))
    rows = entries if "cluster" in entries.columns else entries.join(documents.select(*key, "cluster"), [*key])
    sums = rows.groupBy("cluster", "index").agg(F.sum("value").alias("sum"))
    return sums.join(sizes, "cluster").select("cluster", "index", (F.col("sum") / F.col("n")).alias("mean"))


def centre_weights(
    weighted: DataFrame, centres: Sequence[np.ndarray]
) -> DataFrame:
    """Non-zero values of the k centres as rows (cluster, index, weight)."""
    parts = [
        pd.DataFrame(
            {"cluster": cluster, "index": at, "weight": centre[at]}
        )
        for cluster, centre in enumerate(centres)
        for at in [np.flatnonzero(centre)]
    ]
    return weighted.sparkSession.createDataFrame(
        pd.concat(parts), "cluster int, index int, weight double"
    )


def explain_clusters(
    vocabulary: DataFrame,
    weighted: DataFrame,
    model: KMeansModel,
    top: int | None = None,
) -> DataFrame:
    """Terms of each centre with their weight; with `top`, the heaviest only.

    Terms that share an index share its weight.
    """
    centres = model.clusterCenters()
    weights = centre_weights(weighted, centres)
    if sum(len(centre) for centre in centres) <= BROADCAST_CENTRE_VALUES:
        weights = F.broadcast(weights)
    named = vocabulary.join(weights, "index").select(
        "cluster", "index", "term", "weight"
    )
    if top is None:
        return named
    ranked = W.partitionBy("cluster").orderBy(F.desc("weight"), "term")
    return named.withColumn("rank", F.row_number().over(ranked)).filter(
        F.col("rank") <= top
    )


def cluster_report(clustered: DataFrame, doc_id: str) -> DataFrame:
    """Document, weighted vector, cluster and terms."""
    return clustered.select(
        doc_id, "tfidf", "cluster", F.array_distinct("terms").alias("terms")
    )
