"""What a fit keeps while it runs."""

from pyspark.ml.linalg import Vectors

from filings.operators import cluster


def test_vectors_of_a_fit_stay_out_of_memory(spark, monkeypatch):
    rows = spark.createDataFrame([(i, Vectors.sparse(8, {i % 4: 1.0, 7: 0.5})) for i in range(200)], ["id", "tfidf"])
    seen = []

    class Watched(cluster.KMeans):
        def fit(self, dataset, params=None):
            model = super().fit(dataset, params)
            seen.append(dataset.storageLevel)
            return model

    monkeypatch.setattr(cluster, "KMeans", Watched)
    model = cluster.fit_clusters(rows, 4, 10, 2)
    assert len(seen) == 2 and all(level.useDisk and not level.useMemory for level in seen)
    assert not rows.storageLevel.useDisk
    assert len({tuple(c) for c in model.clusterCenters()}) == 4 and model.summary.trainingCost < 1e-9
