"""The cost search of the linear SVM reads its rows in partitions that follow their bytes."""

from pyspark.ml.classification import LinearSVC

from rostrum.operators import models


def test_partitions_follow_the_bytes():
    assert models.passes_partitions(0, 64) == 1
    assert models.passes_partitions(1, 64) == 1
    row = 64 * 8
    full = models.PASS_BYTES // row
    assert models.passes_partitions(full, 64) == 1
    assert models.passes_partitions(full + 1, 64) == 2
    # In proportion beyond that: a partition never grows.
    assert models.passes_partitions(1000 * full, 64) == 1000


def test_few_rows_are_few_tasks_a_pass(spark, monkeypatch):
    seen = []

    class Spied(LinearSVC):
        def fit(self, dataset, params=None):
            seen.append(dataset.rdd.getNumPartitions())
            return super().fit(dataset, params)

    monkeypatch.setattr(models, "LinearSVC", Spied)
    rows = [(k, k % 2, float(k % 2) + 0.01 * (k % 5), float(k % 3)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    model, best, scores = models.linear_svm(df, "y", ["a", "b"], folds=2, grid=(1, 10), max_iter=5)
    # Every trial and the last fit; before, each read a partition per range of the folds.
    assert seen == [1] * 5
    assert best in scores and all(0 <= s <= 1 for s in scores.values())
    assert model.coefficients[0] > 0
