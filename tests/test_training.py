"""Models: a text search makes its features once, and importance scores all versions of the rows in one pass."""

import hashlib
import random

import pytest
from pyspark.ml.feature import IDF

from rostrum.operators import models

NAMES = {"bad": 0, "good": 1}


@pytest.fixture
def parts(spark):
    words = {0: "late wrong poor late bad day", 1: "early right fine day early good"}
    rows = []
    for k in range(60):
        own = words[k % 2].split()
        # Some texts have words of the other class.
        other = words[1 - k % 2].split()[: 5 * (k % 7 == 0)]
        rows.append((k, " ".join(own[k % 4 :] + other + [f"n{k}"]), "bad" if k % 2 == 0 else "good"))
    df = spark.createDataFrame(rows, "id long, text string, label string")
    return df.filter("id < 40"), df.filter("id >= 40")


def test_a_search_makes_features_once(parts, monkeypatch):
    fits = []

    class Spied(IDF):
        def fit(self, dataset, params=None):
            fits.append(1)
            return super().fit(dataset, params)

    monkeypatch.setattr(models, "IDF", Spied)
    models.search_text(*parts, NAMES, features=1 << 10)
    # Before, words were cut and counted again for each penalty.
    assert len(fits) == 1


def test_a_search_returns_the_pipeline_of_the_best_penalty(parts):
    train, validation = parts
    regs = (0.001, 0.1, 10.0)
    model, reg, auc = models.search_text(train, validation, NAMES, regs=regs, features=1 << 10)
    alone = models.train_text(train, NAMES, reg=reg, features=1 << 10)
    assert reg in regs and 0.5 < auc <= 1
    one, two = (
        {r.id: (r.predicted, round(r.score, 6)) for r in models.score_text(m, validation, NAMES).collect()}
        for m in (model, alone)
    )
    assert one == two and len(one) == 20
    assert model.stages[-1].getRegParam() == reg


def test_importance_pairs_rows_by_the_seeded_order(spark):
    """Rows in the order of their ids take the values in the order of the digests; all versions are scored in one pass."""
    rng = random.Random(5)
    rows = [(f"{rng.randrange(10**6)}-{k}", rng.random(), rng.random(), None if k % 41 == 0 else rng.random()) for k in range(300)]
    rows = [(i, None if k % 37 == 0 else int(x + 0.3 * y > 0.6), x, y, z) for k, (i, x, y, z) in enumerate(rows)]
    df = spark.createDataFrame(rows, "id string, y int, a double, b double, c double").repartition(5)
    cols = ["a", "b", "c"]
    model = models.l2_logit(df.dropna(), "y", cols)

    class Counted:
        calls = 0

        def transform(self, data):
            self.calls += 1
            return model.transform(data)

    counted = Counted()
    got = {r.feature: r.importance for r in models.permutation_importance(counted, df, "y", cols).collect()}
    assert counted.calls == 1

    def accuracy(table):
        right = []
        for _, y, *x in table:
            if None not in x and y is not None:
                margin = sum(w * v for w, v in zip(model.coefficients, x)) + model.intercept
                right.append((margin > 0) == (y == 1))
        return sum(right) / len(right)

    ordered = sorted(rows)
    for k, c in enumerate(cols):
        mixed = sorted(rows, key=lambda r: hashlib.md5(f"{42 + k}-{r[0]}".encode()).hexdigest())
        swapped = [(*r[: 2 + k], m[2 + k], *r[3 + k :]) for r, m in zip(ordered, mixed)]
        assert abs(got[c] - (accuracy(ordered) - accuracy(swapped))) < 1e-9
    assert got["a"] > 0.1 and got["a"] > got["b"]


def test_importance_of_no_rows_is_null(spark):
    df = spark.createDataFrame([(str(k), k % 2, float(k % 2)) for k in range(20)], "id string, y int, a double")
    model = models.l2_logit(df, "y", ["a"])
    got = models.permutation_importance(model, df.filter("id < ''"), "y", ["a"]).collect()
    assert [(r.feature, r.importance) for r in got] == [("a", None)]
