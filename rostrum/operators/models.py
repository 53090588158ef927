"""Training, scoring and explaining through Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import HashingTF, IDF, PCA, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import fixed
from rostrum.operators import curate, ordered


@contextmanager
def kept(df: DataFrame):
    """Keep prepared rows for the passes of one training run, and release them after.

    Persisted blocks are a cache of the plan: a lost executor's blocks are computed again.
    """
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


def assemble(df: DataFrame, cols, out="features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


# --- logit with inference ----------------------------------------------------------


def logit_table(df: DataFrame, label, cols, weight=None) -> tuple[DataFrame, DataFrame]:
    """Unpenalised logit of a 0/1 label.

    Returns one row per term (coefficient, standard error, z, p, 95 % interval, odds
    ratio) and one row of fit statistics (log-likelihoods, pseudo-R²). The rows are as
    many as the model has terms; they are the only thing that reaches the driver.
    """
    spark = df.sparkSession
    glm = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol=label, featuresCol="features", maxIter=50, tol=1e-10
    )
    if weight:
        glm = glm.setWeightCol(weight)
    with kept(assemble(df.withColumn(label, F.col(label).cast("double")), cols)) as data:
        model = glm.fit(data)
        return _logit_rows(spark, model, cols)


def _logit_rows(spark, model, cols) -> tuple[DataFrame, DataFrame]:
    s = model.summary
    names = list(cols) + ["const"]
    coefs = list(model.coefficients) + [model.intercept]
    rows = [
        (n, float(c), float(se), float(t), float(p))
        for n, c, se, t, p in zip(
            names, coefs, s.coefficientStandardErrors, s.tValues, s.pValues
        )
    ]
    table = spark.createDataFrame(rows, "term string, coef double, se double, z double, p double")
    table = table.withColumns(
        {
            "ci_low": F.col("coef") - 1.96 * F.col("se"),
            "ci_high": F.col("coef") + 1.96 * F.col("se"),
            "odds_ratio": F.exp("coef"),
        }
    )
    fit = spark.createDataFrame(
        [(-s.deviance / 2, -s.nullDeviance / 2, 1 - s.deviance / s.nullDeviance, int(s.numInstances))],
        "log_likelihood double, null_log_likelihood double, pseudo_r2 double, n long",
    )
    return table, fit


def l2_logit(df: DataFrame, label, cols, weight=None, reg: float | None = None):
    """L2 logistic classifier; ``reg`` defaults to one over the number of rows."""
    data = assemble(df.withColumn(label, F.col(label).cast("double")), cols)
    with kept(data.select(label, "features", *([weight] if weight else []))) as data:
        reg = 1.0 / max(1, data.count()) if reg is None else reg
        lr = LogisticRegression(
            labelCol=label, regParam=reg, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-8
        )
        return (lr.setWeightCol(weight) if weight else lr).fit(data)


def sorted_coefficients(model, spark, cols) -> DataFrame:
    rows = [(c, float(w)) for c, w in zip(cols, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, coef double").orderBy(F.desc("coef"))


def with_folds(df: DataFrame, label, id="id", folds: int = 5, seed: int = 42) -> DataFrame:
    """A fold number that is balanced within each class, from the seeded order."""
    rows = ordered.numbered(df, curate.seeded_key(id, seed), label, "_n")
    return rows.withColumn("fold", F.pmod(F.col("_n"), F.lit(folds)).cast("int")).drop("_n")


PASS_BYTES = 16 << 20


def passes_partitions(rows: int, width: int) -> int:
    """Partitions of about ``PASS_BYTES`` for ``rows`` vectors of ``width`` doubles that many passes read.

    The number grows with the rows, so a partition never does.
    """
    return max(1, -(-rows * width * 8 // PASS_BYTES))


def linear_svm(
    df: DataFrame, label, cols, id="id", folds=5, seed=42, grid=(0.1, 1, 10, 100, 1000), max_iter=50, tol=1e-4,
    parallelism=4,
):
    """Linear SVM with balanced weights; the cost is searched by stratified folds.

    ``grid`` has costs: the penalty of a fit is one over the cost and its number of rows.
    Returns the model fitted on all rows, its cost and the mean accuracy of each cost.
    """
    data = with_folds(curate.class_weights(df, label), label, id, folds, seed)
    data = assemble(data.withColumn(label, F.col(label).cast("double")), cols)
    data = data.select(label, "features", "weight", "fold")
    # A fit reads the rows up to a hundred times: partitions follow the bytes, not the shuffles before.
    data = data.coalesce(passes_partitions(df.count(), len(cols)))
    evaluator = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")

    def fit(rows, cost, n):
        reg = 1.0 / (cost * max(1, n))
        svm = LinearSVC(
            labelCol=label, weightCol="weight", regParam=reg, maxIter=max_iter, tol=tol, standardization=False
        )
        return svm.fit(rows)

    def trial(held, cost, k):
        model = fit(held.filter(F.col("fold") != k), cost, sum(n for f, n in sizes.items() if f != k))
        return cost, evaluator.evaluate(model.transform(held.filter(F.col("fold") == k)))

    with kept(data) as held, ThreadPool(parallelism) as pool:
        sizes = {r.fold: r["count"] for r in held.groupBy("fold").count().collect()}
        jobs = [inheritable_thread_target(partial(trial, held, cost, k)) for cost in grid for k in range(folds)]
        scores = dict.fromkeys(grid, 0.0)
        for cost, accuracy in pool.map(lambda job: job(), jobs):
            scores[cost] += accuracy / folds
        best = max(scores, key=scores.get)
        return fit(held, best, sum(sizes.values())), best, scores


def permutation_importance(model, df: DataFrame, label, cols, id="id", seed: int = 42) -> DataFrame:
    """Loss of accuracy when one column is shuffled.

    The shuffled columns are joined on the row number of their seeded orders, so rows change
    values across the whole table and not within a partition. Rows are numbered once, meet all
    shuffled columns in one join, and are scored once as they are and once for each column.
    """
    cols = list(cols)
    data = df.withColumn(label, F.col(label).cast("double"))
    rows = ordered.numbered(data.select(F.col(id).alias("_id"), label, *cols), "_id", (), "_row").drop("_id")
    for k, c in enumerate(cols):
        digest, tie = curate.seeded_key(id, seed + k)
        mixed = data.select(digest.alias("_digest"), tie.alias("_id"), F.col(c).alias(f"_mixed{k}"))
        ranged = ordered.digest_range(mixed, "_digest")
        mixed = ordered.numbered(mixed, ["_digest", "_id"], (), "_row", ranged=ranged)
        rows = rows.join(mixed.drop("_digest", "_id"), "_row")

    def version(n):
        values = [F.col(f"_mixed{k}" if k == n else c).alias(c) for k, c in enumerate(cols)]
        return F.struct(F.lit(n).alias("_version"), F.col(label).alias(label), *values)

    # Version -1 is the row as it is.
    versions = rows.select(F.explode(F.array(*[version(n) for n in range(-1, len(cols))])).alias("_v")).select("_v.*")
    scored = model.transform(assemble(versions, cols)).groupBy("_version")
    scored = scored.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("a"))
    names = df.sparkSession.createDataFrame([(n, c) for n, c in enumerate(["", *cols], -1)], "_version int, feature string")
    base = names.join(scored, "_version", "left")
    whole = F.max(F.when(F.col("_version") == -1, F.col("a"))).over(_everything())
    out = base.withColumn("importance", whole - F.col("a"))
    return out.filter(F.col("_version") >= 0).select("feature", "importance").orderBy(F.desc("importance"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


# --- text classification -------------------------------------------------------------


def text_pipeline(text="text", label="target", features: int = 1 << 16, reg: float = 0.01) -> Pipeline:
    """Tokens, hashed counts, inverse document frequency, weighted logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
            IDF(inputCol="_tf", outputCol="features"),
            LogisticRegression(labelCol=label, weightCol="weight", regParam=reg, maxIter=50),
        ]
    )


def with_target(df: DataFrame, names: dict, label="label") -> DataFrame:
    """Numeric ``target`` from class names, and balanced class weights."""
    from rostrum.functions.text import label_of

    rows = df.withColumn("target", label_of(label, names).cast("double"))
    return curate.class_weights(rows.filter(F.col("target").isNotNull()), label)


def train_text(df: DataFrame, names: dict, text="text", label="label", **options) -> PipelineModel:
    with kept(with_target(df, names, label).select(text, "target", "weight")) as data:
        return text_pipeline(text, **options).fit(data)


def search_text(
    train: DataFrame, validation: DataFrame, names: dict, regs=(0.001, 0.01, 0.1), parallelism=3, **options
):
    """Choose the penalty on the validation part with a fresh model for each value.

    Returns the best fitted pipeline, its penalty and its AUC. The test part takes no part.
    """
    columns = [options.get("text", "text"), "target", "weight"]
    evaluator = BinaryClassificationEvaluator(labelCol="target")
    *front, idf, logit = text_pipeline(**options).getStages()

    # Words, counts and document frequencies are the same for all penalties, so they are made once.
    def counted(df):
        return PipelineModel(front).transform(with_target(df, names).select(*columns)).select("_tf", "target", "weight")

    def trial(reg):
        fitted = logit.copy({logit.regParam: reg}).fit(known.transform(data))
        return evaluator.evaluate(fitted.transform(known.transform(held))), reg, fitted

    with kept(counted(train)) as data, kept(counted(validation)) as held, ThreadPool(parallelism) as pool:
        known = idf.fit(data)
        jobs = [inheritable_thread_target(partial(trial, reg)) for reg in regs]
        auc, reg, fitted = max(pool.map(lambda job: job(), jobs), key=lambda t: t[0])
    return PipelineModel([*front, known, fitted]), reg, auc


def search_split(df: DataFrame, names: dict, regs=(0.001, 0.01, 0.1), seed: int = 42, **options):
    """The same through ``TrainValidationSplit``, which fits the trials in parallel."""
    pipe = text_pipeline(**options)
    grid = ParamGridBuilder().addGrid(pipe.getStages()[-1].regParam, list(regs)).build()
    tvs = TrainValidationSplit(
        estimator=pipe, estimatorParamMaps=grid, parallelism=4, seed=seed,
        evaluator=BinaryClassificationEvaluator(labelCol="target"),
    )
    with kept(with_target(df, names)) as data:
        return tvs.fit(data)


def score_text(model: PipelineModel, df: DataFrame, names: dict, keep=("id",)) -> DataFrame:
    """Class and probability per row, from a fitted pipeline."""
    p = vector_to_array("probability")
    codes = {float(code): name for name, code in names.items()}
    best = F.array_max(p)
    label = F.element_at(
        F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), F.col("prediction")
    )
    return model.transform(df).select(*keep, label.alias("predicted"), best.alias("score"))


def split_pair(df: DataFrame, text="text") -> DataFrame:
    """The two members of a pair text as ``s1`` and ``s2``."""
    parts = F.split(F.col(text), r" \[SEP\] ", 2)
    return df.withColumns({"s1": F.get(parts, F.lit(0)), "s2": F.get(parts, F.lit(1))})


def score(
    df: DataFrame, model_fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Hook for a user's own model: ``model_fn`` maps a batch to a batch of ``schema``.

    Batches arrive through Arrow; put it after all filters. ``model_fn`` should load its
    model once per process.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model_fn(batch)

    return df.mapInPandas(run, schema)


def save(model, path: str) -> None:
    model.write().overwrite().save(path)


def plane(df: DataFrame, embedding="embedding", keep=("id",)) -> DataFrame:
    """Two-dimensional view of an embedding column by principal components."""
    data = df.select(*keep, array_to_vector(F.col(embedding).cast("array<double>")).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(data)
    xy = vector_to_array("_p")
    return model.transform(data).select(*keep, xy[0].alias("x"), xy[1].alias("y"))
