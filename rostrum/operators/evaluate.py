"""Evaluation of predictions.

Predictions are rows with a true label, a predicted label and, for rankings, a score.
Labels are named by their own column; no class order is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.operators import ordered


def confusion(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    """Counts in long form: ``label, predicted, n``."""
    return df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes, label="label", predicted="predicted") -> DataFrame:
    """Counts as a matrix: one row per label, one column per predicted class."""
    return df.groupBy(label).agg(
        *[F.count_if(F.col(predicted) == F.lit(c)).alias(f"predicted_{c}") for c in classes]
    )


def _ratio(a, b):
    """0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_metrics(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    """Precision, recall and F1 of each class; 0 on an empty denominator."""
    cells = confusion(df, label, predicted)
    sides = F.array(
        F.struct(F.col(label).alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")),
    )
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    rows = cells.select(hit.alias("hit"), F.posexplode(sides).alias("at", "_s")).select("hit", "at", "_s.*")
    g = rows.groupBy("class").agg(
        F.sum(F.when(F.col("at") == 0, F.col("hit")).otherwise(0)).alias("tp"),
        F.sum("support").alias("support"),
        F.sum("claimed").alias("claimed"),
    )
    p, r = _ratio(F.col("tp"), F.col("claimed")), _ratio(F.col("tp"), F.col("support"))
    return g.select(
        "class", "support", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1")
    )


def summary_metrics(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    """Accuracy and macro precision, recall and F1 in one row."""
    per_class = class_metrics(df, label, predicted)
    macro = per_class.agg(
        F.avg("precision").alias("macro_precision"),
        F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )
    hits = df.agg((F.count_if(F.col(label) == F.col(predicted)) / F.count(F.lit(1))).alias("a")).scalar()
    return macro.withColumn("accuracy", hits)


def score_counts(df: DataFrame, positive, label="label", score="score") -> DataFrame:
    """Positives and negatives per distinct score. Everything about a ranking follows from
    this table, and it is built with map-side counts."""
    is_pos = F.col(label) == F.lit(positive)
    return df.filter(F.col(score).isNotNull()).groupBy(score).agg(
        F.count_if(is_pos).alias("pos"), F.count_if(~is_pos).alias("neg")
    )


def roc_auc(df: DataFrame, positive, label="label", score="score") -> DataFrame:
    """Area under the ROC curve; a tie counts one half. NULL when a class is missing."""
    run = ordered.running_totals(
        score_counts(df, positive, label, score), {"upto": F.col("neg")}, score
    )
    won = F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / F.lit(2.0)))
    return run.agg(F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, positive, label="label", score="score") -> DataFrame:
    """One point per distinct score, from the highest down: ``threshold, fpr, tpr``."""
    counts = score_counts(df, positive, label, score).withColumn("_down", -F.col(score))
    run = ordered.running_totals(counts, {"tp": F.col("pos"), "fp": F.col("neg")}, "_down")
    ends = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    run = run.withColumn("_e", ends)
    return run.select(
        F.col(score).alias("threshold"),
        F.try_divide(F.col("fp"), F.col("_e.n")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("_e.p")).alias("tpr"),
    )


def matthews(df: DataFrame, label="label", predicted="predicted") -> DataFrame:
    """Matthews correlation from the class margins, for any number of classes."""
    cells = confusion(df, label, predicted)
    total = cells.agg(
        F.sum("n").cast("double").alias("s"),
        F.sum(F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)).cast("double").alias("c"),
    )
    t = cells.groupBy(F.col(label).alias("k")).agg(F.sum("n").cast("double").alias("t"))
    p = cells.groupBy(F.col(predicted).alias("k")).agg(F.sum("n").cast("double").alias("p"))
    both = t.join(p, "k", "full").fillna(0.0, ["t", "p"])
    margins = both.agg(
        F.struct(
            F.sum(F.col("t") * F.col("p")).alias("tp"),
            F.sum(F.col("t") * F.col("t")).alias("tt"),
            F.sum(F.col("p") * F.col("p")).alias("pp"),
        )
    ).scalar()
    x = total.withColumn("_m", margins)
    s, c = F.col("s"), F.col("c")
    top = c * s - F.col("_m.tp")
    bottom = F.sqrt(s * s - F.col("_m.pp")) * F.sqrt(s * s - F.col("_m.tt"))
    return x.select(_ratio(top, bottom).alias("mcc"))


def misclassified(df: DataFrame, id="id", label="label", predicted="predicted") -> DataFrame:
    """Wrong rows. Labels and predictions sit in one row, joined by id upstream."""
    return df.filter(F.col(label) != F.col(predicted)).select(
        id, F.col(label).alias("true_label"), F.col(predicted).alias("predicted_label")
    )


def by_threshold(score, high, low, at: float = 0.5):
    """Label column: ``high`` above ``at``, else ``low``."""
    c = F.col(score) if isinstance(score, str) else score
    return F.when(c > at, high).otherwise(low)


def decide(df: DataFrame, scores: dict, at_least: float = 0.0, keep=("id",)) -> DataFrame:
    """Class and score of two probability columns, by falling score.

    Ties are dropped; so are rows whose best score is not above ``at_least``.
    """
    (a_col, a), (b_col, b) = scores.items()
    p, q = F.col(a_col), F.col(b_col)
    out = df.select(
        *keep,
        F.when(p > q, a).when(q > p, b).alias("predicted"),
        F.greatest(p, q).alias("score"),
    )
    out = out.filter(F.col("predicted").isNotNull() & (F.col("score") > at_least))
    return out.orderBy(F.desc("score"), *keep)
