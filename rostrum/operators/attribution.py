"""Summaries of feature attributions.

``attributions`` is ``(id, pos_i, feature, value)``, one row per token of an example.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import fixed, tails
from rostrum.functions import text as T
from rostrum.operators import ordered, stats


def explode_attributions(df: DataFrame, attributions="attributions", id="id") -> DataFrame:
    """``array<struct<feature, value>>`` per example to rows."""
    return df.select(F.col(id).alias("id"), F.posexplode(attributions).alias("pos_i", "_a")).select(
        "id", "pos_i", "_a.feature", "_a.value"
    )


def lexicon_join(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens with the category of their ``(pos, lemma)``."""
    words = lexicon.select("category", "pos", F.col("entry").alias("lemma")).distinct()
    return toks.join(words, ["pos", "lemma"])


def group_sums(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Sum, positive part and negative part of the values of each feature group."""
    v = F.col("value")
    return lexicon_join(toks, lexicon).groupBy(F.col("category").alias("feature")).agg(
        F.sum(v).alias("total"),
        F.sum(F.greatest(v, F.lit(0.0))).alias("total_positive"),
        F.sum(F.least(v, F.lit(0.0))).alias("total_negative"),
    )


def mean_absolute(attributions: DataFrame) -> DataFrame:
    """Mean absolute value per token feature, largest first."""
    return (
        attributions.groupBy("feature").agg(F.avg(F.abs("value")).alias("value"))
        .orderBy(F.desc("value"), "feature")
    )


def lexical_classes(
    toks: DataFrame, markers=None, excluded=(), interjections=None, has_vector: str | None = None
) -> DataFrame:
    """Attribution values by lexical class, in long form: ``bucket, value``.

    A word may fall into several classes. Words in ``excluded`` and the placeholder
    ``entity`` are left out. ``word_length`` rows carry the length in place of the value.
    ``interjections`` limits that class to a list. ``has_vector`` names a boolean column that
    tells words from subwords: a subword counts for its nominal suffix only.
    """
    word = F.lower("text")
    markers = fixed.DISCOURSE_MARKERS if markers is None else markers
    suffix = "(" + "|".join(fixed.NOMINAL_SUFFIXES) + ")$"
    v = F.col("value")
    whole = F.lit(True) if has_vector is None else F.coalesce(F.col(has_vector), F.lit(False))
    listed = F.lit(True) if interjections is None else word.isin(list(interjections))
    rules = {
        "interjection": ((F.col("pos") == "INTJ") & listed, v),
        "nominalization": (word.rlike(suffix), v),
        "discourse_marker": (word.isin(list(markers)), v),
        "modal_verb": (F.col("tag") == "MD", v),
        "personal_pronoun": (word.isin(fixed.PERSONAL_PRONOUNS), v),
        "lexical_word": (F.col("pos").isin(fixed.LEXICAL_POS), v),
        "word_length": (F.lit(True), F.length("text").cast("double")),
    }
    buckets = F.array(
        *[
            F.when(ok if n == "nominalization" else ok & whole, F.struct(F.lit(n).alias("bucket"), x.alias("value")))
            for n, (ok, x) in rules.items()
        ]
    )
    gone = (word == "entity") | F.col("lemma").isin(list(excluded))
    kept = toks.filter(~gone & ~F.col("is_punct"))
    keep = [c for c in ("label",) if c in toks.columns]
    rows = kept.select(*keep, F.explode(F.filter(buckets, lambda b: b.isNotNull())).alias("_b"))
    return rows.select(*keep, "_b.bucket", "_b.value")


def _scale(x, ends, scale: str):
    """One value scaled by the statistics struct of its series."""
    if scale == "minmax":
        return F.try_divide(x - ends["lo"], ends["hi"] - ends["lo"])
    if scale == "zscore":
        return F.try_divide(x - ends["mean"], ends["sd"])
    raise ValueError(f"unknown scale {scale!r}")


def _ends(value):
    return F.struct(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("sd"),
    )


def scaled(df: DataFrame, series, value="value", scale: str = "zscore") -> DataFrame:
    """Scale each series by its population deviation, or to its range."""
    ends = df.groupBy(series).agg(_ends(F.col(value)).alias("_e"))
    rows = ordered.match_groups(df, ends, series)
    return rows.withColumn(value, _scale(F.col(value), F.col("_e"), scale)).drop("_e")


def agreement(a: DataFrame, b: DataFrame, on="feature", scale: str = "zscore", p: bool = True) -> DataFrame:
    """Agreement of two score series with one row per feature.

    Both are scaled; then Welch's t, the mean difference and its limits of agreement
    (mean ± 1.96 population deviations) in one row.
    """
    joined = a.select(on, F.col("value").alias("x")).join(b.select(on, F.col("value").alias("y")), on)
    both = joined.agg(F.struct(_ends(F.col("x")).alias("x"), _ends(F.col("y")).alias("y"))).scalar()
    z = joined.withColumn("_e", both).select(
        on,
        _scale(F.col("x"), F.col("_e.x"), scale).alias("x"),
        _scale(F.col("y"), F.col("_e.y"), scale).alias("y"),
    )
    gap = F.col("x") - F.col("y")
    n = F.count(F.lit(1))
    t, df = stats.welch(
        n, F.avg("x"), F.var_samp("x"), n, F.avg("y"), F.var_samp("y")
    )
    out = z.agg(
        t.alias("t"), df.alias("df"), F.avg(gap).alias("mean_difference"),
        (F.avg(gap) - 1.96 * F.stddev_pop(gap)).alias("lower_limit"),
        (F.avg(gap) + 1.96 * F.stddev_pop(gap)).alias("upper_limit"),
    )
    return out.withColumn("p", tails.t_p(F.col("t"), F.col("df"))) if p else out


def signed_words(attributions: DataFrame) -> DataFrame:
    """Words of an example that speak for and against, strongest first on each side.
    Punctuation is dropped. One example bounds the size of a group."""
    word = attributions.filter(F.col("feature").rlike(rf"[{T.WORD_CHAR}]"))
    item = F.struct(F.col("value").alias("v"), F.col("pos_i").alias("i"), F.col("feature").alias("f"))
    up = F.struct((-F.col("value")).alias("v"), F.col("pos_i").alias("i"), F.col("feature").alias("f"))
    g = word.groupBy("id").agg(
        F.array_sort(F.collect_list(F.when(F.col("value") > 0, up))).alias("_for"),
        F.array_sort(F.collect_list(F.when(F.col("value") < 0, item))).alias("_against"),
    )
    return g.select(
        "id",
        F.transform("_for", lambda x: x["f"]).alias("support_words"),
        F.transform("_against", lambda x: x["f"]).alias("oppose_words"),
    )


def linear_attribution(df: DataFrame, train: DataFrame, coefficients: dict, id="id") -> DataFrame:
    """Attribution of a linear model: coefficient × (value − mean on train), long form."""
    means = train.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients])).scalar()
    x = df.withColumn("_m", means)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (F.lit(float(w)) * (F.col(c).cast("double") - F.col(f"_m.{c}"))).alias("value"),
            )
            for c, w in coefficients.items()
        ]
    )
    return x.select(F.col(id).alias("id"), F.explode(rows).alias("_r")).select("id", "_r.feature", "_r.value")
