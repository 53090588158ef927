"""Descriptive statistics, class comparison tests and corrections.

Long form is used throughout: one row per ``(class, feature)``. Tests are closed
formulas over aggregates, so the data is read once with map-side partial sums; only
the p values of the result rows go through Python.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import fixed, tails
from rostrum.operators import ordered, selection
from rostrum.streaming import resume


def _list(x) -> list:
    return [x] if isinstance(x, str) else list(x)


def melt(df: DataFrame, by, cols) -> DataFrame:
    """``(*by, feature, value)``, one row per value. Arrays are flattened."""
    arrays = {n for n, t in df.dtypes if t.startswith("array")}
    by = _list(by)
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                (
                    F.col(c).cast("array<double>")
                    if c in arrays
                    else F.array(F.col(c).cast("double"))
                ).alias("values"),
            )
            for c in cols
        ]
    )
    rows = df.select(*by, F.explode(pairs).alias("_p"))
    return rows.select(
        *by, F.col("_p.feature").alias("feature"), F.explode("_p.values").alias("value")
    )


def _safe_div(a, b) -> Column:
    return F.try_divide(a, b)


def describe_long(long: DataFrame, by) -> DataFrame:
    """Statistics per group of a long table. Deviation and variance are those of the
    population, skewness is biased and kurtosis is the excess; the mode is the lowest of
    the most frequent values. The median is exact, see :mod:`rostrum.operators.selection`.

    The table is read once for the moments, once per round of the median, and once for the mode,
    whose counts are the only step that follows the number of distinct values."""
    by = _list(by)
    v = F.col("value")
    basic = resume.cut_lineage(
        long.groupBy(*by).agg(
            F.count(v).alias("n"),
            F.avg(v).alias("mean"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
            (F.max(v) - F.min(v)).alias("range"),
            F.stddev_pop(v).alias("sd"),
            F.var_pop(v).alias("variance"),
            F.skewness(v).alias("skewness"),
            F.kurtosis(v).alias("kurtosis"),
            *selection.extremes_of(v),
        )
    )
    counts = long.filter(v.isNotNull()).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("_c"))
    modes = counts.groupBy(*by).agg(
        F.min_by("value", F.struct((-F.col("_c")).alias("c"), v.alias("v"))).alias("mode")
    )
    medians = selection.quantiles(long, by, {"median": 0.5}, extremes=basic.select(*by, "_n", "_lo", "_hi"))
    out = ordered.match_groups(basic.drop("_n", "_lo", "_hi"), modes, by)
    return ordered.match_groups(out, medians, by)


def describe_by(df: DataFrame, by, cols) -> DataFrame:
    """Descriptive statistics per class and feature."""
    return describe_long(melt(df, by, cols), _list(by) + ["feature"])


def group_stats(long: DataFrame, by="feature") -> DataFrame:
    """Mean, sample deviation and variance, range, skewness and excess kurtosis."""
    v = F.col("value")
    return long.groupBy(*_list(by)).agg(
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.var_samp(v).alias("variance"),
        (F.max(v) - F.min(v)).alias("range"),
        F.skewness(v).alias("skewness"),
        F.kurtosis(v).alias("kurtosis"),
    )


def class_variance(df: DataFrame, label, cols, classes) -> DataFrame:
    """Sample variance of each feature, one column per class."""
    long = melt(df, label, cols)
    return long.groupBy("feature").agg(
        *[F.var_samp(F.when(F.col(label) == F.lit(c), F.col("value"))).alias(f"var_{c}") for c in classes]
    )


def correlations(df: DataFrame, by, cols, digits: int = 3) -> DataFrame:
    """Pearson correlation of every feature pair per class, in long form.

    All pairs are aggregates of one pass. A pair skips the rows where either is NULL.
    """
    by = _list(by)
    pairs = list(combinations(cols, 2))

    def one(a, b):
        a, b = F.col(a).cast("double"), F.col(b).cast("double")
        both = a.isNotNull() & b.isNotNull()
        return F.corr(F.when(both, a), F.when(both, b))

    wide = df.groupBy(*by).agg(*[one(a, b).alias(f"_c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(
                F.lit(a).alias("f1"),
                F.lit(b).alias("f2"),
                F.round(F.col(f"_c{i}"), digits).alias("corr"),
            )
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return wide.select(*by, F.explode(rows).alias("_r")).select(*by, "_r.f1", "_r.f2", "_r.corr")


def correlated_features(corr: DataFrame, threshold: float = fixed.MAX_CORRELATION) -> DataFrame:
    """Features that correlate with an earlier one beyond ``threshold`` in any class."""
    return (
        corr.filter(F.abs("corr") > threshold)
        .select(F.col("f2").alias("feature"))
        .distinct()
    )


def class_counts(df: DataFrame, label="label") -> DataFrame:
    """Rows and percentage per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("percent", F.lit(100.0) * F.col("n") / total)


def value_counts(df: DataFrame, col) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def cross_table(df: DataFrame, label, value, values) -> DataFrame:
    """Share of each value within each class; the rows sum to one."""
    hits = [F.count_if(F.col(value) == F.lit(v)) for v in values]
    total = sum(hits[1:], hits[0])
    return df.groupBy(label).agg(
        *[_safe_div(h, total).alias(f"share_{v}") for h, v in zip(hits, values)]
    )


# --- tests -----------------------------------------------------------------


def welch(n1, m1, v1, n2, m2, v2) -> tuple[Column, Column]:
    """t and degrees of freedom of Welch's test from counts, means, sample variances."""
    a, b = _safe_div(v1, n1), _safe_div(v2, n2)
    t = _safe_div(m1 - m2, F.sqrt(a + b))
    df = _safe_div((a + b) * (a + b), _safe_div(a * a, n1 - 1) + _safe_div(b * b, n2 - 1))
    return t, df


def welch_long(long: DataFrame, label, classes, p: bool = True) -> DataFrame:
    """Welch t-test per feature between two classes of a long table, with the class
    means and sample deviations. Sorted by p when p is asked for."""
    aggs = []
    for k, c in enumerate(classes, 1):
        v = F.when(F.col(label) == F.lit(c), F.col("value"))
        aggs += [
            F.count(v).alias(f"n{k}"), F.avg(v).alias(f"mean{k}"),
            F.var_samp(v).alias(f"_v{k}"), F.stddev_samp(v).alias(f"sd{k}"),
        ]
    g = long.filter(F.col(label).isin(list(classes))).groupBy("feature").agg(*aggs)
    t, df = welch(*[F.col(x) for x in ("n1", "mean1", "_v1", "n2", "mean2", "_v2")])
    out = g.withColumns({"t": t, "df": df}).drop("_v1", "_v2")
    if not p:
        return out
    return out.withColumn("p", tails.t_p(F.col("t"), F.col("df"))).orderBy("p")


def t_tests(df: DataFrame, label, classes, cols, p: bool = True) -> DataFrame:
    return welch_long(melt(df, label, cols), label, classes, p)


def log_t_tests(long: DataFrame, label, classes, alpha: float = 0.05) -> DataFrame:
    """Welch t-tests on the natural log of the positive values, Bonferroni-corrected."""
    logs = long.filter(F.col("value") > 0).withColumn("value", F.ln("value"))
    return correct(welch_long(logs, label, classes), alpha=alpha)


def correct(df: DataFrame, p="p", alpha: float = 0.05, by=()) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg corrected p values and reject flags.

    ``df`` has one row per tested feature. A family may hold most of them: its p values are counted,
    summed up in ranges of p for the ranks, and the step-up is a running minimum over the same kind
    of ranges from the largest p down. A row without a p value counts for nothing and gets 1.
    """
    by = _list(by)
    counts = resume.cut_lineage(
        df.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    )
    ranked = ordered.running_totals(counts, {"_rank": F.col("_c")}, "_p", by, whole="_all")
    ranked = resume.cut_lineage(ranked.withColumnRenamed("_rank_all", "_m"))
    step = F.col("_p") * F.col("_m") / F.col("_rank")
    stepped = ordered.running_totals(ranked, {"_bh": step}, -F.col("_p"), by, least=True)
    stepped = stepped.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], "_p", "_m", "_bh")
    same = F.col(p) == F.col("_p")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{k}"))
    out = df.join(stepped, same, "left").withColumns({
        "bonferroni": F.least(F.lit(1.0), F.col(p) * F.col("_m")), "bh": F.least(F.lit(1.0), F.col("_bh")),
    })
    return out.withColumns({
        "reject_bonferroni": F.col("bonferroni") <= alpha, "reject_bh": F.col("bh") <= alpha,
    }).drop("_m", "_bh", "_p", *[f"_g{k}" for k in range(len(by))])


def yates(a, b, c, d) -> Column:
    """Chi-square of a 2×2 table with Yates' correction; 0 when a margin is empty."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2)
    return F.coalesce(
        _safe_div(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d)), F.lit(0.0)
    )


def term_bias(
    freq1: DataFrame,
    freq2: DataFrame,
    names=("class1", "class2"),
    p_below: float = 0.001,
    totals=None,
    with_p: bool = True,
) -> DataFrame:
    """Terms used more by one class than by the other.

    ``freq1`` and ``freq2`` are ``(term, n)``. The 2×2 table is the term against the
    rest of the list (``totals=None``) or of the corpus (``totals=(n1, n2)``). A term
    missing in one class counts 0. Kept when p is under ``p_below``, tested through the
    critical value so that the filter stays in the JVM.
    """
    both = (
        freq1.select("term", F.col("n").alias("a"), F.lit(0).cast("long").alias("c"))
        .unionByName(freq2.select("term", F.lit(0).cast("long").alias("a"), F.col("n").alias("c")))
        .groupBy("term")
        .agg(F.sum("a").alias("a"), F.sum("c").alias("c"))
    )
    return count_bias(both, names, p_below, totals, with_p)


def class_bias(freq: DataFrame, label, classes, names=None, **options) -> DataFrame:
    """The same from one table ``(label, term, n)``: one aggregate for both classes."""
    n, one, two = F.col("n"), *[F.col(label) == F.lit(c) for c in classes]
    both = freq.groupBy("term").agg(
        F.coalesce(F.sum(F.when(one, n)), F.lit(0)).alias("a"), F.coalesce(F.sum(F.when(two, n)), F.lit(0)).alias("c")
    )
    return count_bias(both.filter("a + c > 0"), names or classes, **options)


def count_bias(both: DataFrame, names, p_below: float = 0.001, totals=None, with_p: bool = True) -> DataFrame:
    """The same from ``(term, a, c)``, which is written once: totals and ends read it again."""
    both = resume.cut_lineage(both)
    if totals is None:
        n1, n2 = both.agg(F.sum("a")).scalar(), both.agg(F.sum("c")).scalar()
    else:
        n1, n2 = F.lit(totals[0]).cast("long"), F.lit(totals[1]).cast("long")
    both = both.withColumns({"_n1": n1, "_n2": n2})
    a, c = F.col("a"), F.col("c")
    b, d = F.col("_n1") - a, F.col("_n2") - c
    expected = (F.col("_n1") * (a + c)).cast("double") / (F.col("_n1") + F.col("_n2"))
    out = (
        both.withColumn("statistic", yates(a, b, c, d))
        .filter(F.col("statistic") > tails.chi2_critical(p_below))
        .withColumn("biased_class", F.when(a > expected, names[0]).otherwise(names[1]))
        .withColumn("frequency", F.when(a > expected, a).otherwise(c))
        .select("term", "statistic", "biased_class", "frequency")
    )
    ends = out.agg(F.struct(F.min("statistic").alias("lo"), F.max("statistic").alias("hi"))).scalar()
    out = out.withColumn("_e", ends)
    out = out.withColumn(
        "statistic_norm",
        _safe_div(F.col("statistic") - F.col("_e.lo"), F.col("_e.hi") - F.col("_e.lo")),
    ).drop("_e")
    return out.withColumn("p", tails.chi2_p(F.col("statistic"))) if with_p else out


def top_biased(bias: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` strongest terms of each class."""
    w = Window.partitionBy("biased_class").orderBy(F.desc("statistic_norm"), "term")
    return bias.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def frame_bias(df: DataFrame, label, positive, vector="semantic_frames", k: int = 30) -> DataFrame:
    """Chi-square of label against presence, for each position of a 0/1 vector.

    A position with one value only has statistic 0. The ``k`` strongest are returned.
    """
    rows = df.select(
        (F.col(label) == F.lit(positive)).alias("_pos"),
        F.posexplode(vector).alias("frame_index", "_bit"),
    )
    hit = F.col("_bit") == 1
    g = rows.groupBy("frame_index").agg(
        F.count_if(F.col("_pos") & hit).alias("a"),
        F.count_if(F.col("_pos") & ~hit).alias("b"),
        F.count_if(~F.col("_pos") & hit).alias("c"),
        F.count_if(~F.col("_pos") & ~hit).alias("d"),
    )
    out = g.withColumn("statistic", yates(*[F.col(x) for x in "abcd"]))
    return out.orderBy(F.desc("statistic"), "frame_index").limit(k)


def chi2_scores(df: DataFrame, label, cols) -> DataFrame:
    """Chi-square score of non-negative features: class sums against the sums expected
    from the share of each class."""
    long = melt(df, label, cols)
    seen = long.groupBy(label, "feature").agg(F.sum("value").alias("_o"))
    share = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    all_rows = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    share = share.withColumn("_share", F.col("_n") / all_rows).drop("_n")
    x = ordered.match_groups(seen, share, label)
    # One row per class and feature from here on.
    total = F.sum("_o").over(Window.partitionBy("feature"))
    x = x.withColumn("_e", total * F.col("_share"))
    gap = F.col("_o") - F.col("_e")
    return x.groupBy("feature").agg(F.sum(_safe_div(gap * gap, F.col("_e"))).alias("statistic"))


def jarque_bera(df: DataFrame, by, cols, alpha: float = 0.05) -> DataFrame:
    """Normality gate per class and feature by the Jarque-Bera statistic.

    Note: this is not the Shapiro-Wilk test, whose solver needs a sorted sample on one
    machine. The statistic has a chi-square limit with two degrees of freedom.
    """
    v = F.col("value")
    g = melt(df, by, cols).groupBy(*_list(by), "feature").agg(
        F.count(v).alias("n"), F.skewness(v).alias("_s"), F.kurtosis(v).alias("_k")
    )
    jb = F.col("n") / 6.0 * (F.col("_s") * F.col("_s") + F.col("_k") * F.col("_k") / 4.0)
    out = g.withColumn("jarque_bera", jb).drop("_s", "_k")
    out = out.withColumn("p", tails.chi2_p(F.col("jarque_bera"), 2.0))
    return out.withColumn("normal", F.col("p") > alpha)


# Terms of the series of the normal law, and how far out it is 0 or 1 to all digits.
TERMS, FAR = 120, 8.0


def normal_cdf(z: Column, square: Column | None = None) -> Column:
    """Normal distribution function: ``1/2 + phi(z) (z + z^3/3 + z^5/15 + ...)``, by Horner's rule.

    Every term asks for ``square``, the square of ``z``: a column of it is made once.
    """
    square = z * z if square is None else square
    odd = F.array(*[F.lit(float(2 * k + 1)) for k in range(TERMS, 0, -1)])
    inner = F.aggregate(odd, F.lit(1.0), lambda acc, k: F.lit(1.0) + acc * square / k)
    near = 0.5 + z * inner * F.exp(-square / 2) / float(np.sqrt(2 * np.pi))
    return F.when(z < -FAR, 0.0).when(z > FAR, 1.0).otherwise(near)


def kolmogorov_p(d: Column, n: Column) -> Column:
    """Limit of the chance of a gap above ``d``: ``2 sum (-1)^(k-1) exp(-2 k^2 n d^2)``."""
    x = n * d * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x),
    )
    return F.when(x < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_normality(df: DataFrame, by, cols, alpha: float = 0.05) -> DataFrame:
    """Kolmogorov-Smirnov test per class and feature against the normal law with the group's own
    mean and sample deviation: ``n, statistic, p, normal``.

    Equal values are counted, the counts summed up in ranges of values, and the largest gap on either
    side of each step taken by one aggregate: no group is sorted in one task. ``p`` is Kolmogorov's
    limit for a law given beforehand, so with fitted parameters it is too large. A constant feature
    and one of fewer than two values have no statistic.
    """
    keys = [*_list(by), "feature"]
    long = melt(df, by, cols).select(*keys, F.col("value").cast("double").alias("value")).filter("value IS NOT NULL")
    fitted = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_sd")
    )
    counts = long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_c"))
    run = ordered.running_totals(resume.cut_lineage(counts), {"_upto": F.col("_c")}, "value", keys)
    x = ordered.match_groups(run, fitted, keys)
    x = x.withColumn("_z", F.try_divide(F.col("value") - F.col("_mean"), F.col("_sd")))
    x = x.select("*", F.explode(F.array(F.col("_z") * F.col("_z"))).alias("_square"))
    x = x.withColumn("_f", normal_cdf(F.col("_z"), F.col("_square")))
    gap = F.greatest(
        F.col("_upto") / F.col("n") - F.col("_f"), F.col("_f") - (F.col("_upto") - F.col("_c")) / F.col("n")
    )
    out = x.groupBy(*keys).agg(F.max("n").alias("n"), F.max(F.when(F.col("_f").isNotNull(), gap)).alias("statistic"))
    out = out.withColumn("p", kolmogorov_p(F.col("statistic"), F.col("n")))
    return out.withColumns({"p": F.when(F.col("statistic").isNotNull(), F.col("p")), "normal": F.col("p") > alpha})


# --- shapes of distributions ----------------------------------------------------


def histogram(df: DataFrame, by, cols, bins: int = 20) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the minimum and maximum of each group.
    The last bin is closed; a constant feature falls into bin 1."""
    by = _list(by)
    keys = by + ["feature"]
    long = melt(df, by, cols).filter(F.col("value").isNotNull())
    ends = long.groupBy(*keys).agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    x = ordered.match_groups(long, ends, keys)
    at = F.floor(_safe_div((F.col("value") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo"))) + 1
    bin_no = F.least(F.lit(bins).cast("long"), F.coalesce(at, F.lit(1).cast("long")))
    return x.groupBy(*keys, bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, by, cols) -> DataFrame:
    """Quartiles, whiskers at 1.5 × IQR and the number of outliers per group: the quartiles by
    selection, the rest by one more aggregate of the rows."""
    by = _list(by)
    keys = by + ["feature"]
    long = melt(df, by, cols).filter(F.col("value").isNotNull())
    points = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    q = resume.cut_lineage(selection.quantiles(long, keys, points))
    x = ordered.match_groups(long, q, keys)
    v, iqr = F.col("value"), F.col("q3") - F.col("q1")
    inside = v.between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return x.groupBy(*keys).agg(
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
