"""Dedupe, balance, split, scale and set operations.

The order that decides "first", "truncate" and "split" is always an argument and must
end with an id. Numbering within a class uses :mod:`rostrum.operators.ordered`, so a
class that holds most of the rows is spread over many tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators import ordered


def dedupe(df: DataFrame, key="text", order_by="id") -> DataFrame:
    """First row of each key. Spark keeps one row per key and task before the shuffle
    (``row_number() = 1``), so copies of one text do not gather in a task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*ordered._cols(order_by))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1).drop("_n")


def exclude(df: DataFrame, used: DataFrame, key="text") -> DataFrame:
    """Rows whose key is not in ``used``."""
    return df.join(used.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key="id") -> DataFrame:
    """Rows whose key is in ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def without_values(df: DataFrame, col, values) -> DataFrame:
    """Drop rows by a short list of ids or annotators. A NULL value stays."""
    return df.filter(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def balance(df: DataFrame, label, classes, order_by) -> DataFrame:
    """Truncate two or more classes to the size of the smallest; others vanish."""
    kept = df.filter(F.col(label).isin(list(classes)))
    smallest = kept.agg(
        F.least(*[F.count_if(F.col(label) == F.lit(c)) for c in classes])
        if len(classes) > 1
        else F.count(F.lit(1))
    ).scalar()
    rows = ordered.numbered(kept, order_by, label, "_n")
    return rows.filter(F.col("_n") <= smallest).drop("_n")


def stratified_split(df: DataFrame, label, order_by, fractions=(0.8, 0.1), out="split") -> DataFrame:
    """Ordered split within each class: the first ``floor(n·a)`` rows train, the next
    ``floor(n·b)`` validate, the rest test."""
    a, b = (float(f) for f in fractions)
    rows = ordered.numbered(df, order_by, label, "_n", "_size")
    train = F.floor(F.col("_n_size") * F.lit(a))
    valid = train + F.floor(F.col("_n_size") * F.lit(b))
    part = (
        F.when(F.col("_n") <= train, "train")
        .when(F.col("_n") <= valid, "validation")
        .otherwise("test")
    )
    return rows.withColumn(out, part).drop("_n", "_n_size")


def two_way_split(df: DataFrame, label, order_by, fractions=(0.8, 0.1), out="split") -> DataFrame:
    """The same split with validation and test merged."""
    rows = stratified_split(df, label, order_by, fractions, out)
    return rows.withColumn(out, F.when(F.col(out) == "train", "train").otherwise("test"))


def seeded_key(id="id", seed: int = 42) -> list[Column]:
    """A shuffling order that depends on the id and the seed only. MD5 has the same values
    in every engine."""
    c = F.col(id) if isinstance(id, str) else id
    return [F.md5(F.concat_ws("-", F.lit(str(seed)), c.cast("string")).cast("binary")), c]


def shuffled(df: DataFrame, id="id", seed: int = 42) -> DataFrame:
    return df.orderBy(*seeded_key(id, seed))


def random_split(df: DataFrame, label, id="id", seed=42, fractions=(0.8, 0.1)) -> DataFrame:
    """Seeded random split, stratified by class."""
    return stratified_split(df, label, seeded_key(id, seed), fractions)


def balanced_random_split(df, label, classes, id="id", seed=42, fractions=(0.8, 0.1)) -> DataFrame:
    """Shuffle, truncate to the smallest class, then split each class."""
    key = seeded_key(id, seed)
    return stratified_split(balance(df, label, classes, key), label, key, fractions)


def fixed_test_split(
    df: DataFrame, label, classes, order_by, n_test: int = 100, train: float = 0.9
) -> DataFrame:
    """The first ``n_test`` rows of each class test; of the rest ``floor(n·train)`` train
    and the others validate. New ids run over train, validation and test; inside a part
    over the classes in the given order."""
    kept = df.filter(F.col(label).isin(list(classes)))
    rows = ordered.numbered(kept, order_by, label, "_n", "_size")
    rest = F.greatest(F.col("_n_size") - n_test, F.lit(0))
    edge = n_test + F.floor(rest * F.lit(float(train)))
    rows = rows.withColumn(
        "split",
        F.when(F.col("_n") <= n_test, "test")
        .when(F.col("_n") <= edge, "train")
        .otherwise("validation"),
    )
    # Positions follow from the class sizes, so no second ordering is needed.
    class_rank = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label))
    part_rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    sizes = kept.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    n_rest = F.greatest(F.col("_size") - n_test, F.lit(0))
    n_train = F.floor(n_rest * F.lit(float(train)))
    first_test = F.least(F.col("_size"), F.lit(n_test))
    parts = F.array(
        F.struct(F.lit("train").alias("split"), n_train.alias("_c"), first_test.alias("_skip")),
        F.struct(
            F.lit("validation").alias("split"), (n_rest - n_train).alias("_c"),
            (first_test + n_train).alias("_skip"),
        ),
        F.struct(F.lit("test").alias("split"), first_test.alias("_c"), F.lit(0).cast("long").alias("_skip")),
    )
    cells = sizes.select(label, F.explode(parts).alias("_p")).select(
        label, "_p.*", class_rank.alias("_cr")
    ).withColumn("_pr", part_rank)
    before = (
        Window.partitionBy(F.lit(0)).orderBy("_pr", "_cr").rowsBetween(Window.unboundedPreceding, -1)
    )
    cells = cells.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    out = ordered.match_groups(rows, cells.drop("_cr", "_pr", "_c"), [label, "split"])
    new_id = F.col("_before") + F.col("_n") - F.col("_skip")
    return out.withColumn("new_id", new_id).drop("_n", "_n_size", "_before", "_skip")


def renumber(df: DataFrame, order_by, out="new_id") -> DataFrame:
    """Ids 1, 2, 3 … in an explicit order."""
    return ordered.numbered(df, order_by, (), out)


def concat(*dfs: DataFrame) -> DataFrame:
    """All rows of all datasets; a column missing in one becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def common(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def difference(a: DataFrame, b: DataFrame, key) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def minmax_scale(train: DataFrame, df: DataFrame, cols) -> DataFrame:
    """Scale to the range seen on ``train``; a constant column becomes 0."""
    ends = train.agg(
        F.struct(
            *[F.min(c).cast("double").alias(f"lo_{c}") for c in cols],
            *[F.max(c).cast("double").alias(f"hi_{c}") for c in cols],
        )
    ).scalar()
    out = df.withColumn("_ends", ends)
    scaled = {
        c: F.coalesce(
            F.try_divide(
                F.col(c).cast("double") - F.col(f"_ends.lo_{c}"),
                F.col(f"_ends.hi_{c}") - F.col(f"_ends.lo_{c}"),
            ),
            F.when(F.col(c).isNotNull(), F.col(c).cast("double") - F.col(f"_ends.lo_{c}")),
        )
        for c in cols
    }
    return out.withColumns(scaled).drop("_ends")


def build_pool(df: DataFrame, used: DataFrame, order_by="id", issue="issue") -> DataFrame:
    """Unused, distinct texts with ``issue`` renamed to ``target``."""
    return dedupe(exclude(df, used), "text", order_by).select(
        "id", "text", F.col(issue).alias("target")
    )


def class_weights(df: DataFrame, label="label", out="weight") -> DataFrame:
    """Attach ``n / (k · n_c)`` to each row."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    every = Window.partitionBy(F.lit(0))
    weights = counts.select(
        label,
        (F.sum("_c").over(every) / (F.count(F.lit(1)).over(every) * F.col("_c"))).alias(out),
    )
    return ordered.match_groups(df, weights, label)
