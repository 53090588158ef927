"""Running totals and numbering that do not put one class into one task.

``row_number`` or a running ``sum`` over a window sends a whole partition of the
window to one task. With two classes that is half of the data. Here the ordering
key is cut into ranges first: the split points come from a small hash sample of
the keys, each range is numbered by itself, and the totals of the earlier ranges
are added. All of it is lazy, and the split points are a pure function of the
data, so a lost executor recomputes the same ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERSAMPLE = 16
RANGE_ROWS = 1_000_000


def _cols(spec) -> list[Column]:
    if spec is None:
        return []
    if isinstance(spec, (str, Column)):
        spec = [spec]
    return [F.col(c) if isinstance(c, str) else c for c in spec]


def with_range(df: DataFrame, key: Column, out: str = "_range") -> DataFrame:
    """Add the number of the key range a row falls into.

    There is a range for every ``RANGE_ROWS`` rows, and one per shuffle partition at least.
    The sample keeps keys whose hash is 0 modulo ``rows / wanted``: about ``OVERSAMPLE``
    keys per range, whatever the size of the data. Equal keys hash alike and are collected
    once, so a hot key cannot swell the sample.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = df.select(key.alias("_k"))
    rows = keyed.agg(F.count(F.lit(1)).alias("n")).scalar()
    n_bounds = F.greatest(F.lit(max(7, parts)).cast("long"), F.floor(rows / RANGE_ROWS))
    step = F.greatest(F.lit(1).cast("long"), F.floor(rows / (OVERSAMPLE * (n_bounds + 1))))
    sample = keyed.filter(F.pmod(F.xxhash64("_k"), step) == 0).agg(
        F.sort_array(F.collect_set("_k")).alias("s")
    ).withColumn("_n", n_bounds)
    stride = F.greatest(F.lit(1.0), F.size("s") / (F.col("_n") + 1).cast("double"))
    positions = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("_n")), lambda i: F.floor(i * stride).cast("int")
    )
    bounds = sample.select(
        F.filter(F.transform(positions, lambda p: F.get("s", p)), lambda b: b.isNotNull())
    ).scalar()
    df = df.withColumn("_bounds", bounds)
    # Halvings of a binary search over the bounds.
    depth = F.ceil(F.log2(F.size("_bounds") + F.lit(2.0))).cast("int")
    halvings = F.transform(F.sequence(depth - 1, F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2.0), i).cast("int"))

    def search(k):
        return F.aggregate(
            halvings, F.lit(0), lambda at, jump: F.when(F.get("_bounds", at + jump - 1) <= k, at + jump).otherwise(at)
        )

    # Bound in an array of one, the key is made once a row and not at each halving.
    found = F.get(F.transform(F.array(key), search), F.lit(0))
    # Not nullable: a join on it then brings no IS NOT NULL filter, which the optimizer
    # would evaluate again on the rows below.
    return df.withColumn(out, F.coalesce(found, F.lit(0))).drop("_bounds")


def digest_range(df: DataFrame, digest: str) -> Column:
    """The range of a hexadecimal digest, by its first digits: digests are even, so no sample is needed."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    wanted = F.greatest(F.lit(max(8, parts)).cast("long"), F.floor(rows / RANGE_ROWS))
    first = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.coalesce(F.shiftright(first * wanted, 32).cast("int"), F.lit(0))


def running_totals(
    df: DataFrame, values: dict, order_by, by=(), whole: str = "", least: bool = False, ranged: Column | None = None
) -> DataFrame:
    """Inclusive running sum of each ``values[name]`` within ``by``; ``least``: the running minimum.

    ``order_by`` must identify a row within ``by``: break ties with an id. With ``whole``
    the sum over the whole group is added as ``name + whole``; it comes for free. ``ranged``
    is the number of a row's range, where it is known; it must follow the order.
    """
    order = _cols(order_by)
    group = F.struct(F.lit(0).alias("_"), *[c.alias(f"g{i}") for i, c in enumerate(_cols(by))])
    key = F.struct(group.alias("g"), *[c.alias(f"k{i}") for i, c in enumerate(order)])
    work = df.withColumns(
        {"_group": group, **{f"_v_{name}": v for name, v in values.items()}}
    )
    work = with_range(work, key) if ranged is None else work.withColumn("_range", ranged)
    taken = F.min if least else F.sum
    totals = work.groupBy("_group", "_range").agg(
        *[taken(f"_v_{n}").alias(f"_t_{n}") for n in values]
    )
    # One row per group and range: small, whatever the number of rows.
    earlier = (
        Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    group = Window.partitionBy("_group")
    offsets = totals.select(
        F.col("_group").alias("_og"),
        F.col("_range").alias("_or"),
        *[taken(f"_t_{n}").over(group).alias(f"_w_{n}") for n in values if whole],
        *[
            (taken(f"_t_{n}").over(earlier) if least else F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)))
            .alias(f"_e_{n}")
            for n in values
        ],
    )
    inside = (
        Window.partitionBy("_group", "_range")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    work = work.withColumns({f"_r_{n}": taken(f"_v_{n}").over(inside) for n in values})
    # A struct equals itself even with NULL inside, and plain equality lets the join
    # reuse the partitioning of the window.
    same = (F.col("_group") == F.col("_og")) & (F.col("_range") == F.col("_or"))
    out = work.join(offsets, same)
    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        # Of a minimum and nothing earlier, the minimum.
        *[
            (F.least(f"_r_{n}", f"_e_{n}") if least else F.col(f"_r_{n}") + F.col(f"_e_{n}")).alias(n)
            for n in values
        ],
        *[F.col(f"_w_{n}").alias(n + whole) for n in values if whole],
    )


def numbered(
    df: DataFrame, order_by, by=(), out: str = "n", whole: str = "", ranged: Column | None = None
) -> DataFrame:
    """Add the 1-based position of each row within ``by``; with ``whole`` also the size
    of its group, as ``out + whole``."""
    return running_totals(df, {out: F.lit(1).cast("long")}, order_by, by, whole, ranged=ranged)


def quantiles(df: DataFrame, by, value: str, points: dict) -> DataFrame:
    """Exact quantiles by linear interpolation between neighbouring ranks.

    Equal values are counted before the shuffle, so the work follows the number of
    distinct values; the counts are then summed up in order.
    """
    by = [by] if isinstance(by, str) else list(by)
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    return count_quantiles(counts, by, value, points)


def count_quantiles(counts: DataFrame, by, value: str, points: dict) -> DataFrame:
    """The same from a table ``(*by, value, _c)`` of value counts."""
    run = running_totals(counts, {"_upto": F.col("_c")}, value, by, whole="_all")

    def place(q):
        return (F.col("_upto_all") - 1) * F.lit(float(q))

    def at(rank):
        held = (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
        return F.max(F.when(held, F.col(value).cast("double")))

    got = run.groupBy(*by).agg(
        F.max("_upto_all").alias("_upto_all"),
        *[at(F.floor(place(q))).alias(f"_lo_{n}") for n, q in points.items()],
        *[at(F.ceil(place(q))).alias(f"_hi_{n}") for n, q in points.items()],
    )

    def between(name, q):
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        return (lo + (hi - lo) * (place(q) - F.floor(place(q)))).alias(name)

    return got.select(*by, *[between(n, q) for n, q in points.items()])


def match_groups(df: DataFrame, stats: DataFrame, by) -> DataFrame:
    """Attach per-group statistics (one row per group) to the rows of ``df``.

    A plain join on the group keys, null-safe: adaptive execution broadcasts the statistics
    by their bytes, and splits hot groups where it has to shuffle.
    """
    by = [by] if isinstance(by, str) else list(by)
    right = stats
    for c in by:
        right = right.withColumnRenamed(c, f"_g_{c}")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return df.join(right, same).drop(*[f"_g_{c}" for c in by])
