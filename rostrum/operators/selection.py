"""Exact quantiles without sorting, and without a table of distinct values.

Every wanted rank of every group starts with the bracket of its group's smallest and largest value.
A round counts the rows of all open brackets in bins, map-side first, so that a task hands on at
most ``BINS`` rows per bracket, with the smallest and largest value of each bin. The bin that holds the
rank is the next bracket, as narrow as its values. A bracket of one value is settled. One round
settles columns of few values.

Bins have equal widths; where a bracket spans orders of magnitude on one side of zero they have equal
ratios, and a bracket on both sides is cut at zero after the first round, so heavy tails come to
an end as fast. A bracket of at most ``HELD`` rows is settled by its sorted values. Each bin function is monotone, and the ends of a bracket never share a bin: rounds
always narrow. Infinities and NaN, which is above all numbers, have bins of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.streaming import resume

BINS = 4096
HELD = 4096
RATIO = 1000.0
MOST = "cast('Infinity' as double)"
LEAST = "cast('-Infinity' as double)"


def _bin(first: bool) -> Column:
    """Bin of ``_x`` in the bracket ``_lo`` to ``_hi``."""
    def scaled(x, lo, hi):
        return f"least(cast(floor(({x} - {lo}) / ({hi} - {lo}) * {BINS}) as int), {BINS - 1})"

    # Halves keep the width of a bracket finite.
    linear = scaled("_x / 2", "_lo / 2", "_hi / 2")
    up = scaled("ln(_x)", "ln(_lo)", "ln(_hi)")
    # The same mirrored: a larger size is a smaller number.
    down = f"{BINS - 1} - {scaled('ln(-_x)', 'ln(-_hi)', 'ln(-_lo)')}"
    both = linear if first else "cast(signum(_x) as int)"
    return F.expr(f"""CASE WHEN isnan(_x) THEN {BINS + 1} WHEN _x = {MOST} THEN {BINS} WHEN _x = {LEAST} THEN -2
      WHEN _lo = _hi THEN 0
      WHEN _lo > 0 AND _hi / {RATIO} > _lo AND ln(_hi) > ln(_lo) THEN {up}
      WHEN _hi < 0 AND _lo / {RATIO} < _hi AND ln(-_lo) > ln(-_hi) THEN {down}
      WHEN _lo < 0 AND _hi > 0 THEN {both} ELSE {linear} END""")


def _same(left: DataFrame, right: DataFrame, keys) -> tuple[Column, DataFrame]:
    """Null-safe equality of ``keys``, those of ``right`` renamed."""
    for c in keys:
        right = right.withColumnRenamed(c, f"_of_{c}")
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return same, right


def extremes_of(value) -> list[Column]:
    """Aggregates ``_n, _lo, _hi``: number of values, and the smallest and largest finite one."""
    x = value.cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return [F.count(value).alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")]


def at_ranks(rows: DataFrame, by, wanted: DataFrame) -> DataFrame:
    """``(*by, _rank, _x)``: the value at each rank, counted from 0.

    ``rows`` is ``(*by, _x)`` without nulls, and is read once per round; ``wanted`` is
    ``(*by, _rank, _lo, _hi)`` and may be any number of rows.
    """
    state = wanted.withColumn("_below", F.lit(0).cast("long"))
    settled, first = None, True
    while True:
        brackets = state.select(*by, "_lo", "_hi", "_below").distinct()
        same, right = _same(rows, brackets, by)
        if not first:
            same = same & F.col("_x").between(F.col("_lo"), F.col("_hi"))
        met = rows.join(right, same)
        place = [*by, "_lo", "_hi", "_below"]
        bins = met.withColumn("_bin", _bin(first)).groupBy(*place, "_bin").agg(
            F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_least"), F.max("_x").alias("_most")
        )
        # At most BINS and four rows per bracket.
        upto = F.sum("_c").over(
            Window.partitionBy(*place).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        bins = bins.withColumn("_upto", F.col("_below") + upto)
        same, right = _same(state, bins, place)
        holds = (F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_c"))
        state = resume.cut_lineage(
            state.join(right, same & holds).select(
                *by, "_rank", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"),
                (F.col("_upto") - F.col("_c")).alias("_below"), "_c",
            )
        )
        done = state.filter("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_x"))
        settled = done if settled is None else settled.union(done)
        few = state.filter(f"_lo < _hi AND _c <= {HELD}")
        settled = settled.union(_sorted(rows, by, few))
        state, first = state.filter(f"_lo < _hi AND _c > {HELD}").drop("_c"), False
        if state.isEmpty():
            return settled


def _sorted(rows: DataFrame, by, few: DataFrame) -> DataFrame:
    """The values at the ranks of brackets that hold few rows."""
    place = [*by, "_lo", "_hi", "_below"]
    same, right = _same(rows, few.select(*place).distinct(), by)
    met = rows.join(right, same & F.col("_x").between(F.col("_lo"), F.col("_hi")))
    held = met.groupBy(*place).agg(F.sort_array(F.collect_list("_x")).alias("_all"))
    same, right = _same(few, held, place)
    at = F.get("_all", (F.col("_rank") - F.col("_below")).cast("int"))
    return few.join(right, same).select(*by, "_rank", at.alias("_x"))


def quantiles(
    long: DataFrame, by, points: dict, value: str = "value", extremes: DataFrame | None = None
) -> DataFrame:
    """``(*by, *points)``: exact quantiles by linear interpolation between neighbouring ranks.

    Nulls are left out; a group without a value has no row. ``long`` is read once per round, so write
    an expensive one first. ``extremes`` has its :func:`extremes_of` by group, if known.
    """
    by = [by] if isinstance(by, str) else list(by)
    rows = long.select(*by, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    known = resume.cut_lineage(rows.groupBy(*by).agg(*extremes_of(F.col("_x")))) if extremes is None else extremes
    known = known.filter("_n > 0")

    def place(q):
        return (F.col("_n") - 1) * F.lit(float(q))

    ranks = F.array_distinct(F.array(*[f(place(q)).cast("long") for q in points.values() for f in (F.floor, F.ceil)]))
    wanted = known.select(*by, "_lo", "_hi", F.explode(ranks).alias("_rank"))
    found = at_ranks(rows, by, wanted)
    same, right = _same(found, known.select(*by, "_n"), by)

    def at(rank):
        return F.max(F.when(F.col("_rank") == rank, F.col("_x")))

    got = found.join(right, same).groupBy(*by).agg(
        F.max("_n").alias("_n"),
        *[at(F.floor(place(q))).alias(f"_lo_{n}") for n, q in points.items()],
        *[at(F.ceil(place(q))).alias(f"_hi_{n}") for n, q in points.items()],
    )

    def between(name, q):
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        inside = lo + (hi - lo) * (place(q) - F.floor(place(q)))
        return F.when(lo == hi, lo).otherwise(inside).alias(name)

    return got.select(*by, *[between(n, q) for n, q in points.items()])
