"""Quantiles by selection equal those of sorted values."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.operators import selection, stats

POINTS = {"least": 0.0, "q1": 0.25, "median": 0.5, "q9": 0.9, "most": 1.0}


def plain(values, q):
    """Linear interpolation of sorted values; NaN is above all."""
    x = sorted(values, key=lambda v: (math.isnan(v), v))
    at = (len(x) - 1) * q
    lo, hi = x[math.floor(at)], x[math.ceil(at)]
    return lo if lo == hi else lo + (hi - lo) * (at - math.floor(at))


def same(a, b):
    return (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-12 * max(abs(a), abs(b))


def check(spark, groups):
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: r for r in selection.quantiles(df, "g", POINTS).collect()}
    known = {g: [v for v in vs if v is not None] for g, vs in groups.items()}
    assert set(got) == {g for g, vs in known.items() if vs}
    for g, vs in known.items():
        for name, q in POINTS.items():
            assert not vs or same(got[g][name], plain(vs, q)), (g, name, got[g][name], plain(vs, q))


@pytest.mark.parametrize("held", [0, 60, selection.HELD])
def test_equals_sorted_values(spark, monkeypatch, held):
    monkeypatch.setattr(selection, "HELD", held)
    rng = np.random.default_rng(2)
    inf, nan = math.inf, math.nan
    check(spark, {
        "normal": rng.normal(size=3000).tolist(), "few": [1.0, 2.0, 2.0, 3.0] * 50, "one": [5.0], None: [7.0, 8.0],
        "heavy": [float(v) for v in 10.0 ** rng.uniform(-300, 300, 500)] + [-float(v) for v in 10.0 ** rng.uniform(-300, 300, 500)],
        "small": [float(v) for v in 10.0 ** rng.uniform(-12, 12, 700)], "below": [-float(v) for v in 10.0 ** rng.uniform(-12, 12, 700)],
        "odd": [inf, -inf, nan, 0.0, 1.0, None], "only odd": [nan, inf, inf, -inf], "nulls": [None, None],
        "close": [1.0 + k * 2.0**-52 for k in range(50)], "tiny": [5e-324, 0.0, -5e-324, 1e308, -1e308], "zero": [-0.0, 0.0],
        "hot": [3.0] * 2000 + rng.normal(3, 1e-9, 500).tolist(),
    })
    check(spark, {})


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False) | st.sampled_from([0.0, 1.0]), min_size=1, max_size=30))
def test_any_values(spark, values):
    check(spark, {"a": values})


def test_a_round_hands_on_bins_not_values(spark):
    df = spark.range(20000).selectExpr("'a' AS g", "cast(id * 37 % 20000 AS double) / 7 AS _x")
    wanted = spark.createDataFrame([("a", 9999, 0.0, 19999 / 7)], "g string, _rank long, _lo double, _hi double")
    (r,) = selection.at_ranks(df, ["g"], wanted).collect()
    assert r._x == 9999 / 7


def test_box_and_description(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.choice([1, 2, 3, 50])), rng.gauss(0, 1)) for g in "ab" for _ in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    box = {(r.g, r.feature): r for r in stats.box_summary(df, "g", ["x", "y"]).collect()}
    desc = {(r.g, r.feature): r for r in stats.describe_by(df, "g", ["x", "y"]).collect()}
    for g in "ab":
        for k, c in enumerate("xy", 1):
            v = [r[k] for r in rows if r[0] == g]
            b, q1, q3 = box[g, c], plain(v, 0.25), plain(v, 0.75)
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            assert same(b.q1, q1) and same(b.q3, q3) and same(desc[g, c].median, plain(v, 0.5))
            assert b.outliers == sum(not lo <= x <= hi for x in v)
            assert b.whisker_low == min(x for x in v if x >= lo) and b.whisker_high == max(x for x in v if x <= hi)
