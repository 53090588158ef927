import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """Plain loops over all entries; ``rows`` of ``(id, vector, label)``."""
    good = [r for r in rows if r[1] and all(v is not None and math.isfinite(v) for v in r[1])]
    x = [[math.floor(4096 * float(np.float32(v))) for v in r[1]] for r in good]
    if not good:
        return [], ""
    d = len(x[0]) // parts
    cut = [[v[p * d : (p + 1) * d] for p in range(parts)] for v in x]
    first = sorted(range(len(good)), key=lambda k: (good[k][0], x[k]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def assign():
        return [
            [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
            for c in cut
        ]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, f in zip(cut, found) if f[p][1] == k]
                if own:
                    books[p][k] = [sum(v) // len(own) for v in zip(*own)]
    found = assign()
    error = [sum(d for d, _ in f) for f in found]
    labels = {}
    for r, e in zip(good, error):
        labels[r[2]] = labels.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return sorted(
        (r[0], "".join(f"{k:02x}" for _, k in f), e, labels[r[2]], sha) for r, f, e in zip(good, found, error)
    ), sha


def run(spark, df):
    books = codes.learn(df)
    out = codes.with_label_errors(codes.encode(df, books, keep=["label"]))
    sha = codes.digest(books) if books is not None else ""
    return sorted((r.vec_id, r.code, r.error, r.label_error, sha) for r in out.collect())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 5), st.integers(1, 9), st.lists(st.integers(-6, 6), min_size=60, max_size=60))
def test_search_equals_brute_force(d, entries, values):
    v = np.array(values, np.int64)
    book = np.resize(v, (entries, d))
    x = np.resize(v[::-1], (12, d))
    found, best = codes.nearest(x, book)
    for row, k, distance in zip(x, found, best):
        assert (distance, k) == min((int(((row - b) ** 2).sum()), i) for i, b in enumerate(book))


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.normal(0, 1, 16).round(2)], int(i) % 3 if i % 5 else None) for i in range(70, 10, -1)]
    rows += [(7, None, 1), (8, [1.0] * 15 + [None], 1), (9, [float("nan")] * 16, 0), (5, [float("inf")] + [0.0] * 15, 0)]
    got = run(spark, spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows)[0] and len(got) == 60


def test_repeated_rows_ties_and_clashing_columns(spark, clashing):
    rows = [(i % 4, [float(i % 2)] * 8, None) for i in range(40)]
    df = clashing(spark.createDataFrame(rows, SCHEMA))
    assert run(spark, df) == brute(rows)[0]


def test_few_empty_and_odd_rows(spark):
    few = [(3, [-0.5, 0.25] * 4, 1), (4, [0.5] * 8, 1)]
    assert run(spark, spark.createDataFrame(few, SCHEMA)) == brute(few)[0]
    odd = [*few, (9, [1.0] * 16, 1), (10, [], 1)]
    assert run(spark, spark.createDataFrame(odd, SCHEMA)) == brute(few)[0]
    for rows in ([], [(1, None, 1)]):
        assert run(spark, spark.createDataFrame(rows, SCHEMA)) == []
    with pytest.raises(ValueError):
        codes.learn(spark.createDataFrame([(1, [1.0] * 7, 1)], SCHEMA))


def test_a_null_id_comes_last(spark):
    rows = [(None, [float(k)] * 8, 1) for k in range(3)] + [(k, [float(-k)] * 8, 1) for k in range(16)]
    books = codes.learn(spark.createDataFrame(rows, SCHEMA), rounds=0)
    assert books[0, :, 0].tolist() == [-4096 * k for k in range(16)]
