"""Operator 7, quality rules by robust multivariate outliers.

Statistics of a text are transformed to a vector of five: log words, log characters a word,
and the square roots of symbols a character, repeated lines a line and repeated words a word.
Per language and source the minimum covariance determinant (MCD) estimate of centre and
scatter is made, and a document is rejected by its Mahalanobis distance from it.

The estimate follows the nested scheme for large samples: a group is dealt by hash into
blocks of a few thousand rows; in each block concentration steps run to their end from two
fixed starts; the half-samples of all blocks of a group are pooled, and further concentration
steps run over all rows of the group, as aggregates. No task sees more of a group than a
block. The quantile of a step is read off a histogram of log distances, not off a sample.

A scatter matrix gets a floor on its diagonal, as most texts have no symbols or repeated lines
at all. Groups of fewer than ``LEAST`` rows of a language are estimated together; where even
these are too few, the base rule alone decides.

Defined results: a null or empty text has zero statistics and fails the base rule; null
languages and sources are groups of their own; repeated rows count as often as they occur; an
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.llm import arrow, folder

P = 5
# Spread that each entry of a vector has at least. The last two are bounded, by 1 and (after the
# base rule) the root of 0.5, and have to reach the cut, 5.6 spreads, well below that.
FLOOR = np.array([0.3, 0.08, 0.05, 0.1, 0.075])
SHARE = 0.75
BLOCK = 4096
LEAST = 50
STEPS = 3
BINS = 32
SURE = 0.99999
VECTOR = [f"x{k}" for k in range(P)]
NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONTINUED = np.zeros(256, bool)
_CONTINUED[0x80:0xC0] = True


def _per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs again anywhere, and whether it occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    again, earlier = np.empty(len(keys), bool), np.empty(len(keys), bool)
    again[order] = same[1:] | same[:-1]
    earlier[order] = same[:-1]
    return again, earlier


def row_statistics(w: arrow.Words) -> dict[str, np.ndarray]:
    """The base statistics of each row of a slice."""
    bounds, rows = w.bounds, w.rows.astype(np.uint64)
    inside = ~arrow.SPACE[w.data] & ~_CONTINUED[w.data]
    out = {
        "n_words": np.diff(bounds), "word_chars": _per_row(inside, w.offsets),
        "n_symbols": _per_row(_SYMBOL[w.data], w.offsets),
    }
    # Lines: from a row's start or a line feed to the next line feed or the row's end.
    feeds = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1], feeds + 1]))
    starts = starts[starts < len(w.data)]
    ends = np.concatenate([starts[1:], [len(w.data)]])[: len(starts)]
    ends = ends - (w.data[ends - 1] == 10)
    worded = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends = starts[worded], ends[worded]
    line_bounds = np.searchsorted(starts, w.offsets)
    line_rows = np.repeat(np.arange(len(w.offsets) - 1, dtype=np.uint64), np.diff(line_bounds))
    lines = arrow.hash_spans(w.data, starts, ends, fold=False)
    out["n_lines"] = np.diff(line_bounds)
    out["n_dup_lines"] = _per_row(_repeats(arrow.mix(lines + arrow.mix(line_rows)))[1], line_bounds)
    # Words in three-word windows that occur again in their row.
    covered = np.zeros(len(rows) + 2, bool)
    if len(rows) > 2:
        h = w.hashes
        window = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + arrow.mix(h[1:-1] + np.uint64(1)) + arrow.mix(h[2:] * np.uint64(3))
        whole = rows[:-2] == rows[2:]
        again = np.zeros(len(whole), bool)
        again[whole] = _repeats(arrow.mix(window[whole] + arrow.mix(rows[:-2][whole])))[0]
        for k in range(3):
            covered[k : k + len(again)] |= again
    out["n_repeat_words"] = _per_row(covered[: len(rows)], bounds)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in arrow.words(batch.column(1), fold=False):
            stats = row_statistics(w)
            part = batch.slice(w.first, w.last - w.first)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), part.column(3), *[pa.array(stats[x], pa.int64()) for x in NAMES]],
                ["id", "lang", "source", *NAMES],
            )


def statistics(docs: DataFrame, id="doc_id", text="text", lang="lang", source="source") -> DataFrame:
    """``id, lang, source`` and the base statistics of every row, ``base_failed`` included."""
    rows = docs.select(
        F.col(id).alias("id"), F.col(text).cast("string").alias("text"),
        F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{x} bigint" for x in NAMES)
    out = rows.mapInArrow(_count, f"id {kind}, lang string, source string, {counts}")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.col(whole), F.lit(1))))

    mean = F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1))
    parts = [
        F.log1p("n_words"), mean, share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
    ]
    return dict(zip(VECTOR, parts, strict=True))


def chi_square(x: float, degrees: int) -> float:
    """P(X <= x) of a chi-square variable, by the series of the incomplete gamma function."""
    a, z = degrees / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    for k in range(1, 2000):
        term *= z / (a + k)
        total += term
        if term < total * 1e-16:
            break
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi_square_point(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return low


# The scatter of the closest SHARE of normal rows is smaller than that of all by this factor.
CONSISTENT = SHARE / chi_square(chi_square_point(SHARE, P), P + 2)


def _scatter(n: float, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre, and scatter with its factor and floor."""
    center = total / n
    return center, (squares / n - np.outer(center, center)) * CONSISTENT + np.diag(FLOOR**2)


def concentrate(x: np.ndarray) -> np.ndarray:
    """The rows of a block that two fixed starts and concentration steps agree on best."""
    h = max(1, math.ceil(SHARE * len(x)))
    middle = np.median(x, 0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - middle), 0), FLOOR)
    z = (x - middle) / spread
    length = np.sqrt((z**2).sum(1))
    signs = z / np.maximum(length, 1e-9)[:, None]  # spatial signs bound the pull of far rows
    lean = np.cov(signs.T, bias=True).reshape(P, P) * P + np.eye(P) * 1e-3
    starts = [length, np.einsum("ij,jk,ik->i", z, np.linalg.inv(lean), z)]
    best, chosen = math.inf, None
    for distance in starts:
        rows = np.argsort(distance, kind="stable")[:h]
        for _ in range(50):
            y = x[rows]
            center, cov = _scatter(len(y), y.sum(0), y.T @ y)
            d = np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov), x - center)
            again = np.sort(np.argsort(d, kind="stable")[:h])
            if np.array_equal(again, np.sort(rows)):
                break
            rows = again
        size = np.linalg.slogdet(cov)[1]
        if size < best:
            best, chosen = size, rows
    return chosen


_MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i in range(P) for j in range(i, P)]]


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf[VECTOR].to_numpy()
    y = x[concentrate(x)]
    row = [len(y), *y.sum(0), *[(y[:, i] * y[:, j]).sum() for i in range(P) for j in range(i, P)]]
    return pd.DataFrame([[pdf["group"].iloc[0], *row]], columns=["group", *_MOMENTS])


def _estimates(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Moments of a group to its centre and inverse scatter."""
    for pdf in parts:
        rows = []
        for r in pdf.to_dict("records"):
            squares = np.array([[r[f"q{min(i, j)}{max(i, j)}"] for j in range(P)] for i in range(P)])
            center, cov = _scatter(r["n"], np.array([r[f"s{i}"] for i in range(P)]), squares)
            rows.append((r["group"], center.tolist(), np.linalg.inv(cov).reshape(-1).tolist()))
        yield pd.DataFrame(rows, columns=["group", "center", "inverse"])


def _from_moments(moments: DataFrame) -> DataFrame:
    return moments.mapInPandas(_estimates, "group string, center array<double>, inverse array<double>")


def _distance() -> Column:
    gap = [F.col(v) - F.col("center")[k] for k, v in enumerate(VECTOR)]
    return sum(
        (gap[i] * gap[j] * F.col("inverse")[i * P + j] for i in range(P) for j in range(P)), F.lit(0.0)
    )


def _step(vectors: DataFrame, estimate: DataFrame) -> DataFrame:
    """One concentration step over all rows of every group."""
    rows = vectors.join(estimate, "group").withColumn("distance", _distance())
    rows = rows.withColumn("bin", F.floor(BINS * F.log2(F.col("distance") + 1e-9)))
    bins = rows.groupBy("group", "bin").count()
    # Bins of a group are few, whatever its rows: the edge is found in one array of them.
    pairs = bins.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("bin", "count"))).alias("bins"))
    edge = F.expr(f"""aggregate(bins, named_struct('left', cast(ceil({SHARE}D * aggregate(bins, 0L, (a, b) -> a + b.count)) as bigint),
        'bin', cast(null as bigint)), (a, b) -> if(a.left > 0, named_struct('left', a.left - b.count, 'bin', b.bin), a)).bin""")
    near = rows.join(pairs.select("group", edge.alias("edge")), "group").filter("bin <= edge")
    sums = [F.count("*").cast("double").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i, P)]
    return _from_moments(near.groupBy("group").agg(*sums))


def judge(stats: DataFrame, steps: int = STEPS, sure: float = SURE) -> DataFrame:
    """``stats`` with ``distance`` (squared, null where not estimated) and ``kept``."""
    stats = folder.written(stats.withColumns(_vector()), "statistics")
    good = stats.filter("not base_failed")
    # A group's name keeps null apart from any string.
    name = F.to_json(F.struct("lang", "source"))
    rest = F.to_json(F.struct("lang"))
    sizes = good.groupBy(name.alias("name")).agg(F.count("*").alias("size"))
    rows = stats.withColumn("name", name).join(sizes, "name", "left")
    rows = rows.withColumn("group", F.when(F.col("size") >= LEAST, F.col("name")).otherwise(rest)).drop("name", "size")
    rows = folder.written(rows, "grouped")
    vectors = rows.filter("not base_failed").select("group", "id", *VECTOR)
    counts = vectors.groupBy("group").agg(F.count("*").alias("size")).filter(F.col("size") >= LEAST)
    blocks = F.pmod(F.xxhash64("id", *VECTOR), F.ceil(F.col("size") / BLOCK))
    dealt = vectors.join(counts, "group").withColumn("block", blocks).select("group", "block", *VECTOR)
    fields = ", ".join(f"{m} double" for m in _MOMENTS)
    parts = dealt.groupBy("group", "block").applyInPandas(_block, f"group string, {fields}")
    pooled = parts.groupBy("group").agg(*[F.sum(m).alias(m) for m in _MOMENTS])
    estimate = folder.written(_from_moments(pooled), "estimate")
    for _ in range(steps):
        estimate = folder.written(_step(vectors, estimate), "estimate")
    out = rows.join(estimate, "group", "left").withColumn("distance", _distance())
    near = F.coalesce(F.col("distance") <= chi_square_point(sure, P), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & near).drop("group", "center", "inverse", *VECTOR)


def op7_quality_outliers(spark, sf_dir: str) -> DataFrame:
    out = judge(statistics(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance",
    )
