"""All pairs of vectors whose cosine reaches a threshold, exactly.

On unit vectors a cosine of ``t`` is a distance of ``r = sqrt(2 - 2 t)``, so the triangle inequality
holds. Some vectors serve as pivots; every vector lives in the cell of its nearest pivot, and cells
are dealt into blocks of bounded size. A vector meets the blocks of another cell only if it may have
a partner there: with ``p`` its own pivot and ``q`` the other, a partner lies no further from ``q`` than
from ``p``, so ``d(x, q) - d(x, p) <= 2 r``, and within the cell's radius, so ``d(x, q) <= radius + r``. Two
blocks that meet are one task: rows sorted by their distance to the second block's pivot are
compared only where these distances differ by ``r`` at most, by matrix products of some rows.

The pairs of blocks grow with the square of the vocabulary where its vectors are spread evenly, as any
exact join of such vectors does, and cells that lie apart never meet. The driver holds the pivots and
one row per cell.

Vectors that are null, empty, zero, or hold a null or a number that is not finite have no direction
and are similar to nothing; so are those of another length than most pivots have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.streaming.resume import cut_lineage

BLOCK = 2048
PIVOTS = 64
STRIP = 256
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _lists(m: np.ndarray) -> pa.Array:
    ends = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if m.ndim == 2 else 0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))


def _homes(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Unit vectors with their cell and the distance to its pivot."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column(1))
        norm = np.sqrt((x * x).sum(axis=1))
        x = x[norm > 0] / norm[norm > 0, None]
        d = _distances(x, pivots)
        home = d.argmin(axis=1)
        yield pa.RecordBatch.from_pydict({
            "key": batch.column(0).filter(pa.array(norm > 0)), "home": pa.array(home.astype(np.int32)),
            "dist": pa.array(d[np.arange(len(x)), home]), "x": _lists(x),
        })


def _meetings(batches: Iterator[pa.RecordBatch], pivots, radius, first_block, blocks, r) -> Iterator[pa.RecordBatch]:
    """A copy of each vector for every pair of blocks in which it may have a partner."""
    total = int(blocks.sum())
    cell_of = np.repeat(np.arange(len(blocks)), blocks)
    for batch in batches:
        x = _matrix(batch.column(3))
        if not len(x):
            continue
        home = batch.column(1).to_numpy()
        own = first_block[home] + batch.column(4).to_numpy() % blocks[home]
        d = _distances(x, pivots)
        near = (d - d[np.arange(len(x)), home][:, None] <= 2 * r + SLACK) & (d <= radius[None, :] + r + SLACK)
        near[np.arange(len(x)), home] = True
        row, other = np.nonzero(near[:, cell_of]) if total else (np.zeros(0, int), np.zeros(0, int))
        u, v = np.minimum(own[row], other), np.maximum(own[row], other)
        for a in range(0, len(row), 65536):
            at = pa.array(row[a : a + 65536])
            yield pa.RecordBatch.from_pydict({
                "u": pa.array(u[a : a + 65536]), "v": pa.array(v[a : a + 65536]), "own": pa.array(own[row[a : a + 65536]]),
                "key": batch.column(0).take(at), "x": batch.column(3).take(at),
            })


def _compare(table: pa.Table, pivots: np.ndarray, cell_of: np.ndarray, threshold: float, r: float) -> pa.Table:
    """Close pairs of two blocks, or inside one."""
    u, v = table.column("u")[0].as_py(), table.column("v")[0].as_py()
    own = table.column("own").to_numpy()
    keys, x = table.column("key").combine_chunks(), _matrix(table.column("x"))
    pivot = pivots[cell_of[v]][None, :]
    left, right = np.flatnonzero(own == u), np.flatnonzero(own == v)
    d_left, d_right = _distances(x[left], pivot)[:, 0], _distances(x[right], pivot)[:, 0]
    left, d_left = left[np.argsort(d_left, kind="stable")], np.sort(d_left)
    right, d_right = right[np.argsort(d_right, kind="stable")], np.sort(d_right)
    a, b, close = [], [], []
    for k in range(0, len(left), STRIP):
        some = left[k : k + STRIP]
        low = np.searchsorted(d_right, d_left[k] - r - SLACK)
        high = np.searchsorted(d_right, d_left[min(k + STRIP, len(left)) - 1] + r + SLACK, "right")
        cosine = x[some] @ x[right[low:high]].T
        p, q = np.nonzero(cosine >= threshold)
        i, j, c = some[p], right[low:high][q], cosine[p, q]
        if u == v:  # each pair once, no vector with itself
            i, j, c = i[i < j], j[i < j], c[i < j]
        a.append(i)
        b.append(j)
        close.append(c)
    none = np.zeros(0, np.int64)
    return pa.table({
        "a": keys.take(pa.array(np.concatenate([none, *a]))), "b": keys.take(pa.array(np.concatenate([none, *b]))),
        "similarity": pa.array(np.concatenate([np.zeros(0), *close])),
    })


def similar_pairs(
    vectors: DataFrame, threshold: float, key="key", vector="embedding", block: int = BLOCK, pivots: int = PIVOTS
) -> DataFrame:
    """``(a, b, similarity)``: each pair of keys once whose vectors have a cosine of ``threshold`` or
    more, which is above 0. ``key`` is unique."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0")
    x = F.col(vector).cast("array<double>")
    ok = F.forall(x, lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")))
    rows = vectors.select(F.col(key).alias("key"), x.alias("x")).filter(
        F.col(vector).isNotNull() & (F.size(vector) > 0) & ok & F.exists(x, lambda n: n != 0)
    )
    kind = rows.schema["key"].dataType.simpleString()
    none = vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, similarity double")
    number = rows.count()
    chosen = rows.orderBy(F.xxhash64("key"), "key").limit(pivots).collect()
    if not chosen:
        return none
    width = Counter(len(p.x) for p in chosen).most_common(1)[0][0]
    # As many pivots as blocks, within a bound.
    points = np.array([p.x for p in chosen if len(p.x) == width][: max(1, -(-number // block))], float)
    points /= np.sqrt((points * points).sum(axis=1, keepdims=True))
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    homes = cut_lineage(
        rows.filter(F.size("x") == width)
        .mapInArrow(lambda b: _homes(b, points), f"key {kind}, home int, dist double, x array<double>")
    )
    radius, blocks = np.zeros(len(points)), np.zeros(len(points), np.int64)
    for cell in homes.groupBy("home").agg(F.max("dist").alias("far"), F.count("*").alias("n")).collect():
        radius[cell.home], blocks[cell.home] = cell.far, -(-cell.n // block)
    first_block = np.cumsum(blocks) - blocks
    cell_of = np.repeat(np.arange(len(blocks)), blocks)
    met = homes.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(1 << 31))).mapInArrow(
        lambda b: _meetings(b, points, radius, first_block, blocks, r),
        f"u bigint, v bigint, own bigint, key {kind}, x array<double>",
    )
    return met.groupBy("u", "v").applyInArrow(
        lambda t: _compare(t, points, cell_of, threshold, r), none.schema.simpleString()[7:-1].replace(":", " ")
    )
