"""Operator 12, compression of vectors to short codes.

Components become integers, vectors are cut into equal parts, and each part position has a
codebook of a few entries, refined over a fixed number of rounds of nearest-entry means.

The nearest entry is found by equal-average search. Entries are sorted by the sum of their
components. A part starts at the place of its own sum and goes outward, always to the side whose
sum is nearer. As ``(sum(x) - sum(y))^2 <= d * |x - y|^2``, no entry further out can be as near as
the best so far once the squared gap over the dimension strictly exceeds that best distance; ties
are therefore always looked at, and the lower index wins.

Each round is one pass over the table: a task adds up the parts of its rows by entry, and only those
sums are shuffled. The driver holds the codebooks (parts x entries x components of a part), whatever
the number of rows.

Defined results: rows whose vector is null, empty, or holds a null or a non-finite component are
dropped, and so are vectors whose length differs from that of the first kept vector, by id; that
length must be a multiple of the number of parts. Repeated rows count as often as they occur; the
first codebooks take the smallest ``(id, vector)``, null ids last. With fewer rows than entries the
codebooks are that much smaller. A null label is a label of its own. An empty table gives no rows.
Columns other than id, vector and label are not read. Components of 16,384 or more in size raise, as
sums of their squares would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import folder

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LIMIT = 1 << 26
SALTS = 32


def kept(table: DataFrame, vector="embedding") -> DataFrame:
    """Rows with a vector of finite numbers."""
    x = F.col(vector)
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return table.filter(x.isNotNull() & (F.size(x) > 0) & ok)


def _integers(column: pa.Array, scale: int) -> np.ndarray:
    """Vectors of equal length as rows of integers."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    x = np.floor(x * scale)
    if np.abs(x).max(initial=0) >= LIMIT:
        raise ValueError(f"a component of {LIMIT / scale} or more in size")
    return x.astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` for each row of ``x``, and the squared distance."""
    n, d = x.shape
    sums = book.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    means = sums[order]
    own = x.sum(axis=1)
    best = np.full(n, np.iinfo(np.int64).max)
    found = np.full(n, len(book))
    # Next places to look at, on the right and on the left of the row's own sum.
    right = np.searchsorted(means, own)
    left = right - 1
    rows = np.arange(n)
    far = np.int64(np.iinfo(np.int64).max)
    while len(rows):
        r, l, s = right[rows], left[rows], own[rows]
        up = np.where(r < len(book), means[np.minimum(r, len(book) - 1)] - s, far)
        down = np.where(l >= 0, s - means[np.maximum(l, 0)], far)
        gap = np.minimum(up, down)
        # gap^2 / d > best, in integers.
        on = gap < far
        on[on] = -(-gap[on] * gap[on] // d) <= best[rows[on]]
        rows, up, down, r, l = rows[on], up[on], down[on], r[on], l[on]
        if not len(rows):
            break
        at = np.where(up <= down, r, l)
        right[rows] += up <= down
        left[rows] -= up > down
        entry = order[at]
        step = x[rows] - book[entry]
        distance = np.einsum("ij,ij->i", step, step)
        better = (distance < best[rows]) | ((distance == best[rows]) & (entry < found[rows]))
        best[rows[better]] = distance[better]
        found[rows[better]] = entry[better]
    return found, best


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    """Sums of parts by position and entry: one row each for a whole task."""
    parts, entries, d = books.shape
    total = np.zeros((parts, entries, d), np.int64)
    count = np.zeros((parts, entries), np.int64)
    for batch in batches:
        x = _integers(batch.column(0), scale)
        for p in range(parts if len(x) else 0):
            part = x[:, p * d : (p + 1) * d]
            found, _ = nearest(part, books[p])
            count[p] += np.bincount(found, minlength=entries)
            np.add.at(total[p], found, part)
    p, k = np.nonzero(count)
    if len(p):
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(p, pa.int32()), "entry": pa.array(k, pa.int32()), "n": pa.array(count[p, k]),
            "sums": pa.ListArray.from_arrays(
                pa.array(np.arange(len(p) + 1) * d, pa.int32()), pa.array(total[p, k].ravel())
            ),
        })


def learn(
    table: DataFrame, id="vec_id", vector="embedding", parts: int = PARTS, entries: int = ENTRIES,
    rounds: int = ROUNDS, scale: int = SCALE,
) -> np.ndarray | None:
    """Codebooks as an array ``(parts, entries, components of a part)``; ``None`` without rows."""
    rows = kept(table, vector).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("x"))
    first = rows.orderBy(F.col("id").isNull(), "id", "x").limit(entries).collect()
    if not first:
        return None
    width = len(first[0].x)
    if width % parts:
        raise ValueError(f"vectors of {width} components have no {parts} equal parts")
    rows = rows.filter(F.size("x") == width)
    if any(len(r.x) != width for r in first):
        first = rows.orderBy(F.col("id").isNull(), "id", "x").limit(entries).collect()
    start = _integers(pa.array([r.x for r in first], pa.list_(pa.float64())), scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, width // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        task = rows.select("x").mapInArrow(
            lambda b, books=books: _sums(b, books, scale), "part int, entry int, n bigint, sums array<bigint>"
        )
        d = width // parts
        merged = task.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(d)]
        )
        books = books.copy()
        for r in merged.collect():  # at most parts x entries rows
            books[r.part, r.entry] = [r[f"s{k}"] // r.n for k in range(d)]
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _encode(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    parts, _, d = books.shape
    hexes = np.array([b"%02x" % k for k in range(256)])
    for batch in batches:
        x = _integers(batch.column(batch.num_columns - 1), scale)
        if not len(x):
            continue
        error = np.zeros(len(x), np.int64)
        code = np.zeros((len(x), parts), np.uint8)
        for p in range(parts):
            code[:, p], distance = nearest(x[:, p * d : (p + 1) * d], books[p])
            error += distance
        text = hexes[code].reshape(len(x), parts).view(f"S{2 * parts}").ravel().astype(str)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(text, pa.string()), pa.array(error)],
            names=[*batch.schema.names[:-1], "code", "error"],
        )


def encode(
    table: DataFrame, books: np.ndarray | None, id="vec_id", vector="embedding", keep=(), scale: int = SCALE
) -> DataFrame:
    """``(id, *keep, code, error)`` of each kept row: entry numbers in order of the parts, two hex
    digits each, and the sum of squared distances. Nothing is shuffled."""
    if books is not None and books.shape[1] > 256:
        raise ValueError("a code of two hex digits has at most 256 entries")
    rows = kept(table, vector)
    names = [f"_{k}" for k in range(1 + len(keep))]
    rows = rows.select(
        *[F.col(c).alias(n) for c, n in zip([id, *keep], names)], F.col(vector).cast("array<double>").alias("x")
    )
    if books is None:
        rows = rows.limit(0)
    else:
        rows = rows.filter(F.size("x") == books.shape[0] * books.shape[2])
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    out = rows.mapInArrow(lambda b: _encode(b, books, scale), ", ".join([*kinds, "code string", "error bigint"]))
    return out.select(*[F.col(n).alias(c) for c, n in zip([id, *keep], names)], "code", "error")


def with_label_errors(coded: DataFrame, label="label", id="vec_id") -> DataFrame:
    """Adds ``label_error``: the error summed over equal labels, nulls together.

    A label may hold most of the rows: sums are partial before the shuffle, and rows meet them
    by label and salt.
    """
    coded = folder.written(coded, "codes")
    totals = coded.groupBy(label).agg(F.sum("error").alias("label_error"))
    totals = totals.select(
        F.col(label).alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_to")
    )
    rows = coded.withColumn("_salt", F.pmod(F.xxhash64(id, "code"), F.lit(SALTS)).cast("int"))
    met = rows.join(totals, F.col(label).eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_to")))
    return met.drop("_salt", "_to", "_label")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` as codes."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = learn(table)
    coded = with_label_errors(encode(table, books, keep=["label"]))
    sha = digest(books) if books is not None else ""
    return coded.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment of all parts to the books of round ``k``, and the books of round ``k + 1``."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT id, p, arg_min(e, dist * {ENTRIES} + e) AS e, min(dist) AS dist FROM (
    SELECT x.id, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS dist
    FROM parts x JOIN b{k} b ON x.p = b.p) GROUP BY id, p),
m{k} AS (
  SELECT p, e, list(m ORDER BY i) AS v FROM (
    SELECT a.p, a.e, i, (sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM a{k} a JOIN comps c ON a.id = c.id AND a.p = c.p GROUP BY a.p, a.e, i) GROUP BY p, e),
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, CASE WHEN m.v IS NULL THEN b.v ELSE list_transform(m.v, lambda t: CAST(t AS BIGINT)) END AS v
  FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)"""


OP12_SQL = f"""
WITH good AS (
  SELECT vec_id AS id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
comps AS MATERIALIZED (
  SELECT id, i, i // (n // {PARTS}) AS p, CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT) AS c FROM (
    SELECT id, len(embedding) AS n, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM good)),
parts AS MATERIALIZED (SELECT id, p, list(c ORDER BY i) AS v FROM comps GROUP BY id, p),
firsts AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM good ORDER BY id LIMIT {ENTRIES}),
b0 AS MATERIALIZED (SELECT x.p, f.e, x.v FROM parts x JOIN firsts f ON x.id = f.id),
{reduce(lambda s, k: s + "," + _round(k), range(1, ROUNDS + 1), _round(0))},
sha AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS h FROM (
  SELECT p, e, array_to_string(v, ',') AS t FROM b{ROUNDS})),
coded AS (
  SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY id)
SELECT c.id AS vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY g.label) AS BIGINT) AS label_error,
  sha.h AS codebooks_sha256
FROM coded c JOIN good g ON c.id = g.id, sha"""
