"""Operator 4, benchmark decontamination by size-partitioned MinHash containment search.

A document contains a test item if it holds at least 75 of 100 of the item's distinct five-word
shingles. Items are partitioned by size in powers of two. A partition fixes how many of an
item's smallest minhashes are its sketch: one more than the shingles an item of that size may
miss. So a document that contains an item holds at least one hash of its sketch, however long
the document is: the search loses nothing, and long documents need no windows. Candidates are
verified with the full sets.

Documents are scanned once and never shuffled. Sketches and sets go to the tasks in blocks of
items of about ``BLOCK`` shingles; a larger benchmark takes several blocks, each scanning the
documents once more.

Defined results: a null or empty text, of a document or an item, has no shingles and is in no
pair; a text of fewer than five words has its whole sequence as one shingle, so it meets only
equal sequences; equal items each get their pairs, and repeated document rows too; a null id
is returned as null; empty tables give no pairs. Other columns are passed through by
``clean`` and not read elsewhere, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import arrow

WORDS = 5
THRESHOLD = (75, 100)
BLOCK = 1_000_000
FILTER_BITS = 22


def sketch_length(size: int, threshold: tuple[int, int] = THRESHOLD) -> int:
    """Hashes that the items of the partition of ``size`` keep."""
    part, whole = threshold
    upper = 1 << max(size - 1, 0).bit_length()
    return upper - -(-part * upper // whole) + 1


class Block:
    """Sketches and sets of some items, as arrays."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: tuple[int, int]):
        self.ids, self.sets, self.threshold = ids, sets, threshold
        hashes, items = [], []
        for k, s in enumerate(sets):
            order = np.argsort(arrow.mix(s + np.uint64(5)))  # the order of a hash function
            least = s[order[: sketch_length(len(s), threshold)]]
            hashes.append(least)
            items.append(np.full(len(least), k))
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes = flat[order]
        self.items = (np.concatenate(items) if items else np.zeros(0, np.int64))[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def find(self, w: arrow.Words, n: int) -> Iterator[tuple[int, int, int, int]]:
        """``(row, item, shared, shingles of the row)`` of a slice."""
        hashes, bounds = arrow.shingles(w, n)
        spot = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        a = np.searchsorted(self.hashes, hashes[spot], "left")
        b = np.searchsorted(self.hashes, hashes[spot], "right")
        spot, a, b = spot[b > a], a[b > a], b[b > a]
        item = self.items[arrow.ragged(a, b - a)]
        row = np.repeat(np.searchsorted(bounds, spot, "right") - 1, b - a)
        pairs = np.unique(np.stack([row, item], 1), axis=0) if len(row) else np.zeros((0, 2), np.int64)
        part, whole = self.threshold
        last, own = -1, None
        for r, k in pairs.tolist():
            if r != last:
                last, own = r, np.unique(hashes[bounds[r] : bounds[r + 1]])
            want = self.sets[k]
            if whole * len(own) >= part * len(want):
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                shared = int((own[at] == want).sum())
                if whole * shared >= part * len(want):
                    yield r, k, shared, len(own)


def _item_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in arrow.words(batch.column(1)):
            hashes, bounds = arrow.shingles(w, n)
            sets = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).slice(w.first, w.last - w.first),
                "size": pa.array([len(s) for s in sets], pa.int64()),
                "set": pa.array([s.tobytes() for s in sets], pa.binary()),
            })


def blocks(items: DataFrame, id="item_id", text="text", n: int = WORDS, threshold=THRESHOLD) -> Iterator[Block]:
    """The items, some at a time, so that the driver holds one block of bounded size."""
    rows = items.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    sets = rows.mapInArrow(lambda b: _item_sets(b, n), f"id {kind}, size bigint, set binary").filter("size > 0")
    total = sets.agg(F.sum("size")).first()[0] or 0
    number = -(-total // BLOCK)
    for k in range(number):
        some = sets.filter(F.pmod(F.xxhash64("id", "set"), F.lit(number)) == k).collect()
        yield Block([r.id for r in some], [np.frombuffer(r.set, np.uint64) for r in some], threshold)


def _pairs(batches: Iterator[pa.RecordBatch], block, n: int) -> Iterator[pa.RecordBatch]:
    block = block.value
    for batch in batches:
        for w in arrow.words(batch.column(1)):
            if found := list(block.find(w, n)):
                rows, items, shared, own = (list(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([w.first + r for r in rows])),
                        pa.array([block.ids[k] for k in items], block.kind), pa.array(shared, pa.int64()),
                        pa.array([len(block.sets[k]) for k in items], pa.int64()), pa.array(own, pa.int64()),
                    ],
                    ["id", "item", "n_shared", "n_item", "n_shingles"],
                )


def contained(
    docs: DataFrame, items: DataFrame, id="doc_id", text="text", item="item_id", item_text="text",
    n: int = WORDS, threshold: tuple[int, int] = THRESHOLD,
) -> DataFrame:
    """``(id, item, n_shared, n_item, n_shingles)`` of every document that contains an item."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    item_type = items.schema[item].dataType
    schema = (
        f"id {rows.schema['id'].dataType.simpleString()}, item {item_type.simpleString()}, "
        "n_shared bigint, n_item bigint, n_shingles bigint"
    )
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks(items, item, item_text, n, threshold):
        block.kind = to_arrow_type(item_type)
        sent = docs.sparkSession.sparkContext.broadcast(block)
        out = out.union(rows.mapInArrow(lambda b, sent=sent: _pairs(b, sent, n), schema))
    return out.withColumnsRenamed({"id": id, "item": item})


def _without(batches: Iterator[pa.RecordBatch], block, at: int, n: int) -> Iterator[pa.RecordBatch]:
    block = block.value
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for w in arrow.words(batch.column(at)):
            keep[[w.first + r for r, *_ in block.find(w, n)]] = False
        yield batch.filter(pa.array(keep))


def clean(
    docs: DataFrame, items: DataFrame, text="text", item="item_id", item_text="text",
    n: int = WORDS, threshold: tuple[int, int] = THRESHOLD,
) -> DataFrame:
    """``docs`` without the rows that contain an item."""
    at = docs.columns.index(text)
    for block in blocks(items, item, item_text, n, threshold):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        docs = docs.mapInArrow(lambda b, sent=sent: _without(b, sent, at, n), docs.schema)
    return docs


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    out = contained(docs, items)
    return out.withColumn("containment", F.round(F.col("n_shared") / F.col("n_item"), 6)).drop("n_shingles")


OP4_SQL = """
WITH texts AS (
  SELECT doc_id AS id, false AS item, text FROM documents UNION ALL SELECT item_id, true, text FROM benchmark),
words AS (
  SELECT id, item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM texts),
shingles AS (
  SELECT DISTINCT id, item, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT id, count(*) AS n_item FROM shingles WHERE item GROUP BY id),
common AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.s = i.s AND NOT d.item AND i.item GROUP BY d.id, i.id)
SELECT doc_id, item_id, n_shared, n_item, round(n_shared / n_item, 6) AS containment
FROM common JOIN sizes ON sizes.id = item_id WHERE 100 * n_shared >= 75 * n_item
"""
