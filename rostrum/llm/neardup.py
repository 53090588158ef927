"""Operator 10, near-duplicates by MinHash with tensored banding.

The key of table (i, j) joins the i-th of one small collection of minhash pairs with the j-th
of another: m + m pairs of minhashes serve m * m tables. A pair of documents shares a table
if it agrees in some entry of either collection; with m = 10 and two minhashes an entry that
is 0.9995 at a similarity of 0.75, for 40 minhashes in place of 400.

1. Equal shingle sets form a class, which is represented by its smallest document.
2. Every class meets the hub of each of its tables: the member that shares most tables with
   others, so the original rather than one of its copies. These candidates, a few per class
   however large a table is, are verified on full shingle sets and linked.
3. A table may still hold several components. There, members of different components are
   compared in blocks by their 40 minhashes inside the tasks; what leaves a task are the members
   that may be similar to some other, once per block. Their full sets are then compared in the
   same blocks, and only links that join components leave. Pairs are never written out, and no
   pair of the same component is looked at again.

Links are verified exactly (intersection and union of full sets); the components of all links
are the result. Sets and signatures are computed from whole texts.

Defined results: a null text or one without words has no shingles, is linked with nothing and
is a component of its own; a text of fewer words than a shingle counts its whole sequence as
one. Rows that repeat an id count as one document. A row with a null id is not compared; its
component is null and it is kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import arrow, folder, graph

WORDS = 5
THRESHOLD = (75, 100)
ENTRIES = 10
HASHES = 2
BLOCK = 512
# 40 minhashes of a pair at 0.75 agree in fewer than 18 once in 30,000 times.
SURE = 18

_rng = np.random.default_rng(71)
_N = 2 * ENTRIES * HASHES
_MULTIPLY = _rng.integers(1, 2**63, _N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 2**63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_EMPTY = np.uint64(2**64 - 1)


def distinct_sets(w: arrow.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each row of a slice, and their number before each row."""
    hashes, bounds = arrow.shingles(w, n)
    parts = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return (np.concatenate(parts) if parts else hashes), ends


def set_keys(hashes: np.ndarray, ends: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set; None for an empty one."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (hashes, arrow.mix(hashes ^ _ODD[0]))]
    both = np.stack([arrow.mix(s[ends[1:]] - s[ends[:-1]]) for s in sums], 1)
    full = np.diff(ends) > 0
    return [both[r].tobytes() if full[r] else None for r in range(len(full))]


def _signatures(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.full((len(ends) - 1, _N), _EMPTY)
    full = np.flatnonzero(np.diff(ends))
    if len(full):
        for k in range(_N):
            x = hashes * _MULTIPLY[k]
            x ^= x >> np.uint64(32)
            x *= _ODD[1]
            out[full, k] = np.minimum.reduceat(x, ends[full])
    return out


def _sign(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in arrow.words(batch.column(1)):
            hashes, ends = distinct_sets(w, n)
            signature = _signatures(hashes, ends)
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).slice(w.first, w.last - w.first), "n_shingles": pa.array(np.diff(ends)),
                "set_key": pa.array(set_keys(hashes, ends), pa.binary()),
                "signature": pa.array([x.tobytes() for x in signature], pa.binary()),
            })


def _entries(signature: np.ndarray) -> np.ndarray:
    """Entries of both collections, one row per signature."""
    entries = np.zeros((len(signature), 2 * ENTRIES), np.uint64)
    for k in range(HASHES):
        entries = arrow.mix(entries * _ODD[2] + signature[:, k * 2 * ENTRIES : (k + 1) * 2 * ENTRIES])
    return entries


def table_keys(signature: np.ndarray) -> np.ndarray:
    """Keys of all tables, one row per signature."""
    entries = _entries(signature)
    left, right = entries[:, :ENTRIES, None], entries[:, None, ENTRIES:]
    number = np.arange(ENTRIES * ENTRIES, dtype=np.uint64).reshape(1, ENTRIES, ENTRIES)
    return arrow.mix(left + right * _ODD[3] + number).reshape(len(signature), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), _N)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, len(batch), 1024):
            part = batch.slice(a, 1024)
            keys = table_keys(_matrix(part.column(1))).view(np.int64)
            ids = part.column(0).take(pa.array(np.repeat(np.arange(len(part)), keys.shape[1])))
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.reshape(-1)), "id": ids})


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Full sets of the texts whose set is the wanted one."""
    for batch in batches:
        want = batch.column(2).to_pylist()
        for w in arrow.words(batch.column(1)):
            hashes, ends = distinct_sets(w, n)
            keys = set_keys(hashes, ends)
            take = [r for r in range(len(keys)) if keys[r] == want[w.first + r]]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).take(pa.array([w.first + r for r in take], pa.int64())),
                "set": pa.array([hashes[ends[r] : ends[r + 1]].tobytes() for r in take], pa.binary()),
            })


def _similar(x: np.ndarray, y: np.ndarray, part: int, whole: int) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches ``part / whole``."""
    if whole * min(len(x), len(y)) < part * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return whole * common >= part * (len(x) + len(y) - common)


def _verify(batches: Iterator[pa.RecordBatch], part: int, whole: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        take = []
        for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            if _similar(x, y, part, whole):
                take.append(k)
        take = pa.array(take, pa.int64())
        yield pa.RecordBatch.from_pydict({"a": batch.column(0).take(take), "b": batch.column(1).take(take)})


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of each ``group``, the first column, by which the input is sorted."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        groups = batch.column(0).to_pylist()
        cuts = [0, *(k for k in range(1, len(groups)) if groups[k] != groups[k - 1]), len(groups)]
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if x == y:
                continue
            if held and groups[x] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = groups[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of a block, or of two, that agree enough with one of another component."""
    for table in _groups(batches):
        component = table["component"].to_numpy()
        left, right = table["left"].to_numpy().astype(bool), table["right"].to_numpy().astype(bool)
        signature = _matrix(table["signature"].combine_chunks())
        small = (signature & np.uint64(0xFFFF)).astype(np.uint16)
        # A pair is looked at in the first table that it shares, and in no other.
        key = np.int64(table["group"][0].as_py().partition(":")[0])
        row, column = divmod(int(np.flatnonzero(table_keys(signature[:1])[0].view(np.int64) == key)[0]), ENTRIES)
        entries = _entries(signature)
        kinds, at, count = np.unique(component, return_inverse=True, return_counts=True)
        outside = np.flatnonzero(at != count.argmax())  # one of a pair is outside the commonest component
        take = np.zeros(len(component), bool)
        for k in outside:
            other = np.flatnonzero((component != component[k]) & ((left[k] & right) | (right[k] & left)))
            near = other[(small[other] == small[k]).sum(1) >= SURE]
            same = entries[near] == entries[k]
            near = near[(same[:, :ENTRIES].argmax(1) == row) & (same[:, ENTRIES:].argmax(1) == column)]
            if len(near):
                take[k] = take[near] = True
        if take.any():
            yield table.select(["group", "id", "component", "left", "right"]).filter(pa.array(take)).combine_chunks().to_batches()[0]


def _joined(batches: Iterator[pa.RecordBatch], part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """Links of a block, or of two, that join components."""
    for table in _groups(batches):
        ids, component = table["id"].to_pylist(), table["component"].to_pylist()
        left, right = table["left"].to_pylist(), table["right"].to_pylist()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["set"]]
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while root.get(c, c) != c:
                c = root[c]
            return c

        out = []
        for k in range(len(ids)):
            for m in range(k):
                if not (left[k] and right[m] or right[k] and left[m]):
                    continue
                a, b = find(component[k]), find(component[m])
                if a != b and _similar(sets[k], sets[m], part, whole):
                    root[max(a, b)] = min(a, b)
                    out.append((min(ids[k], ids[m]), max(ids[k], ids[m])))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _verified(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar."""
    one = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    other = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    rows = pairs.join(one, "b").join(other, "a").select("a", "b", "set_a", "set_b")
    return rows.mapInArrow(lambda b: _verify(b, *threshold), "a bigint, b bigint")


def links(docs: DataFrame, id="doc_id", text="text", n: int = WORDS, threshold=THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(signed, links)``: every row with its class, and the links between classes.

    ``signed`` has ``id, n_shingles, set_key, class``; ``links`` has ``a, b``, ids of classes.
    """
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    signed = folder.written(
        rows.mapInArrow(lambda b: _sign(b, n), "id bigint, n_shingles bigint, set_key binary, signature binary"),
        "signatures",
    )
    named = signed.filter("id is not null and set_key is not null")
    classes = folder.written(
        named.groupBy("set_key").agg(F.min("id").alias("class"), F.min("signature").alias("signature")), "classes"
    )
    keys = classes.select("class", "signature").mapInArrow(_key_rows, "key bigint, id bigint")
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("size"))
    shared = shared.filter("least < most").select("key", "size")
    met = folder.written(keys.join(shared, "key").select("key", "size", "id"), "tables")
    # Of a table's members, the hub is the one that meets most others in all its tables.
    degree = met.groupBy("id").agg(F.sum("size").alias("degree"))
    rank = F.struct("degree", (-F.col("id")).alias("first"))
    hubs = met.join(degree, "id").groupBy("key").agg(F.max_by("id", rank).alias("hub"))

    # Sets of the classes that meet any other, from their smallest document.
    wanted = classes.join(met.select(F.col("id").alias("class")).distinct(), "class")
    texts = rows.join(wanted.select(F.col("class").alias("id"), "set_key"), "id").select("id", "text", "set_key")
    sets = folder.written(texts.mapInArrow(lambda b: _sets(b, n), "id bigint, set binary"), "sets")

    first = met.join(hubs, "key").filter("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    found = folder.written(_verified(first, sets, threshold), "verified")
    rest = folder.written(_residual(met, found, classes), "residual")
    if not rest.isEmpty():
        rows = rest.join(sets, "id").select("group", "id", "component", "left", "right", "set")
        rows = rows.repartition("group").sortWithinPartitions("group")
        more = rows.mapInArrow(lambda b: _joined(b, *threshold), "a bigint, b bigint").distinct()
        found = found.union(folder.written(more, "verified"))
    out = signed.select("id", "n_shingles", "set_key").join(classes.select("set_key", "class"), "set_key", "left")
    return out, found


def _residual(met: DataFrame, found: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of tables with several components that may be similar across them, by blocks."""
    part = graph.components(found)
    members = met.drop("size").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    members = folder.written(members, "members")
    mixed = members.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")
    ).filter("low < high")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = (
        members.join(mixed.select("key", blocks.alias("blocks")), "key").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        .withColumn("group", F.concat_ws(":", "key", "low", "high"))
        .withColumn("left", (F.col("own") == F.col("low")).cast("int"))
        .withColumn("right", (F.col("own") == F.col("high")).cast("int"))
    )
    signature = classes.select(F.col("class").alias("id"), "signature")
    names = ["group", "id", "component", "left", "right", "signature"]
    rows = rows.join(signature, "id").select(*names).repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(_across, "group string, id bigint, component bigint, left int, right int")


def near_duplicates(
    docs: DataFrame, id="doc_id", text="text", n: int = WORDS, threshold: tuple[int, int] = THRESHOLD
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` per row; ``threshold`` is a fraction (part, whole)."""
    signed, found = links(docs, id, text, n, threshold)
    part = graph.components(found).select(F.col("id").alias("class"), "component")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "class", "id"))
    out = signed.join(part, "class", "left").select("id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id)


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT documents.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id,
  documents.doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) JOIN least USING (doc_id)
"""
