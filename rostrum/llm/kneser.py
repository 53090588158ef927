"""Operator 6, LM scoring by an interpolated modified Kneser-Ney bigram model.

Counting is a Spark job. Tasks count pairs of neighbouring words as arrays and hand them over
as packed blocks, one per shard, so that the shuffle moves each distinct pair of a task once,
without a row for each. Shards are formed by the first word; the pairs of the commonest words
are spread over all shards by their second word. A second shuffle brings together, by word,
the counts as context (followers seen once, twice, more often) and as continuation (distinct
predecessors). Both tables are stored as sorted hash arrays in the shared folder, one file a
shard, written under another name and renamed, so a repeated task replaces its own file.

Workers map the files into memory and look up the distinct words and pairs of a slice in one
sorted pass: pages are shared by the workers of a machine and are not part of their memory.
The folder must be mounted on the executors (any shared file system); only the constants of
the model, a few numbers, pass through the driver.

Tokens are the words of a text, lower-cased in A-Z, and one end. A pair's first word may also
be the start of a text. The lower order is the continuation distribution, interpolated with
the uniform one over the known words and one unknown word, so probabilities add up to 1.

Defined results: a null or empty text is one end token; repeated rows count as often as they
occur; without training rows every token has the uniform probability 1; an empty table gives
no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import arrow, folder

START, END = np.uint64(0x51A97), np.uint64(0xE4D)
HELD_PAIRS = 4_000_000
HOT_WORDS = 256
SCORE_BYTES = 4_000_000
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return arrow.mix(first * _PAIR + second)


def _shards(first: np.ndarray, second: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    own = arrow.mix(first + np.uint64(1))
    if len(hot):
        spot = np.minimum(np.searchsorted(hot, first), len(hot) - 1)
        common = hot[spot] == first
        own[common] = arrow.mix(own[common] ^ second[common])
    return (own % np.uint64(shards)).astype(np.int64)


def tokens(w: arrow.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, second words (the tokens), and number of tokens before each row."""
    bounds = w.bounds
    rows = len(bounds) - 1
    ends = bounds + np.arange(rows + 1)
    second = np.full(ends[-1], END)
    inner = np.ones(ends[-1], bool)
    inner[ends[1:] - 1] = False
    second[inner] = w.hashes
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[ends[:-1]] = START
    return first, second, ends


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, the place of one occurrence of each, and sums of the values."""
    order = np.argsort(keys)
    ranked = keys[order]
    cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(keys) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(v[order], cuts) if len(cuts) else v[:0] for v in values]
    return ranked[cuts], order[cuts], sums


# --- blocks: arrays of one shard on their way to it ------------------------------------


def _pack_pairs(first: np.ndarray, second: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs that are sorted by their first word, which is stored once a run."""
    cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
    runs = np.diff(np.concatenate([cuts, [len(first)]])).astype(np.uint32)
    head = np.array([len(cuts), len(first)], np.uint64)
    return b"".join(x.tobytes() for x in (head, first[cuts], runs, second, count.astype(np.uint32)))


def _unpack_pairs(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, n = (int(x) for x in np.frombuffer(block, np.uint64, 2))
    first = np.frombuffer(block, np.uint64, m, 16)
    runs = np.frombuffer(block, np.uint32, m, 16 + 8 * m)
    second = np.frombuffer(block, np.uint64, n, 16 + 12 * m)
    count = np.frombuffer(block, np.uint32, n, 16 + 12 * m + 8 * n)
    return np.repeat(first, runs), second, count


def _block(shard: int, kind: int, body: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "shard": pa.array([shard], pa.int32()), "kind": pa.array([kind], pa.int32()),
        "body": pa.array([body], pa.binary()),
    })


_SCHEMA = "shard int, kind int, body binary"


def _count_pairs(batches: Iterator[pa.RecordBatch], hot: np.ndarray, shards: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        key, first, second, count = (np.concatenate(x) for x in zip(*held, strict=True))
        _, at, (count,) = summed(key, count)
        first, second = first[at], second[at]
        shard = _shards(first, second, hot, shards)
        order = np.argsort((shard.astype(np.uint64) << np.uint64(44)) | (first >> np.uint64(20)))
        first, second, count, shard = first[order], second[order], count[order], shard[order]
        cuts = np.searchsorted(shard, np.arange(shards + 1))
        for k in range(shards):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                yield _block(k, 0, _pack_pairs(first[a:b], second[a:b], count[a:b]))

    for batch in batches:
        for w in arrow.words(batch.column(0)):
            first, second, _ = tokens(w)
            key, at, (count,) = summed(pair_keys(first, second), np.ones(len(first), np.int64))
            held.append((key, first[at], second[at], count))
            size += len(key)
            if size > HELD_PAIRS:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _local(path: str) -> str:
    """A path that workers can open: the shared folder must be mounted."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"a memory-mapped model needs a mounted shared folder, not {url.scheme}://")
    return url.path


def _store(path: str, arrays: list[np.ndarray]) -> None:
    """One file: the length, then the arrays, sorted by the first."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        out.write(np.uint64(len(arrays[0])).tobytes())
        for x in arrays:
            out.write(np.ascontiguousarray(x).tobytes())
    os.replace(part, path)


@functools.lru_cache(maxsize=2048)
def _mapped(path: str, kinds: tuple[str, ...]) -> list[np.ndarray]:
    body = np.memmap(path, np.uint8, "r")
    n, at, out = int(body[:8].view(np.uint64)[0]), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(body[at : at + size].view(kind))
        at += size
    return out


_PAIR_FILE = ("<u8", "<u4")
_WORD_FILE = ("<u8",) * 7


def _by_shard(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple[int, bytes]]]:
    found: dict[int, list[tuple[int, bytes]]] = {}
    for batch in batches:
        for shard, kind, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(shard, []).append((kind, body))
    return found


def _rows_block(arrays: list[np.ndarray]) -> bytes:
    return np.stack([x.astype(np.uint64) for x in arrays]).tobytes()


def _merge_pairs(batches: Iterator[pa.RecordBatch], path: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Counts of a shard to its file; contexts and continuations go on to the shards of words."""
    found = _by_shard(batches)
    for shard in list(found):
        parts = [_unpack_pairs(body) for _, body in found.pop(shard)]
        first, second, count = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        key, at, (count,) = summed(pair_keys(first, second), count.astype(np.int64))
        first, second = first[at], second[at]
        _store(f"{path}/pairs-{shard}", [key, np.minimum(count, 2**32 - 1).astype(np.uint32)])
        ones = [(count == k).astype(np.int64) for k in (1, 2, 3, 4)]
        yield _block(shard, 3, np.array([x.sum() for x in ones] + [len(key), count.sum()], np.uint64).tobytes())
        more = (count >= 3).astype(np.int64)
        word, _, sums = summed(first, count, ones[0], ones[1], more)
        yield from _send(1, word, sums, shards)
        word, _, sums = summed(second, np.ones_like(count), count)
        yield from _send(2, word, sums, shards)


def _send(kind: int, word: np.ndarray, values: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    shard = _shards(word, word, word[:0], shards)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in range(shards):
        some = order[cuts[k] : cuts[k + 1]]
        if len(some):
            yield _block(k, kind, _rows_block([word[some], *[v[some] for v in values]]))


def _merge_words(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """The words of a shard to its file; returns what the constants are made of."""
    found = _by_shard(batches)
    for shard in list(found):
        blocks = found.pop(shard)
        contexts = [np.frombuffer(b, np.uint64).reshape(5, -1) for k, b in blocks if k == 1]
        follows = [np.frombuffer(b, np.uint64).reshape(3, -1) for k, b in blocks if k == 2]
        pairs = sum((np.frombuffer(b, np.uint64) for k, b in blocks if k == 3), np.zeros(6, np.uint64))
        x = np.concatenate(contexts, 1) if contexts else np.zeros((5, 0), np.uint64)
        y = np.concatenate(follows, 1) if follows else np.zeros((3, 0), np.uint64)
        zeros = lambda m, n: [np.zeros(n, np.uint64)] * m
        columns = [
            np.concatenate(parts)
            for parts in zip(
                [x[0], *zeros(2, x.shape[1]), *x[1:]], [y[0], *y[1:], *zeros(4, y.shape[1])], strict=True
            )
        ]
        # word; distinct predecessors, count as token; count as context, followers seen 1, 2, 3+ times
        word, _, sums = summed(columns[0], *columns[1:])
        _store(f"{path}/words-{shard}", [word, *sums])
        kinds = sums[0]
        tail = [int((kinds == k).sum()) for k in (1, 2, 3, 4)] + [int((kinds >= 3).sum()), int((kinds > 0).sum())]
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()),
            "sums": pa.array([[*pairs.astype(np.int64).tolist(), *tail]], pa.list_(pa.int64())),
        })


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where a count of counts is 0, half a count."""
    if not n1 or not n2:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in zip((d1, d2, d3), (1, 2, 3), strict=True))


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the constants."""

    path: str
    shards: int
    hot: tuple[int, ...]
    tokens: int
    words: int
    kinds: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    word_sums: tuple[int, int, int]

    def _find(self, name: str, kinds: tuple[str, ...], keys: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
        """Values of sorted keys, 0 for what is not there."""
        out = [np.zeros(len(keys), np.int64) for _ in kinds[1:]]
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in range(self.shards):
            some = order[cuts[k] : cuts[k + 1]]
            path = f"{self.path}/{name}-{k}"
            if not len(some) or not os.path.exists(path):
                continue
            stored, *values = _mapped(path, kinds)
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[some]), len(stored) - 1)
            hit = stored[at] == keys[some]
            for x, v in zip(out, values, strict=True):
                x[some[hit]] = v[at[hit]]
        return out

    def score(self, w: arrow.Words) -> dict[str, np.ndarray]:
        """Token counts and log10 probabilities of each row of a slice."""
        first, second, ends = tokens(w)
        word = np.unique(np.concatenate([second, [START, END]]))
        shard = _shards(word, word, word[:0], self.shards)
        kinds, count, total, n1, n2, n3 = self._find("words", _WORD_FILE, word, shard)
        d1, d2, d3 = self.word_discounts
        cut = np.select([kinds == 0, kinds == 1, kinds == 2], [0.0, d1, d2], d3)
        left = sum(d * n for d, n in zip(self.word_discounts, self.word_sums, strict=True))
        lower = (kinds - cut + left / (self.words + 1)) / max(self.kinds, 1)
        if not self.kinds:
            lower = np.ones(len(word))
        d1, d2, d3 = self.pair_discounts
        weight = (d1 * n1 + d2 * n2 + d3 * n3) / np.maximum(total, 1)
        a, b = np.searchsorted(word, first), np.searchsorted(word, second)
        key, at, pair = np.unique(pair_keys(first, second), return_index=True, return_inverse=True)
        hot = np.array(self.hot, np.uint64)
        (seen,) = self._find("pairs", _PAIR_FILE, key, _shards(first[at], second[at], hot, self.shards))
        cut = np.select([seen == 0, seen == 1, seen == 2], [0.0, d1, d2], d3)
        a, b = a[at], b[at]
        known = total[a] > 0
        chance = np.where(known, (seen - cut) / np.maximum(total[a], 1) + weight[a] * lower[b], lower[b])
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        at = ends[:-1]
        return {
            "n_tokens": np.diff(ends),
            "n_known": np.add.reduceat((count[b] > 0).astype(np.int64)[pair], at),
            "base_score": np.add.reduceat(base[b][pair], at),
            "score": np.add.reduceat(np.log10(chance)[pair], at),
        }


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in arrow.words(batch.column(0)):
            word, count = np.unique(w.hashes, return_counts=True)
            some = np.argsort(-count)[: 4 * HOT_WORDS]
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(word[some].view(np.int64)), "n": pa.array(count[some].astype(np.int64)),
            })


def train(docs: DataFrame, text="text", path: str | None = None, shards: int | None = None) -> Model:
    """Count ``docs`` into arrays under ``path`` (a new folder of the shared one by default).

    ``shards`` is the number of files of each table, by default that of shuffle partitions.
    The commonest words, whose pairs are spread, are guessed from a part of the rows; the guess
    only balances the shards.
    """
    spark: SparkSession = docs.sparkSession
    path = _local(path or folder.fresh(spark, "kneser"))
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(text).cast("string").alias("text"))
    some = rows.filter(F.pmod(F.xxhash64("text"), F.lit(64)) == 0)
    top = some.mapInArrow(_common, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    hot = sorted(r.word % 2**64 for r in top.orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect())
    spread = np.array([*hot, int(START)] if hot else [int(START)], np.uint64)
    spread.sort()
    parts = rows.mapInArrow(lambda b: _count_pairs(b, spread, shards), _SCHEMA).repartitionById(shards, F.col("shard"))
    merged = parts.mapInArrow(lambda b: _merge_pairs(b, path, shards), _SCHEMA).repartitionById(shards, F.col("shard"))
    done = merged.mapInArrow(lambda b: _merge_words(b, path), "shard int, sums array<bigint>")
    total = done.select(*[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(12)]).first()
    s = [int(x or 0) for x in total]
    return Model(
        path=path, shards=shards, hot=tuple(int(x) for x in spread), tokens=s[5], words=s[11], kinds=s[4],
        pair_discounts=discounts(*s[:4]), word_discounts=discounts(*s[6:10]), word_sums=(s[6], s[7], s[10]),
    )


def _score(batches: Iterator[pa.RecordBatch], model: Model, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in arrow.words(batch.column(at), most=SCORE_BYTES):
            found = model.score(w)
            part = batch.slice(w.first, w.last - w.first)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *[pa.array(x) for x in found.values()]], [*part.schema.names, *found]
            )


SCORES = ["n_tokens", "n_known", "base_score", "score"]


def score(docs: DataFrame, model: Model, text="text") -> DataFrame:
    """``docs`` with ``n_tokens, n_known, base_score, score``, which replace columns of these names."""
    rows = docs.drop(*SCORES)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = f"{fields}, n_tokens bigint, n_known bigint, base_score double, score double"
    at = rows.columns.index(text)
    return rows.mapInArrow(lambda b: _score(b, model, at), schema)


def perplexity() -> Column:
    return F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))


def op6_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    model = train(docs.filter(~held))
    out = score(docs, model).withColumn("train_tokens", F.lit(model.tokens).cast("bigint"))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
