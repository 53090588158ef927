"""Operator 9, language ID by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds the vectors of
its letters by multiplication, each permuted by its place; a document is the bundle (sum) of
its n-gram vectors, a language the bundle of its training documents. A document gets the
language of the largest cosine.

Bundling is linear, so a slice of documents is one matrix product of n-gram counts and n-gram
vectors. Training adds up one vector per language and task, so its shuffle does not grow with
the texts; only the prototypes, one vector per language, reach the driver.

Letters are lower-cased Unicode letters, a run of anything else is one gap; n-grams are three
places around a letter. Defined results: a text that is null or has no letter is ``und`` with
score 0; ties go to the first language in order; without training rows every row is ``und``;
rows are judged one by one, so repeated rows and ids do not matter. Other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import arrow

UNKNOWN = "und"
DIMENSIONS = 1024
SEED = 11
CELLS = 6_000_000


@functools.cache
def _folded() -> np.ndarray:
    """Lower-cased letter of every code point; 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = ord(s.lower()[0])
    return out


@functools.lru_cache(maxsize=4096)
def _letter(code: int, dimensions: int) -> np.ndarray:
    """The vector of a letter; the gap (0) has one too."""
    return np.random.default_rng((SEED, code)).integers(0, 2, dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)


def _gram_vectors(letters: np.ndarray, grams: np.ndarray, dimensions: int) -> np.ndarray:
    base = np.stack([_letter(int(c), dimensions) for c in letters])
    size = len(letters)
    a, b, c = grams // (size * size), grams // size % size, grams % size
    return (np.roll(base, 2, 1)[a] * np.roll(base, 1, 1)[b] * base[c]).astype(np.float32)


def bundles(texts: list[str | None], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Bundled vector and number of letters of each text."""
    joined = "\n".join(t or "" for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t or "") for t in texts]) + 1
    row = np.repeat(np.arange(len(texts)), lengths)[: len(codes)]
    folded = _folded()[codes]
    keep = folded != 0
    keep[1:] |= folded[:-1] != 0
    folded, row = np.concatenate([[0], folded[keep], [0]]), row[keep]
    present = np.unique(folded)
    letters = np.searchsorted(present, folded)
    center = letters[1:-1] > 0 if len(present) and present[0] == 0 else np.ones(len(letters) - 2, bool)
    size = len(present)
    gram = ((letters[:-2] * size + letters[1:-1]) * size + letters[2:])[center]
    row = row[center]
    out = np.zeros((len(texts), dimensions), np.float32)
    count = np.bincount(row, minlength=len(texts))
    if not len(gram):
        return out, count
    if size**3 <= 4_000_000:
        seen = np.zeros(size**3, np.int64)
        seen[gram] = 1
        grams = np.flatnonzero(seen)
        seen[grams] = np.arange(len(grams))
        gram = seen[gram]
    else:
        grams, gram = np.unique(gram, return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(count)])
    for g in range(0, len(grams), 8192):  # a text in a large alphabet has many n-grams
        vectors = _gram_vectors(present, grams[g : g + 8192], dimensions)
        step = max(1, CELLS // len(vectors))
        for a in range(0, len(texts), step):
            b = min(a + step, len(texts))
            x, y = gram[ends[a] : ends[b]], row[ends[a] : ends[b]] - a
            if len(grams) > 8192:
                some = (x >= g) & (x < g + len(vectors))
                x, y = x[some] - g, y[some]
            cells = np.bincount(y * len(vectors) + x, minlength=(b - a) * len(vectors))
            out[a:b] += cells.reshape(b - a, -1).astype(np.float32) @ vectors
    return out, count


@dataclass
class Profiles:
    """Prototype of each language, in the order of their names."""

    languages: list[str]
    vectors: np.ndarray

    def closest(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        found, letters = bundles(texts, self.vectors.shape[1])
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = found.astype(np.float64)
        norms = np.linalg.norm(found, axis=1)[:, None] * np.linalg.norm(self.vectors, axis=1)[None, :]
        cosine = found @ self.vectors.T / np.where(norms > 0, norms, 1)
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1)
        score[letters == 0] = 0
        return [self.languages[k] if n else UNKNOWN for k, n in zip(best, letters, strict=True)], score


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[str | None]]]:
    _, offsets = arrow.utf8(batch.column(column))
    for first, last in arrow.slices(offsets):
        yield first, last, batch.column(column).slice(first, last - first).to_pylist()


def _learn(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        for first, last, texts in _slices(batch, 1):
            found, _ = bundles(texts, dimensions)
            here = names[first:last]
            for name in set(here):
                rows = [k for k, x in enumerate(here) if x == name]
                sums[name] = sums.get(name, 0) + found[rows].astype(np.float64).sum(0)
    if sums:
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array(list(sums)), "vector": pa.array(list(sums.values()), pa.list_(pa.float64())),
        })


def learn(
    docs: DataFrame, text="text", lang="lang", dimensions: int = DIMENSIONS, most_languages: int = 10_000
) -> Profiles:
    """Prototypes of the languages of ``docs``; rows with a null text or language are passed over.

    ``most_languages`` bounds what reaches the driver; more distinct values than that are no
    language codes, and raise.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.filter("lang is not null and text is not null")
    parts = rows.mapInArrow(lambda b: _learn(b, dimensions), "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(
        F.sum("value").alias("value")
    )
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("v"))
    found = found.orderBy("lang").limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError("more languages than most_languages")
    vectors = np.array([[x.value for x in r.v] for r in found]).reshape(len(found), dimensions)
    return Profiles([r.lang for r in found], vectors)


def _predict(batches: Iterator[pa.RecordBatch], profiles: Profiles, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, texts in _slices(batch, at):
            names, score = profiles.closest(texts)
            part = batch.slice(first, last - first)
            columns = [*part.columns, pa.array(names), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "lang_pred", "lang_score"])


def predict(docs: DataFrame, profiles: Profiles, text="text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, which replace columns of these names."""
    rows = docs.drop("lang_pred", "lang_score")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    at = rows.columns.index(text)
    schema = f"{fields}, lang_pred string, lang_score double"
    return rows.mapInArrow(lambda b: _predict(b, profiles, at), schema)


def reject(docs: DataFrame, profiles: Profiles, text="text", least: float = 0.1) -> DataFrame:
    """``docs`` without the rows in no known language: ``und``, or a cosine below ``least``."""
    out = predict(docs, profiles, text)
    return out.filter((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= least))


def _remainder(id: str):
    return F.crc32(F.col(id).cast("string").cast("binary")) % 5


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicts all documents after learning from those with a non-zero remainder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.filter(_remainder("doc_id") != 0))
    out = predict(docs.select("doc_id", "text"), profiles)
    return out.select(
        "doc_id", (_remainder("doc_id") == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
