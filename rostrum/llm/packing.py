"""Operator 5, packing by power-of-two decomposition.

Each document is tokenised, closed with an end id and cut into pieces whose lengths are the
sequence length, as often as it fits, and then the binary digits of the rest. Every piece is
a sequence of its own, so no sequence crosses documents; equal lengths form a bucket, and
every batch is drawn from one bucket, so there is no padding at all.

The vocabulary splits at white space before it merges, so the ids of a word do not depend on
its neighbours. Workers tokenise each distinct word of a slice once and keep a bounded table
of words; documents are then assembled from that table as arrays.

The ids are those of the vocabulary file as it is: a text that quotes one of its special tokens has
that token's id there.

Defined results: a null or empty text is a document of one token, the end id; repeated rows
and null ids are packed like any others; an empty table gives no rows. Columns beyond id and
text are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import arrow

END_ID = 1
LENGTH = 2048
KEPT_WORDS = 500_000

# Words of these characters need no Unicode normalisation, and lower-casing them is the same
# in every library; others go through the whole tokenizer.
_PLAIN = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")
# The vocabulary's own rule for splitting a word.
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """Letters À-ÿ as the characters that stand for their two bytes in byte-level BPE."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    sign = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return {c: "".join(sign[b] for b in chr(c).encode()) for c in range(192, 256)}


class WordIds:
    """Ids of words, tokenised once each; the table starts anew beyond ``KEPT_WORDS``."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(vocabulary)
        # A word that may hold one of the vocabulary's added tokens goes through the whole tokenizer.
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = regex.compile("|".join(map(regex.escape, added)) or "(?!)", regex.IGNORECASE)
        # Most words do not hold what all of them begin with.
        self.sign = os.path.commonprefix(added)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        names = self.whole.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        self.ids = np.zeros(1 << 20, np.uint32)
        self.starts = np.zeros(1 << 18, np.int64)
        self.sizes = np.zeros(1 << 18, np.int64)
        self.used = 0

    def _merge(self, parts: list[str]) -> None:
        """Ids of plain parts that are new, many at a time."""
        for k in range(0, len(parts), 256):
            some = parts[k : k + 256]
            text = " ".join(some).translate(self.letters)
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.closes[ids]) + 1
            flat, a = ids.tolist(), 0
            for part, b in zip(some, ends.tolist(), strict=True):
                self.parts[part] = tuple(flat[a:b])
                a = b

    def _encode(self, texts: list[str]) -> list[tuple[int, ...]]:
        split = [
            _PARTS.findall(t.lower()) if _PLAIN.fullmatch(t) and not (self.sign in t and self.added.search(t)) else None
            for t in texts
        ]
        known = self.parts
        self._merge(list(dict.fromkeys(p for s in split if s for p in s if p not in known)))
        out = []
        for text, s in zip(texts, split, strict=True):
            if s is None:
                out.append(tuple(self.whole.encode(text, add_special_tokens=False).ids))
            elif len(s) == 1:
                out.append(known[s[0]])
            else:
                out.append(tuple(i for p in s for i in known[p]))
        return out

    def look_up(self, w: arrow.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a slice, one after the other, and the number in each word."""
        if not len(w.hashes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, first, word = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.place) + len(keys) > KEPT_WORDS:
            self.clear()
        at = [self.place.get(k, -1) for k in keys.tolist()]
        new = [k for k, x in enumerate(at) if x < 0]
        for key, found, k in zip(keys[new].tolist(), self._encode([w.text(first[k]).decode() for k in new]), new):
            n, slot = len(found), len(self.place)
            while self.used + n > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            if slot == len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
                self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.ids[self.used : self.used + n] = found
            self.starts[slot], self.sizes[slot] = self.used, n
            self.used += n
            self.place[key] = at[k] = slot
        at = np.array(at)[word]
        sizes = self.sizes[at]
        return self.ids[arrow.ragged(self.starts[at], sizes)], sizes


@functools.cache
def _table(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def pieces(tokens: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of a document, longest first."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def _pack(batches: Iterator[pa.RecordBatch], vocabulary: str, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    table = _table(vocabulary)
    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 33
    for batch in batches:
        for w in arrow.words(batch.column(1), fold=False):
            flat, sizes = table.look_up(w)
            before = np.concatenate([[0], np.cumsum(sizes)])[w.bounds]
            row, start, size, check, total, ids = [], [], [], [], [], []
            for r in range(w.last - w.first):
                doc = np.append(flat[before[r] : before[r + 1]], np.uint32(END_ID))
                cuts = pieces(len(doc), length)
                a = 0
                for n in cuts:
                    part = doc[a : a + n]
                    start.append(a)
                    check.append(zlib.crc32(part.astype("<u4", copy=False)))
                    if with_ids:
                        ids.append(part)
                    a += n
                row += [w.first + r] * len(cuts)
                size += cuts
                total += [len(doc)] * len(cuts)
            n = len(row)
            columns = {
                "id": batch.column(0).take(pa.array(row, pa.int64())), "start": pa.array(start, pa.int64()),
                "length": pa.array(size, pa.int64()), "ids_crc32": pa.array(check, pa.int64()),
                "doc_tokens": pa.array(total, pa.int64()),
                "sequence_id": pa.array(range(number, number + n), pa.int64()),
                "offset": pa.array(np.zeros(n, np.int64)),
            }
            number += n
            if with_ids:
                joined = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(joined))
            yield pa.RecordBatch.from_pydict(columns)


def pack(
    docs: DataFrame, id="doc_id", text="text", vocabulary: str | None = None, length: int = LENGTH,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: ``(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``.

    ``length`` is a power of two. ``length`` of a row is also its bucket: write the result
    with ``partitionBy("length")`` for one folder per bucket. ``sequence_id`` holds the number
    of the input split and a running number in it: unique, and the same when a task is run
    again. Nothing is shuffled.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
        "offset bigint" + (", ids array<int>" if with_ids else "")
    )
    out = rows.mapInArrow(lambda b: _pack(b, vocabulary, length, with_ids), schema)
    return out.withColumnRenamed("id", id)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed; no SQL, as SQL has no tokenizer."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
