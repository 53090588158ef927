"""Operator 13, SentencePiece encoding that keeps the offsets of every piece.

A text is normalised by the character map compiled into the model file, a double-array trie from
byte strings to replacements. At each character the longest rule that starts there wins, else the
character stands for itself. All characters of a text walk the trie at once, as arrays, a byte a
step; only the places where a rule matches are then taken one by one. Each byte written keeps the
byte of the text it came from: a copied byte its own place, a replacement the place where its rule
began. White space becomes the space mark, with the model's settings for prefix and extra spaces.

Pieces are laid over the normalised bytes, one after the other, and their ends are projected back by
that alignment: a piece is the bytes ``begin`` to ``end`` of the original text. The pieces of a text
must cover its normalised bytes exactly, which is checked for every text. The segmentation itself is
the library's. A text of a megabyte and more goes in parts, cut before spaces, as no piece of
the vocabulary has a space mark behind another character (checked when the model is read).

Defined results: a null or empty text has the end id only. Repeated rows and null ids are encoded
like any others, an empty table gives no rows. Columns beyond id and text are not read, so their
names cannot clash. Nothing is shuffled, and a task holds one slice of texts at a time.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import arrow

MARK = "▁".encode()
PART_BYTES = 1_000_000
# Kinds of pieces in a model file.
UNKNOWN, CONTROL, BYTE = 2, 3, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharacterMap:
    """Rules ``bytes -> bytes`` from their compiled form.

    The blob holds the size of the trie in bytes, the trie as 32-bit units, and the replacements,
    each ended by a zero byte. Fixed layout of a unit: bits 0-7 and 31 its label, bit 8 whether a
    rule ends here, bits 10-30 the offset of its children, shifted by 8 more if bit 9 is set; a
    unit without label holds the place of the replacement.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4")
        self.texts = blob[4 + size :]

    def __bool__(self) -> bool:
        return len(self.units) > 0

    def _children(self, units: np.ndarray) -> np.ndarray:
        return (units >> np.uint32(10)) << ((units & np.uint32(1 << 9)) >> np.uint32(6))

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the longest rule at each start (0: none) and the place of its replacement."""
        length = np.zeros(len(starts), np.int64)
        place = np.zeros(len(starts), np.int64)
        alive = np.arange(len(starts))
        node = np.full(len(starts), self._children(self.units[:1])[0], np.uint32)
        step = 0
        while True:
            inside = starts[alive] + step < len(data)
            alive, node = alive[inside], node[inside]
            if not len(alive):
                return length, place
            byte = data[starts[alive] + step].astype(np.uint32)
            node = node ^ byte
            inside = node < len(self.units)
            alive, node, byte = alive[inside], node[inside], byte[inside]
            units = self.units[node]
            same = (units & np.uint32(0x800000FF)) == byte
            alive, node, units = alive[same], node[same], units[same]
            node = node ^ self._children(units)
            step += 1
            ends = (units & np.uint32(1 << 8)) != 0
            length[alive[ends]] = step
            place[alive[ends]] = self.units[node[ends]] & np.uint32(0x7FFFFFFF)

    def replacement(self, place: int) -> bytes:
        return self.texts[place : self.texts.index(b"\0", place)]


@dataclass
class Rules:
    """How a model normalises."""

    chars: CharacterMap
    dummy_prefix: bool = True
    extra_spaces: bool = True
    escape: bool = True


def rules_of(spec) -> Rules:
    """From a model file's ``NormalizerSpec``."""
    return Rules(
        CharacterMap(spec.precompiled_charsmap), spec.add_dummy_prefix, not spec.remove_extra_whitespaces,
        spec.escape_whitespaces,
    )


def _replaced(data: np.ndarray, chars: CharacterMap) -> tuple[np.ndarray, np.ndarray]:
    """Bytes after the character map, and the place in ``data`` of each."""
    own = np.arange(len(data))
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    length, place = chars.longest(data, starts)
    parts, places, done = [], [], 0
    for k in np.flatnonzero(length).tolist():
        a = int(starts[k])
        if a < done:  # inside the rule before
            continue
        new = np.frombuffer(chars.replacement(int(place[k])), np.uint8)
        parts += [data[done:a], new]
        places += [own[done:a], np.full(len(new), a)]
        done = a + int(length[k])
    return np.concatenate([*parts, data[done:]]), np.concatenate([*places, own[done:]])


def normalise(data: np.ndarray, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes, and the place in ``data`` of each and of their end."""
    if not len(data):
        return data, np.zeros(1, np.int64)
    end = len(data)
    if rules.chars:
        out, place = _replaced(data, rules.chars)
    else:
        out, place = data, np.arange(end)
    space = out == 32
    if not rules.extra_spaces:
        again = space & np.concatenate([[True], space[:-1]])
        out, place, space = out[~again], place[~again], space[~again]
        if len(out) and space[-1]:
            end = int(place[-1])
            out, place, space = out[:-1], place[:-1], space[:-1]
        if not len(out):
            return out, np.zeros(1, np.int64)
    if rules.dummy_prefix:
        out = np.concatenate([np.array([32], np.uint8), out])
        place = np.concatenate([place[:1], place])
        space = np.concatenate([[True], space])
    if rules.escape:
        wide = np.where(space, len(MARK), 1)
        first = np.cumsum(wide) - wide
        marks = np.repeat(out, wide)
        at = first[space]
        for k, byte in enumerate(MARK):
            marks[at + k] = byte
        out, place = marks, np.repeat(place, wide)
    return out, np.append(place, end)


class Model:
    """A model file: its normaliser, its pieces and the library's segmentation."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            blob = f.read()
        spec = proto.ModelProto()
        spec.ParseFromString(blob)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
        self.rules = rules_of(spec.normalizer_spec)
        self.kinds = np.array([p.type for p in spec.pieces])
        self.texts = [p.piece for p in spec.pieces]
        sizes = [1 if p.type == BYTE else 0 if p.type in (CONTROL, UNKNOWN) else len(p.piece.encode()) for p in spec.pieces]
        self.sizes = np.array(sizes, np.int64)
        self.end_id = self.lib.eos_id()
        # Spaces may be cut before where nothing is merged across and nothing is rewritten.
        self.cuts = (
            not self.rules.chars and self.rules.dummy_prefix and self.rules.extra_spaces and self.rules.escape
            and all(re.fullmatch("▁*[^▁]*", t) for t in self.texts)
        )

    def parts(self, text: str) -> list[str]:
        """Parts of a long text whose ids follow one another in the ids of the whole.

        Each part after the first began with a space, which the library's prefix stands for.
        """
        if not self.cuts or len(text) < PART_BYTES:
            return [text]
        out, a = [], 0
        for found in re.finditer(r"(?<=[^ ▁]) (?!\Z)", text):
            if found.start() - a >= PART_BYTES:
                out.append(text[a : found.start()])
                a = found.end()
        return [*out, text[a:]]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        if any(len(t) >= PART_BYTES for t in texts):
            cut = [self.parts(t) for t in texts]
            return [
                np.concatenate([np.array(self.lib.encode(p, num_threads=1), np.int32) for p in parts]) for parts in cut
            ]
        return [np.array(x, np.int32) for x in self.lib.encode(texts, num_threads=1)]

    def ends(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Ends of the pieces in the normalised bytes."""
        if (self.kinds[ids] == UNKNOWN).any():  # a piece without a text of its own
            own = self.lib.encode(text, out_type=str)
            return np.cumsum([1 if self.kinds[i] == BYTE else len(p.encode()) for i, p in zip(ids, own, strict=True)])
        return np.cumsum(self.sizes[ids])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece begins and ends in the bytes of the text."""
        data = np.frombuffer(text.encode(), np.uint8)
        norm, place = normalise(data, self.rules)
        ends = self.ends(text, ids)
        if (ends[-1] if len(ends) else 0) != len(norm):
            raise ValueError("pieces do not cover the normalised text")
        return place[np.concatenate([[0], ends[:-1]]).astype(np.int64)] if len(ends) else place[:0], place[ends]


@functools.cache
def model_of(path: str) -> Model:
    return Model(path)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = model_of(path)
    for batch in batches:
        _, offsets = arrow.utf8(batch.column(1))
        for first, last in arrow.slices(offsets):
            texts = [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()]
            found = model.ids(texts)
            spans = [model.spans(t, ids) for t, ids in zip(texts, found, strict=True)]
            sizes = np.diff(offsets[first : last + 1])
            closed = [np.append(ids, model.end_id).astype(np.int32) for ids in found]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0).slice(first, last - first),
                "ids": _lists(closed, np.int32),
                "begins": _lists([np.append(b, n) for (b, _), n in zip(spans, sizes)], np.int64),
                "ends": _lists([np.append(e, n) for (_, e), n in zip(spans, sizes)], np.int64),
                "decoded": pa.array(model.lib.decode([ids.tolist() for ids in closed]), pa.string()),
            })


def encode(docs: DataFrame, id="doc_id", text="text", model: str | None = None) -> DataFrame:
    """``(id, ids, begins, ends, decoded)``: the ids of each text with an end id, the bytes of the
    text that each stands for, and the text that the ids decode to.

    A piece of a replacement in the middle of a rule is empty at the rule's begin, and the last
    one holds the rule's bytes. The end id is empty at the end of the text.
    """
    model = model or default_model()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, ids array<int>, begins array<bigint>, ends array<bigint>, decoded string"
    return rows.mapInArrow(lambda b: _encode(b, model), schema).withColumnRenamed("id", id)


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded; no SQL, as SQL has no such model."""
    found = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    covered = F.aggregate(
        F.zip_with("begins", "ends", lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, n: s + n
    )
    return found.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        covered.alias("covered_bytes"),
    )
