"""Operator 11, alignment of two tokenizers by anchors before space-marked tokens.

Both tokenisations of a text are made first, over the whole text. Their token ends are counted in
bytes of the text; an end that both have is shared, and a shared end before a token that starts with
a space (or at the end of the text) is an anchor. Anchors cut a document into windows, mostly of one
word, and a window is its token ids on both sides. The alignment inside a window depends on these
ids alone, so it is worked out once per pair of id tuples and kept in a bounded table: its groups
(cuts at all shared ends) and its links (pairs of tokens whose bytes overlap).

How often an id pair is linked in the corpus is counted in two steps. A task writes, beside its
documents, one table of distinct pairs per block of some megabytes of text. Blocks are summed by
pair, the largest count of each B id is found, and the counts go back to the blocks that asked. A
block then meets its documents by co-group. So a pair that occurs everywhere is one row per block,
not per occurrence; a group is one block, whatever the corpus; nothing is collected or broadcast.

Defined results: a text that is null or empty, or whose tokens do not spell it (it holds the space
mark itself, say), has no tokens and zeros. Strings of special tokens in a text are plain text.
Repeated rows and null ids are aligned like any others and count as often as they occur; an empty
table gives no rows. Columns beyond id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import base64
import functools
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import arrow, folder
from rostrum.llm.pieces import BYTE, PART_BYTES, model_of

BLOCK_BYTES = 32_000_000
KEPT_WINDOWS = 150_000
SLICE_BYTES = 1_000_000
# Longer windows are aligned, too, but not kept.
KEPT_IDS = 64

# Characters whose classes are the same in every version of Unicode that the libraries use; texts
# of these take the faster of two libraries with the same vocabulary.
_SETTLED = regex.compile("[\t\n\r -~¡-¬®-ɏͰ-ͷΆ-ΡΣ-ώЀ-ѿא-תぁ-ゖァ-ヺ一-龥가-힣“”‘’–—…€]*+")
LONG = 2000


def _has_long_run(text: str) -> bool:
    """Whether one pre-token may be so long that the faster library is not."""
    return len(text) >= LONG and (" " * LONG in text or max(map(len, text.split(" "))) >= LONG)


def default_vocabularies() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"), p.path("byte_bpe_50k.tiktoken")


def _byte_letters() -> dict[str, int]:
    """Bytes by the letters that stand for them in byte-level BPE."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Bytes of each token, one after the other."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.array([t.startswith(b" ") for t in tokens])

    def spell(self, ids: np.ndarray) -> np.ndarray:
        return self.data[arrow.ragged(self.starts[ids], self.sizes[ids])]


class Pair:
    """Two tokenizers."""

    def __init__(self, a: str, b: str, ranks: str | None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(a)
        self.whole.encode_special_tokens = True
        names = self.whole.get_vocab()
        letter = _byte_letters()
        tokens = [b""] * (max(names.values()) + 1)
        for name, k in names.items():
            tokens[k] = bytes(letter.get(c, 0) for c in name)
        self.a = Vocabulary(tokens)
        self.quick = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(t): int(k) for t, k in map(bytes.split, f)}
            if all(tokens[k] == t for t, k in table.items()):
                self.quick = tiktoken.Encoding(
                    "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
                )
        self.model = model_of(b)
        self.b = Vocabulary([
            bytes([int(t[3:5], 16)]) if kind == BYTE else t.replace("▁", " ").encode()
            for t, kind in zip(self.model.texts, self.model.kinds.tolist())
        ])
        self.clear()

    def clear(self) -> None:
        self.slot: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        # Of each window: number of groups, and the run of its links in ``codes``.
        self.groups, self.starts, self.widths, self.codes = (np.zeros(0, np.int64) for _ in range(4))

    def encode_a(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text behind a space."""
        out: list = [None] * len(texts)
        rest = []
        for k, t in enumerate(texts):
            if self.quick and _SETTLED.fullmatch(t) and not _has_long_run(t):
                out[k] = np.array(self.quick.encode_ordinary(" " + t), np.int32)
            else:
                rest.append(k)
        if rest:
            for k, e in zip(rest, self.whole.encode_batch([" " + texts[k] for k in rest], add_special_tokens=False)):
                out[k] = np.array(e.ids, np.int32)
        return out

    def encode_b(self, texts: list[str]) -> list[np.ndarray]:
        if any(len(t) >= PART_BYTES for t in texts):
            return self.model.ids(texts)
        return [x.astype(np.int32) for x in self.model.lib.encode(texts, num_threads=1, return_type="numpy")]

    def align(self, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> None:
        """Add the alignments of windows, their ids given end to end on both sides."""
        ends_a, ends_b = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        # Cuts into groups: ends that both sides have.
        spot = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(ends_b[spot] == ends_a)
        cut_a, cut_b = shared + 1, spot[shared] + 1
        # Links: B tokens that end after an A token begins and begin before it ends.
        first = np.searchsorted(ends_b, ends_a - self.a.sizes[a], "right")
        count = np.searchsorted(ends_b - self.b.sizes[b], ends_a, "left") - first
        codes = np.repeat(a.astype(np.int64), count) * len(self.b.sizes) + b[arrow.ragged(first, count)]
        texts, ids_a, ids_b, i, j = [], a.tolist(), b.tolist(), 0, 0
        for x, y in zip(cut_a.tolist(), cut_b.tolist()):
            if x - i == y - j == 1:
                texts.append(f"{ids_a[i]}|{ids_b[j]}")
            else:
                texts.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            i, j = x, y
        bounds = np.concatenate([[0], np.cumsum(size_a)])
        at = np.searchsorted(cut_a, bounds, "right")
        self.texts += [";".join(texts[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
        widths = _run_sums(count, bounds)
        self.groups = np.append(self.groups, np.diff(at))
        self.starts = np.append(self.starts, len(self.codes) + np.cumsum(widths) - widths)
        self.widths = np.append(self.widths, widths)
        self.codes = np.append(self.codes, codes)

    def windows(self, a: np.ndarray, b: np.ndarray, start_a, size_a, start_b, size_b) -> np.ndarray:
        """Places of the alignments of windows, given as runs of both id arrays, in the tables."""
        if len(self.texts) > KEPT_WINDOWS:
            self.clear()
        # Ids of the windows end to end; a key holds the ids of both sides, four bytes each.
        a, b = a[arrow.ragged(start_a, size_a)], b[arrow.ragged(start_b, size_b)]
        bytes_a, bytes_b, slot = a.tobytes(), b.tobytes(), self.slot
        out, new, known, i, x = [], [], len(self.texts), 0, 0
        for k, (j, y) in enumerate(zip((np.cumsum(size_a) * 4).tolist(), (np.cumsum(size_b) * 4).tolist())):
            key = (bytes_a[i:j], bytes_b[x:y])
            at = slot.get(key)
            if at is None:
                at = known + len(new)
                new.append(k)
                if j - i + y - x <= 4 * KEPT_IDS:
                    slot[key] = at
            out.append(at)
            i, x = j, y
        if new:
            fresh = np.zeros(len(size_a), bool)
            fresh[new] = True
            self.align(a[np.repeat(fresh, size_a)], b[np.repeat(fresh, size_b)], size_a[fresh], size_b[fresh])
        return np.array(out, np.int64)


@functools.cache
def _pair(a: str, b: str, ranks: str | None) -> Pair:
    return Pair(a, b, ranks)


_WEIGHTS = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _window_hashes(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of ids, by their values and places."""
    place = np.arange(len(ids)) - np.repeat(starts, sizes)
    # Beyond 256 ids the place is mixed into the value, and the weight repeats.
    value = arrow.mix(ids.astype(np.uint64) + ((place >> 8).astype(np.uint64) << np.uint64(32)) + np.uint64(1))
    sums = np.add.reduceat(value * _WEIGHTS[place & 255], starts) if len(starts) else np.zeros(0, np.uint64)
    return arrow.mix(sums + sizes.astype(np.uint64))


class Slice:
    """Some texts, aligned: arrays over documents, and over their windows."""

    def __init__(self, pair: Pair, texts: list[str]):
        found_a, found_b = pair.encode_a(texts), pair.encode_b(texts)
        n = len(texts)
        for k, t in enumerate(texts):
            if not t:
                found_a[k] = found_b[k] = np.zeros(0, np.int32)
        count_a = np.array([len(x) for x in found_a], np.int64)
        count_b = np.array([len(x) for x in found_b], np.int64)
        a = np.concatenate([np.zeros(0, np.int32), *found_a]).astype(np.int32)
        b = np.concatenate([np.zeros(0, np.int32), *found_b]).astype(np.int32)
        a, b, count_a, count_b = self._spelled(pair, texts, a, b, count_a, count_b)
        self.n_a, self.n_b = count_a, count_b
        # All texts end to end: bytes of a document follow those of the one before.
        ends_a, ends_b = np.cumsum(pair.a.sizes[a]), np.cumsum(pair.b.sizes[b])
        spot = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(ends_b[np.minimum(spot, max(len(ends_b) - 1, 0))] == ends_a) if len(a) else spot
        # An anchor: the next tokens start with a space on both sides, or the text is over.
        closes = np.zeros(len(a), bool)
        closes[np.cumsum(count_a)[count_a > 0] - 1] = True
        here = shared[closes[shared] | pair.a.spaced[a[np.minimum(shared + 1, len(a) - 1)]]] if len(a) else shared
        stop_a, stop_b = here + 1, spot[here] + 1
        start_a = np.concatenate([[0], stop_a[:-1]])[: len(here)].astype(np.int64)
        start_b = np.concatenate([[0], stop_b[:-1]])[: len(here)].astype(np.int64)
        size_a, size_b = stop_a - start_a, stop_b - start_b
        hashes = arrow.mix(_window_hashes(a, start_a, size_a) * np.uint64(3) + _window_hashes(b, start_b, size_b))
        _, first, kind = np.unique(hashes, return_index=True, return_inverse=True)
        slots = pair.windows(a, b, start_a[first], size_a[first], start_b[first], size_b[first])
        # Windows of this slice: their texts, numbers of groups, and links end to end.
        names, groups, width = [pair.texts[s] for s in slots.tolist()], pair.groups[slots], pair.widths[slots]
        flat, begin = pair.codes, pair.starts[slots]
        # Documents as runs of windows.
        bounds = np.searchsorted(stop_a, np.concatenate([[0], np.cumsum(count_a)]), "right")
        bounds[0] = 0
        own = kind.tolist()
        self.texts = [";".join([names[k] for k in own[x:y]]) for x, y in zip(bounds[:-1], bounds[1:])]
        self.n_groups = _run_sums(groups[kind], bounds)
        self.n_links = _run_sums(width[kind], bounds)
        codes = flat[arrow.ragged(begin[kind], width[kind])]
        doc = np.repeat(np.arange(n), self.n_links)
        # Distinct pairs of each document, and how often.
        wide = len(pair.a.sizes) * len(pair.b.sizes)
        keys, self.times = np.unique(doc * wide + codes, return_counts=True)
        self.codes = keys % wide
        self.pair_ends = np.concatenate([[0], np.cumsum(np.bincount(keys // wide, minlength=n))])

    @staticmethod
    def _spelled(pair, texts, a, b, count_a, count_b):
        """Without the tokens of texts that they do not spell."""
        data = [(" " + t).encode() if t else b"" for t in texts]
        want = np.array([len(d) for d in data], np.int64)
        whole = np.frombuffer(b"".join(data), np.uint8)
        good = np.ones(len(texts), bool)
        for ids, counts, vocabulary in ((a, count_a, pair.a), (b, count_b, pair.b)):
            own = _run_sums(vocabulary.sizes[ids], np.concatenate([[0], np.cumsum(counts)]))
            good &= own == want
            spelled = vocabulary.spell(ids)
            if len(spelled) == len(whole) and (own == want).all():
                differ = np.flatnonzero(spelled != whole)
                good[np.searchsorted(np.cumsum(want), differ, "right")] = False
            else:
                x, y = np.cumsum(own) - own, np.cumsum(want) - want
                for k in np.flatnonzero(own == want):
                    good[k] &= bool((spelled[x[k] : x[k] + own[k]] == whole[y[k] : y[k] + want[k]]).all())
        keep_a, keep_b = np.repeat(good, count_a), np.repeat(good, count_b)
        return a[keep_a], b[keep_b], count_a * good, count_b * good


def _run_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)]).astype(np.int64)
    return total[bounds[1:]] - total[bounds[:-1]]


def _summed(codes: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their times."""
    flat, weights = np.concatenate([np.zeros(0, np.int64), *codes]), np.concatenate([np.zeros(0, np.int64), *times])
    order = np.argsort(flat, kind="stable")
    flat, weights = flat[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)])
    return flat[at], np.add.reduceat(weights, at) if len(at) else weights


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _rows(block: int, ids: pa.Array, s: Slice, kind) -> pa.RecordBatch:
    ends = pa.array(s.pair_ends.astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(ids), block)), pa.array(np.ones(len(ids), bool)), ids,
            *[pa.array(getattr(s, name)) for name in NUMBERS], pa.array(s.texts, pa.string()),
            pa.ListArray.from_arrays(ends, pa.array(s.codes, kind)),
            pa.ListArray.from_arrays(ends, pa.array(s.times.astype(np.int32))),
        ],
        names=["block", "is_doc", "id", *NUMBERS, "groups", "pairs", "times"],
    )


def _asks(block: int, codes: np.ndarray, times: np.ndarray, id_kind, kind) -> pa.RecordBatch:
    """The row that holds the distinct pairs of a block."""
    ends = pa.array([0, len(codes)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block]), pa.array([False]), pa.nulls(1, id_kind), *[pa.array([0])] * len(NUMBERS),
            pa.nulls(1, pa.string()), pa.ListArray.from_arrays(ends, pa.array(codes, kind)),
            pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))),
        ],
        names=["block", "is_doc", "id", *NUMBERS, "groups", "pairs", "times"],
    )


def _tokenise(batches: Iterator[pa.RecordBatch], files, kind) -> Iterator[pa.RecordBatch]:
    pair = _pair(*files)
    context = TaskContext.get()
    block = (context.partitionId() if context else 0) << 32
    codes, times, size, id_kind = [], [], 0, None
    for batch in batches:
        id_kind = batch.column(0).type
        _, offsets = arrow.utf8(batch.column(1))
        for first, last in arrow.slices(offsets, SLICE_BYTES):
            # Lists of ids and keys by the million, without a cycle: nothing for the collector to find.
            gc.disable()
            s = Slice(pair, [t or "" for t in batch.column(1).slice(first, last - first).to_pylist()])
            gc.enable()
            yield _rows(block, batch.column(0).slice(first, last - first), s, kind)
            codes, times = map(lambda x: [x], _summed([*codes, s.codes], [*times, s.times]))
            size += int(offsets[last] - offsets[first])
            if size >= BLOCK_BYTES:
                yield _asks(block, codes[0], times[0], id_kind, kind)
                codes, times, size, block = [], [], 0, block + 1
    if codes:
        yield _asks(block, codes[0], times[0], id_kind, kind)


def align(docs: DataFrame, id="doc_id", text="text", vocabularies: tuple[str, str, str | None] | None = None) -> DataFrame:
    """``(block, is_doc, id, n_a, n_b, n_groups, n_links, groups, pairs, times)``.

    A document's row has its groups as text and its distinct linked id pairs, as ``a * |B| + b``
    with the number of links of each. Rows with ``is_doc`` false hold the distinct pairs of a
    block of documents; :func:`with_counts` reads them. ``vocabularies``: a ``tokenizers`` file, a
    SentencePiece file, and the first one's ranks for the faster library, if there are any.
    """
    files = vocabularies or default_vocabularies()
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    wide = len(_pair(*files).a.sizes) * len(_pair(*files).b.sizes) >= 2**31
    schema = (
        f"block bigint, is_doc boolean, id {rows.schema['id'].dataType.simpleString()}, n_a bigint, n_b bigint, "
        f"n_groups bigint, n_links bigint, groups string, pairs array<{'bigint' if wide else 'int'}>, times array<int>"
    )
    kind = pa.int64() if wide else pa.int32()
    return rows.mapInArrow(lambda b: _tokenise(b, files, kind), schema)


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """``(pair, n, best)``: the links of each id pair in the corpus, and whether no other pair of its
    B id has more. ``aligned`` is a written table."""
    asked = aligned.filter("not is_doc").select(F.inline(F.arrays_zip("pairs", "times")))
    counts = asked.groupBy(F.col("pairs").cast("bigint").alias("pair")).agg(F.sum("times").alias("n"))
    counts = counts.withColumn("b", F.col("pair") % size_b)
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _answer(left: pa.Table, right: pa.Table, names: list[str]) -> pa.Table:
    """Counts of a block's documents from the counts of its pairs."""
    pairs = right.column("pair").to_numpy()
    order = np.argsort(pairs)
    pairs, n = pairs[order], right.column("n").to_numpy()[order]
    best = right.column("best").to_numpy(zero_copy_only=False)[order]
    lists = left.column("pairs").combine_chunks()
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    at = np.searchsorted(pairs, lists.flatten().to_numpy())
    times = left.column("times").combine_chunks().flatten().to_numpy().astype(np.int64)
    return left.select(names).append_column("n_best", pa.array(_run_sums(times * best[at], bounds))).append_column(
        "count_sum", pa.array(_run_sums(times * n[at], bounds))
    )


def with_counts(aligned: DataFrame, size_b: int, keep=()) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` to the documents of a written table of :func:`align`."""
    asked = aligned.filter("not is_doc").select(F.col("block").alias("asking"), F.explode("pairs").alias("pair"))
    answers = asked.withColumn("pair", F.col("pair").cast("bigint")).join(pair_counts(aligned, size_b), "pair")
    names = ["id", *NUMBERS, *keep]
    docs = aligned.filter("is_doc")
    # A block without a single pair asks for nothing; its documents have zeros.
    empty = docs.filter(F.size("pairs") == 0).select(*names, F.lit(0).cast("bigint").alias("n_best"), F.lit(0).cast("bigint").alias("count_sum"))
    linked = docs.filter(F.size("pairs") > 0).select("block", *names, "pairs", "times")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in empty.schema.fields)
    met = linked.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(
        lambda left, right: _answer(left, right, names), kinds
    )
    return met.unionByName(empty)


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Both tokenisations of all documents, aligned; no SQL, as SQL has no tokenizers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size_b = len(_pair(*default_vocabularies()).b.sizes)
    sha = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    aligned = align(docs).withColumn("groups_sha256", sha).drop("groups")
    found = with_counts(folder.written(aligned, "aligned"), size_b, ["groups_sha256"])
    return found.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
