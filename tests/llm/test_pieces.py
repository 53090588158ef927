import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as proto

from rostrum.llm import pieces

TEXTS = [
    "héllo 東\U0001F600京 x\ny  z", None, "", " ", "   ", "▁a", "a▁ b", "a▁  ▁b", "</s> <unk> <0x41> <s>", "a\x00b\tc",
    "\U00010348 ቢ 𝒳 word " * 30, "word " * 4000, "a" * 3000, " lead and trail  ", "é ﬁ ½ ｱ ㍿",
]


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_equals_the_library(spark, docs, clashing, lib):
    rows = clashing(docs(TEXTS + TEXTS[:1]))
    got = {r.doc_id: r for r in pieces.encode(rows).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS + TEXTS[:1]):
        text, r = text or "", got[i]
        want = lib.encode(text, add_eos=True)
        assert r.ids == want and r.decoded == lib.decode(want)
        data = text.encode()
        assert r.begins[0] == 0 and r.ends == [*r.begins[1:], len(data)] and r.ends[-2 if len(want) > 1 else -1] == len(data)
        for at, (k, a, b) in enumerate(zip(r.ids, r.begins, r.ends)):
            piece = lib.id_to_piece(k).replace("▁", " ").encode()
            if not (lib.is_byte(k) or lib.is_control(k)) and "▁" not in text:
                # The first piece begins with the model's own prefix.
                assert data[a:b] == (piece if at else piece.removeprefix(b" "))
            if lib.is_byte(k):
                assert b"<0x%02X>" % data[a] == piece and b == a + 1


def test_query_digests(spark, docs, lib, tmp_path):
    docs(TEXTS).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    for r in pieces.op13_sentencepiece(spark, str(tmp_path)).collect():
        ids = lib.encode(TEXTS[r.doc_id] or "", add_eos=True)
        assert r.n_tokens == len(ids) and r.covered_bytes == len((TEXTS[r.doc_id] or "").encode())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_long_texts_go_in_parts(monkeypatch, lib):
    model = pieces.Model(pieces.default_model())
    monkeypatch.setattr(pieces, "PART_BYTES", 7)
    for text in [*filter(None, TEXTS), "a  b   c ▁ d ▁▁ e  ▁f" * 5, "no_space" * 9, "ends in space "]:
        (ids,) = model.ids([text])
        assert ids.tolist() == lib.encode(text)
    assert len(model.parts("some words that are cut")) > 1


def library(name, **settings):
    return sentencepiece.SentencePieceNormalizer(**name, **settings)


def spec_of(normalizer):
    spec = proto.NormalizerSpec()
    spec.ParseFromString(normalizer.serialized_normalizer_spec())
    return spec


NORMALISERS = {
    name: library({"rule_name": name}, add_dummy_prefix=prefix, remove_extra_whitespaces=extra, escape_whitespaces=escape)
    for name, prefix, extra, escape in [("nmt_nfkc", True, True, True), ("nfkc_cf", True, False, True), ("nfkc", False, True, False)]
}
ALPHABET = "ab eéｱﾊﾟ㍿½ﬁ́̈ 　\t\n​한각가东X"


@settings(max_examples=150, deadline=None)
@given(st.text(ALPHABET, max_size=24), st.sampled_from(sorted(NORMALISERS)))
def test_character_map_equals_the_library(text, name):
    normalizer = NORMALISERS[name]
    rules = pieces.rules_of(spec_of(normalizer))
    assert rules.chars
    norm, place = pieces.normalise(np.frombuffer(text.encode(), np.uint8), rules)
    want, offsets = normalizer.normalize(text, with_offsets=True)
    assert norm.tobytes().decode() == want
    # The library counts characters: begin of each normalised one, and the end.
    chars = {len(text[:k].encode()): k for k in range(len(text) + 1)}
    starts = np.flatnonzero((norm & 0xC0) != 0x80)
    assert [chars[int(p)] for p in [*place[starts], place[-1]]] == offsets


def test_longest_rule_wins():
    normalizer = library({"norm_map": [("ab", "X"), ("abc", "YZ"), ("c", "")]}, add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=False)
    rules = pieces.rules_of(spec_of(normalizer))
    norm, place = pieces.normalise(np.frombuffer(b"ababccab", np.uint8), rules)
    assert norm.tobytes() == b"XYZX" and place.tolist() == [0, 2, 2, 6, 8]


def test_empty_table(spark, docs):
    assert pieces.encode(docs([])).count() == 0
