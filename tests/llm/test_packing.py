import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from rostrum.llm import packing

TEXTS = [
    "Don't stop, it's 1234 o'clock!", "İSTANBUL ΣΑΣ naïve café ﬁ ½ x² 東京", "<|endoftext|> </w> &amp; ___", "a <|endoftext|> b<|startoftext|><|ENDOFTEXT|>c<|end <|endoftext|", None, "", "  \t\n",
    "áb é x y", "word " * 5000, "a" * 3000, "ß ẞ ǅ µ × ÷ \x00\x1f \x7f",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def test_pieces_are_the_binary_digits():
    for n in [*range(1, 70), 2047, 2048, 2049, 6145]:
        cuts = packing.pieces(n)
        assert sum(cuts) == n and all(c & (c - 1) == 0 for c in cuts)
        assert cuts == sorted(cuts, reverse=True) and len([c for c in cuts if c < 2048]) == len({c for c in cuts if c < 2048})


def test_exact_round_trip(spark, docs, clashing, tokenizer):
    rows = clashing(docs(TEXTS + TEXTS[:1]))
    got = packing.pack(rows).toPandas().sort_values(["doc_id", "start"])
    for i, text in enumerate(TEXTS + TEXTS[:1]):
        own = got[got.doc_id == i]
        ids = [x for part in own.ids for x in part]
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        assert own.start.tolist() == np.concatenate([[0], np.cumsum(own.length)[:-1]]).tolist()
        assert (own.doc_tokens == len(ids)).all() and (own.offset == 0).all()
        assert [zlib.crc32(np.array(x, "<u4")) for x in own.ids] == own.ids_crc32.tolist()
        assert [len(x) for x in own.ids] == own.length.tolist()
    assert got.sequence_id.is_unique and (got.length <= 2048).all()


def test_table_of_words_starts_anew(monkeypatch, spark, docs, tokenizer):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    table = packing.WordIds(packing.default_vocabulary())
    import pyarrow as pa

    from rostrum.llm import arrow

    for text in ("one two three", "four five one", "one, two. three", "x<|endoftext|>y"):
        (w,) = arrow.words(pa.array([text]), fold=False)
        assert table.look_up(w)[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_empty_table(spark, docs):
    assert packing.pack(docs([])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs([]), length=100)
