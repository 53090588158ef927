import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from rostrum.llm import arrow

TEXT = st.text(st.sampled_from("aAbZ é東\t\n\r\x0b\x0c\x1c.,"), max_size=40)


def plain(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def folded(w):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in w)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 60))
def test_words_are_those_of_the_pattern(texts, most):
    names, seen = {}, 0
    for w in arrow.words(pa.array(texts, pa.string()), most=most):
        bounds = w.bounds
        for r in range(w.last - w.first):
            want = plain(texts[w.first + r])
            at = range(bounds[r], bounds[r + 1])
            assert [w.text(k).decode() for k in at] == want
            for k, x in zip(at, want):
                assert names.setdefault(folded(x), w.hashes[k]) == w.hashes[k]
        seen += w.last - w.first
    assert seen == len(texts)
    assert len(set(names.values())) == len(names)


def test_long_words_and_texts_beyond_a_window(monkeypatch):
    text = "x" * 50 + " " + "ab " * 40 + "y" * 17 + " " + "x" * 50
    whole = next(iter(arrow.words(pa.array([text])))).hashes
    monkeypatch.setattr(arrow, "WINDOW_BYTES", 16)
    assert (next(iter(arrow.words(pa.array([text])))).hashes == whole).all()
    assert whole[0] == whole[-1] and whole[1] == whole[2] != whole[0]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=6))
def test_shingles_equal_where_word_runs_are_equal(texts):
    (w,) = list(arrow.words(pa.array(texts, pa.string()))) or [None]
    if w is None:
        return
    hashes, ends = arrow.shingles(w, 3)
    names = {}
    for r, t in enumerate(texts):
        ws = plain(t)
        want = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)] if len(ws) >= 3 else [tuple(ws)] * bool(ws)
        got = hashes[ends[r] : ends[r + 1]]
        assert len(got) == len(want)
        for g, x in zip(got, want):
            assert names.setdefault(x, g) == g
    assert len(set(names.values())) == len(names)


def test_ragged():
    assert arrow.ragged(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
