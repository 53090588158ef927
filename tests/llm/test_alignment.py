import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from rostrum.llm import alignment

TEXTS = [
    "Hello world, it's 1234!", "naïve café 東京 \U0001F600 ½", "<|endoftext|> </s> <unk> <0x41>", None, "", " ", "  \t\n x  y ",
    "a▁b", "word " * 500 + "w" * 2100, "é́ᄀ ﬁ x" * 3, "Hello world, Hello", "    z\x00\x1c q", "x" * 30 + " " + "ab" * 90, " " * 2500 + "a",
]


@pytest.fixture(scope="module")
def tools():
    a, b, _ = alignment.default_vocabularies()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=b)


def ranges(tokens):
    out, at = [], 0
    for k, data in tokens:
        out.append((k, at, at + len(data)))
        at += len(data)
    return out


def brute(tools, texts):
    """Every pair of tokens of a text compared."""
    t, sp = tools
    letters = alignment._byte_letters()
    docs, counts = {}, Counter()
    for i, text in enumerate(texts):
        want = (" " + (text or "")).encode()
        a = [(k, bytes(letters[c] for c in t.id_to_token(k))) for k in t.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(k, bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()) for k in sp.encode(text or "")]
        if not text or b"".join(d for _, d in a) != want or b"".join(d for _, d in b) != want:
            docs[i] = None
            continue
        a, b = ranges(a), ranges(b)
        links = [(x, y) for x, p, q in a for y, r, s in b if p < s and r < q]
        cuts = sorted({q for _, _, q in a} & {s for _, _, s in b})
        groups = [
            ",".join(str(k) for k, _, q in a if low < q <= high) + "|" + ",".join(str(k) for k, _, s in b if low < s <= high)
            for low, high in zip([0, *cuts], cuts)
        ]
        docs[i] = (len(a), len(b), groups, links)
        counts.update(links)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = {}
    for i, d in docs.items():
        if d is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
        else:
            na, nb, groups, links = d
            sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out[i] = (na, nb, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), sha)
    return out


def rows_of(found):
    return {r[0]: tuple(r)[1:] for r in found.collect()}


def test_query_equals_brute_force(spark, docs, tools, tmp_path):
    docs(TEXTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows_of(alignment.op11_token_alignment(spark, str(tmp_path)))
    want = brute(tools, TEXTS)
    for i in want:
        assert got[i] == want[i], TEXTS[i]
    assert want[7][0] == 0 and want[0][0] > 0 and len(got) == len(TEXTS)


def test_small_tables_of_windows_and_blocks(spark, docs, tools, tmp_path, monkeypatch):
    # The constants of the workers' module: run in this process.
    monkeypatch.setattr(alignment, "KEPT_WINDOWS", 3)
    pair = alignment.Pair(*alignment.default_vocabularies())
    for text in filter(None, TEXTS):
        s = alignment.Slice(pair, [text, "Hello world", "", text])
        want = brute(tools, [text])[0]
        assert (s.n_a[0], s.n_b[0], s.n_groups[0], s.n_links[0]) == want[:4]
        assert [s.texts[0]] == [s.texts[3]] and (not want[0] or hashlib.sha256(s.texts[0].encode()).hexdigest() == want[6])
        assert s.n_a[2] == 0 and s.texts[2] == ""


def test_blocks_are_summed(spark, docs, tools, tmp_path):
    """Repeated rows over several partitions, each a block of its own."""
    texts = ["Hello world, hello", "a▁b", "hello world"] * 20
    docs(texts).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows_of(alignment.op11_token_alignment(spark, str(tmp_path))) == brute(tools, texts)


def test_faster_library_gives_the_same_ids():
    pair = alignment.Pair(*alignment.default_vocabularies())
    slow = alignment.Pair(*alignment.default_vocabularies()[:2], None)
    texts = [t for t in TEXTS if t] + ["it's we'LL 's 12ab ñandú Ünï ЖЙ ΩΣ 日本語 한국어 “q” – … €5\r\n\r\n  x\t\ty"]
    assert [list(x) for x in pair.encode_a(texts)] == [list(x) for x in slow.encode_a(texts)]


def test_empty_nulls_and_clashing_columns(spark, docs, clashing):
    size = len(alignment._pair(*alignment.default_vocabularies()).b.sizes)
    assert alignment.with_counts(alignment.align(docs([])), size).count() == 0
    rows = clashing(docs([None, "", "some text"]))
    got = {r.id: r for r in alignment.with_counts(alignment.align(rows), size).collect()}
    assert len(got) == 3 and got[0].n_links == 0 and got[1].n_a == 0 and got[2].n_links > 0
