import random

import pytest

from rostrum.llm import graph, neardup


def sets(text, n=5):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)} if len(ws) >= n else {tuple(ws)} if ws else set()


def brute(rows):
    own = {i: sets(t) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = own[a], own[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(own[i]), find(i)) for i in ids}


def check(df, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def family(rng, size, edits, words=160):
    """An original, placed last, and copies that are similar to it more than to each other."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return [*out, " ".join(base)]


def test_components_are_those_of_brute_force(spark, docs, clashing, monkeypatch):
    rng = random.Random(5)
    texts = ["", None, "  ", "one two", "One TWO", "one two three four five", "one two three four five six"]
    texts += family(rng, 40, 4) + family(rng, 12, 9) + family(rng, 25, 6)
    texts += [texts[-1]] * 5
    chain = [f"c{k}" for k in range(120)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 20, 5)]
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    check(clashing(docs(dict(rows))), rows)


def test_null_and_repeated_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (3, text), (3, text), (7, text), (8, "x y z")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [
        (3, 3, True), (3, 3, True), (7, 3, False), (8, 8, True),
    ]
    assert [(r.component_id, r.kept, r.n_shingles) for r in got if r.doc_id is None] == [(None, True, 26)]


def test_empty_table(docs):
    assert neardup.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("links", [[], [(1, 2), (2, 3), (3, 4), (9, 4), (6, 5)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)]])
def test_graph_components(spark, links):
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {}
    for a, b in links:
        group = {want.get(a, a), want.get(b, b)}
        least = min(group)
        want.setdefault(a, a), want.setdefault(b, b)
        want = {k: least if v in group else v for k, v in want.items()}
    assert got == want
