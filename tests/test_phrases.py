"""Phrases are found from their rarest token, and all of them."""

import itertools
import random

from pyspark.sql import functions as F

from rostrum.operators import gazetteer, phrases, stance

SENTS = "id string, sent_i int, tokens array<struct<i int, text string, lemma string>>"


def sentences(spark, texts):
    rows = [(str(k), 0, [(i, w.upper(), w) for i, w in enumerate(t.split())]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SENTS)


def entry_table(spark, entries):
    return spark.createDataFrame([(e.split(), (e,)) for e in entries], "words array<string>, payload struct<entry string>")


def brute(texts, entries):
    out = []
    for k, t in enumerate(texts):
        words = t.split()
        for e in set(entries):
            n = len(e.split())
            out += [(str(k), s, s + n, e) for s in range(len(words) - n + 1) if n and words[s : s + n] == e.split()]
    return sorted(out)


def found(spark, texts, entries, counted):
    sents, table = sentences(spark, texts), entry_table(spark, entries)
    counts = phrases.token_counts(sents, "lemma", table) if counted else None
    hits = phrases.find(sents, "lemma", phrases.parts(table, counts))
    return sorted((r.id, r.start, r.end, r.payload.entry) for r in hits.collect())


def test_equals_brute_force(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "aa", "d"]
    texts = [" ".join(rng.choices(words, weights=[9, 4, 2, 1, 1], k=rng.randint(0, 14))) for _ in range(60)]
    entries = [" ".join(p) for n in (1, 2, 3) for p in itertools.product(words, repeat=n) if rng.random() < 0.3]
    entries += ["a a a a", "a b a b a", "c d zz", "zz", entries[0]]
    want = brute(texts, entries)
    assert len(want) > 300
    assert found(spark, texts, entries, False) == want
    assert found(spark, texts, entries, True) == want


def test_rarest_token_is_the_anchor(spark):
    table = entry_table(spark, ["of the bank", "of the river", "of the"])
    assert {r.anchor for r in phrases.parts(table).collect()} == {"bank", "river", "the"}
    counts = spark.createDataFrame([("bank", 90), ("of", 5), ("the", 50)], "token string, n long")
    got = {(r.anchor, r["at"], r.depth) for r in phrases.parts(table, counts).collect()}
    assert got == {("of", 0, 3), ("river", 2, 3)}


def test_no_entries_no_tokens_and_nulls(spark):
    sents = sentences(spark, ["a b", ""])
    assert phrases.find(sents, "lemma", phrases.parts(entry_table(spark, []))).count() == 0
    assert phrases.find(sents, "lemma", phrases.parts(entry_table(spark, [""]))).count() == 0
    rows = [("1", 0, None), (None, 0, [(0, "A", None), (1, "B", "b"), (2, None, "c")])]
    odd = spark.createDataFrame(rows, SENTS)
    hits = phrases.find(odd, "lemma", phrases.parts(entry_table(spark, ["b c", "c"]))).collect()
    assert sorted((r.start, r.end) for r in hits) == [(1, 3), (2, 3)]


def test_longest_terms_without_overlap(spark):
    sents = sentences(spark, ["x new york city hall y new york"])
    rows = [("lemmatized", e) for e in ("new york", "york city hall", "city", "hall y")] + [("exact", "NEW YORK CITY")]
    terms = spark.createDataFrame(rows, "kind string, entry string")
    for counted in (False, True):
        got = gazetteer.match_phrases(sents, terms, counted=counted).collect()
        assert sorted((r.start, r.end, r.entry, r.text, r.first_lemma) for r in got) == [
            (1, 4, "NEW YORK CITY", "NEW YORK CITY", "new"), (4, 6, "hall y", "HALL Y", "hall"), (6, 8, "new york", "NEW YORK", "new"),
        ]


def test_sentences_are_read_once_and_not_shuffled(spark):
    sents = sentences(spark, ["a b c"])
    lexicon = spark.createDataFrame([("pro", "VERB", "a b"), ("con", None, "b c"), ("con", "ADJ", "word")], "category string, pos string, entry string")
    hits = stance.phrase_hits(sents, lexicon)
    assert sorted((r.category, r.pos, r.start, r.end) for r in hits.collect()) == [("con", "", 1, 3), ("pro", "VERB", 0, 2)]
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("tokens#") and plan.count("LogicalRDD [id#") == 1
