"""Language ID, language model, quality by perplexity, robust outliers."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rostrum.llm import kneser, langid, outliers, quality

FOLDER = "/root/testdata/sf0.01"
have = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


# --- language ID ---------------------------------------------------------------------


def test_bundle_is_the_sum_of_bound_letters():
    found, letters = langid.bundles(["ab", None, "", "12 !", "Ab, b"], 64)
    v = lambda c: langid._letter(ord(c) if c else 0, 64).astype(int)
    gram = lambda a, b, c: np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    one = gram("", "a", "b") + gram("a", "b", "")
    assert (found[0] == one).all() and (found[1:4] == 0).all()
    assert (found[4] == one + gram("", "b", "")).all()
    assert letters.tolist() == [2, 0, 0, 0, 3]


def test_many_letters_are_counted_in_parts(monkeypatch):
    texts = ["".join(chr(0x4E00 + 7 * k) for k in range(9000)), "abc"]
    whole = langid.bundles(texts, 32)[0]
    monkeypatch.setattr(langid, "CELLS", 5000)
    assert (langid.bundles(texts, 32)[0] == whole).all()
    assert (langid.bundles(texts[1:], 32)[0][0] == whole[1]).all()


@have
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    out = langid.op9_language_id(spark, FOLDER).join(docs, "doc_id").filter("held_out")
    n, right = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 150 and right / n > 0.97


def test_language_edge_cases(docs, clashing):
    rows = docs(["the cat sat", "der hund lief", None, "", "123", "the dog"], lang={1: "de", 3: None, 5: None})
    profiles = langid.learn(rows)
    assert profiles.languages == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(clashing(rows), profiles).collect()}
    assert got[0][0] == "en" and got[1][0] == "de" and got[5][0] == "en"
    assert [got[k] for k in (2, 3, 4)] == [("und", 0.0)] * 3
    assert {r.doc_id for r in langid.reject(rows, profiles).collect()} == {0, 1, 5}
    nothing = langid.learn(docs([]))
    assert {r.lang_pred for r in langid.predict(rows, nothing).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.learn(rows, most_languages=1)


# --- language model --------------------------------------------------------------------


def tokens(text):
    fold = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", fold), "</s>"]


class Brute:
    """The same model in dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            ts = tokens(t)
            self.words.update(ts)
            self.pairs.update(zip(["<s>", *ts], ts))
        self.follow, self.context = defaultdict(Counter), Counter()
        self.kinds = Counter()
        for (a, b), n in self.pairs.items():
            self.context[a] += n
            self.follow[a][min(n, 3)] += 1
            self.kinds[b] += 1
        of = lambda c: [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        self.d, self.e = kneser.discounts(*of(self.pairs)), kneser.discounts(*of(self.kinds))

    def lower(self, w):
        left = sum(self.e[min(n, 3) - 1] for n in self.kinds.values())
        n = self.kinds[w]
        own = n - self.e[min(n, 3) - 1] if n else 0
        return (own + left / (len(self.words) + 1)) / len(self.pairs)

    def chance(self, a, b):
        if not self.context[a]:
            return self.lower(b)
        n = self.pairs[a, b]
        own = n - self.d[min(n, 3) - 1] if n else 0
        rest = sum(self.d[k - 1] * m for k, m in self.follow[a].items())
        return (own + rest * self.lower(b)) / self.context[a]

    def score(self, text):
        ts = tokens(text)
        return sum(math.log10(self.chance(a, b)) for a, b in zip(["<s>", *ts], ts))

    def base(self, text):
        n, v = sum(self.words.values()), len(self.words)
        return sum(math.log10((self.words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(text))


TRAIN = ["the cat sat on the mat", "The cat ran", "a dog sat on a log", None, "", "the cat sat on the mat", "on the log the cat sat"] + [
    f"the w{k % 7} sat on w{k % 5} w{k}" for k in range(60)
]
OTHER = ["the cat sat", "unseen words here", "", None, "THE dog w3 zzz"]


def test_probabilities_add_up():
    b = Brute(TRAIN)
    for a in ("<s>", "the", "never", "w3"):
        assert math.isclose(sum(b.chance(a, w) for w in b.words) + b.chance(a, "?"), 1, rel_tol=1e-12)


def test_scores_are_those_of_brute_force(spark, docs, clashing, monkeypatch):
    monkeypatch.setattr(kneser, "HELD_PAIRS", 20)
    model = kneser.train(docs(TRAIN), shards=5)
    b = Brute(TRAIN)
    assert (model.tokens, model.words, model.kinds) == (sum(b.words.values()), len(b.words), len(b.pairs))
    got = {r.doc_id: r for r in kneser.score(clashing(docs(TRAIN + OTHER)), model).collect()}
    for i, t in enumerate(TRAIN + OTHER):
        ts = tokens(t)
        assert (got[i].n_tokens, got[i].n_known) == (len(ts), sum(b.words[x] > 0 for x in ts))
        assert math.isclose(got[i].score, b.score(t), rel_tol=1e-9)
        assert math.isclose(got[i].base_score, b.base(t), rel_tol=1e-9)


def test_hot_words_are_spread_without_changing_counts(spark, docs):
    texts = [f"hot w{k} hot" for k in range(300)]
    model = kneser.train(docs(texts), shards=4)
    b = Brute(texts)
    got = {r.doc_id: r.score for r in kneser.score(docs(texts[:5] + ["hot hot"]), model).collect()}
    assert all(math.isclose(got[i], b.score(t), rel_tol=1e-9) for i, t in enumerate(texts[:5] + ["hot hot"]))


def test_model_of_nothing(docs):
    model = kneser.train(docs([]))
    assert [r.score for r in kneser.score(docs(["a b", None]), model).collect()] == [0.0, 0.0]
    assert kneser.score(docs([]), model).count() == 0


def test_folder_must_be_mounted(docs):
    with pytest.raises(ValueError):
        kneser.train(docs(["a"]), path="hdfs://x/y")


@have
def test_model_beats_the_base_on_held_out_texts(spark):
    row = kneser.op6_lm_scores(spark, FOLDER).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert row[0] > row[1]


# --- quality by perplexity ---------------------------------------------------------------


@have
def test_good_documents_are_kept_and_junk_goes(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = quality.op3_quality_classifier(spark, FOLDER).join(labels, "doc_id")
    kept = {r.quality: r.share for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.97 and kept[0] < 0.5


def test_quality_edge_cases(spark, docs, clashing):
    rows = clashing(docs(TRAIN + OTHER, lang={3: None}))
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge(rows, none).filter("kept").count() == len(TRAIN + OTHER)
    some = spark.createDataFrame([(k % 60,) for k in range(80)] + [(None,)], "doc_id long")
    assert quality.judge(rows, some, least=2).filter("kept is null").count() == 0
    assert quality.judge(docs([]), some).count() == 0


# --- robust outliers ----------------------------------------------------------------------


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_base_statistics(docs, clashing):
    texts = [
        None, "", "\n\n", "a b c a b c", "x y\nx y\n x y\nx y", "é# 東|\n%\n%", "a a a a a", "one two three", "p q r s p q t p q r",
        "same line\nother\nsame line", "same line", "a\tb\x0bc\rd\n", "tail\n\ntail",
    ]
    got = {r.id: r for r in outliers.statistics(clashing(docs(texts)).withColumnRenamed("id", "id2")).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in STATS) == base(t), t


@have
def test_base_statistics_of_real_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200).collect()}
    for r in outliers.statistics(spark.read.parquet(f"{FOLDER}/documents.parquet")).collect():
        if r.id in texts:
            assert tuple(r[c] for c in STATS) == base(texts[r.id])


def test_chi_square():
    assert math.isclose(outliers.chi_square(2.0, 2), 1 - math.exp(-1), rel_tol=1e-12)
    assert math.isclose(outliers.chi_square_point(0.95, 5), 11.0705, abs_tol=1e-3)


def test_estimate_stands_up_to_a_third_of_outliers():
    rng = np.random.default_rng(3)
    good = rng.normal(size=(400, 5)) * [1, 0.5, 0.3, 0.6, 0.5]
    bad = rng.normal(size=(90, 5)) * 0.05 + 6
    rows = outliers.concentrate(np.concatenate([bad, good]))
    assert rows.min() >= 90


@have
def test_verdicts_keep_good_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = outliers.op7_quality_outliers(spark, FOLDER).join(labels, "doc_id").filter("not base_failed")
    kept = {r.quality: r.share for r in out.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert kept[1] > 0.98 and kept[0] < 0.7
    assert out.filter("kept is null").count() == 0


def test_outlier_edge_cases(docs):
    assert outliers.judge(outliers.statistics(docs([]))).count() == 0
    texts = [" ".join(f"w{k}x{j}" for j in range(60 + k)) for k in range(8)] + [None, "short"]
    out = outliers.judge(outliers.statistics(docs(texts, lang={0: None}, source={1: None}))).collect()
    assert {r.id for r in out if r.kept} == set(range(8))  # too few to estimate: the base rule alone


def test_an_outlier_in_one_statistic_is_rejected(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 6)))
    line = lambda n: " ".join(word() + str(rng.randrange(10**4)) for _ in range(n))
    text = lambda lines=20, n=10: "\n".join(line(n) for _ in range(lines))
    normal = [text(rng.randint(17, 23)) for _ in range(200)]
    repeat = line(10)
    odd = [
        text(400), " ".join(w * 3 for w in text().split()), text().replace("a", "##"),
        "\n".join(f"{line(10)}\nReply" for _ in range(20)), text(11) + "\n" + " ".join([repeat] * 9),
    ]
    rows = [(k, t, "en", "s") for k, t in enumerate(normal + odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = {r.id: r for r in outliers.judge(outliers.statistics(docs)).collect()}
    assert [out[200 + k].kept for k in range(5)] == [False] * 5
    assert not any(out[200 + k].base_failed for k in range(5))
    assert sum(out[k].kept for k in range(200)) >= 199
