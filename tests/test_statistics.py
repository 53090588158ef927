import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from rostrum.functions import tails
from rostrum.operators import attribution, evaluate, stats, terms


@pytest.mark.parametrize(
    "got, want",
    [
        (tails.t_two_sided(2.228, 10), 0.05), (tails.t_two_sided(12.706, 1), 0.05),
        (tails.t_two_sided(2.576, 1e6), 0.01), (tails.t_two_sided(0.0, 5), 1.0),
        (tails.chi2_tail(3.841, 1), 0.05), (tails.chi2_tail(10.828, 1), 0.001),
        (tails.chi2_tail(5.991, 2), 0.05), (tails.chi2_tail(18.307, 10), 0.05),
        (tails.normal_two_sided(1.959964), 0.05),
    ],
)
def test_tails_against_tables(got, want):
    assert got == pytest.approx(want, rel=2e-3)


def test_chi2_critical_inverts_the_tail():
    assert tails.chi2_critical(0.001) == pytest.approx(10.8276, abs=1e-4)


def test_t_column(spark):
    df = spark.createDataFrame([(2.228, 10.0), (None, 3.0)], "t double, df double")
    a, b = [r[0] for r in df.select(tails.t_p(F.col("t"), F.col("df"))).collect()]
    assert a == pytest.approx(0.05, rel=1e-3) and b is None


def test_corrections_are_monotone_and_handle_ties(spark):
    p = [0.001, 0.01, 0.01, 0.04, 0.5, 0.9]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    out = sorted(stats.correct(df).collect(), key=lambda r: r.i)
    m = len(p)
    want = [min([1.0] + [p[k] * m / (k + 1) for k in range(j, m)]) for j in range(m)]
    want[1] = want[2]
    assert [r.bh for r in out] == pytest.approx(want)
    assert [r.bonferroni for r in out] == pytest.approx([min(1.0, x * m) for x in p])
    assert [r.reject_bh for r in out] == [True, True, True, False, False, False]


def test_empty_array_has_no_mean(spark):
    from rostrum.operators.features import array_mean

    df = spark.createDataFrame([([1, 2],), ([],)], "x array<int>")
    assert [r[0] for r in df.select(array_mean("x")).collect()] == [1.5, None]


def test_mode_takes_the_lowest_of_the_most_frequent(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (3, 3, 1, 1, 2)], "k string, x double")
    row = stats.describe_by(df, "k", ["x"]).first()
    assert (row["mode"], row["median"], row["n"]) == (1.0, 2.0, 5)


def test_yates_of_one_sided_table_is_zero(spark):
    df = spark.createDataFrame([(["a"], 1, [1, 0]), (["a"], 0, [1, 1])], "n array<string>, y int, v array<int>")
    out = {r.frame_index: r.statistic for r in stats.frame_bias(df, "y", 1, "v").collect()}
    assert out[0] == 0.0


def test_term_bias_counts_a_missing_term_as_zero(spark):
    a = spark.createDataFrame([("x", 100), ("y", 900)], "term string, n long")
    b = spark.createDataFrame([("y", 1000)], "term string, n long")
    out = {r.term: r for r in stats.term_bias(a, b, ("one", "two")).collect()}
    assert out["x"].biased_class == "one" and out["x"].frequency == 100
    assert out["y"].biased_class == "two" and out["x"].p < 0.001


def test_subsequence_counts_against_enumeration(spark):
    rnd = random.Random(5)
    for size in (3, 4):
        names = [rnd.choice("abc") for _ in range(12)]
        want = {}
        for t in combinations(names, size):
            want[t] = want.get(t, 0) + 1
        assert dict(terms.subsequence_counts(names, size)) == want
    df = spark.createDataFrame([("l", ["a", "b", "c", "d"]), ("l", ["a"])], "label string, frames array<string>")
    out = {r.frames: r.n for r in terms.frame_combinations(df, 4).collect()}
    assert out == {"a + b + c + d": 1}


def auc(pairs):
    pos = [s for y, s in pairs if y]
    neg = [s for y, s in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_with_ties(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(2), rnd.randrange(9) / 9) for _ in range(150)]
    df = spark.createDataFrame(pairs, "label int, score double")
    assert evaluate.roc_auc(df, 1).first().auc == pytest.approx(auc(pairs))
    flat = df.withColumn("score", F.lit(0.3))
    assert evaluate.roc_auc(flat, 1).first().auc == pytest.approx(0.5)


def test_metrics_with_unpredicted_class(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("a", "a")], "label string, predicted string")
    out = {r["class"]: r for r in evaluate.class_metrics(df).collect()}
    assert out["b"].precision == 0.0 and out["b"].recall == 0.0 and out["a"].recall == 1.0
    assert evaluate.matthews(df).first().mcc == 0.0
    assert evaluate.summary_metrics(df).first().accuracy == pytest.approx(2 / 3)


def test_decide_drops_ties(spark):
    df = spark.createDataFrame([(1, 0.7, 0.3), (2, 0.5, 0.5), (3, 0.1, 0.9)], "id int, p double, q double")
    out = evaluate.decide(df, {"p": "support", "q": "oppose"}).collect()
    assert [(r.id, r.predicted) for r in out] == [(3, "oppose"), (1, "support")]


def test_signed_words(spark):
    rows = [("x", 0, "good", 0.5), ("x", 1, "!", 0.9), ("x", 2, "bad", -0.2), ("x", 3, "worse", -0.7), ("x", 4, "best", 0.8)]
    df = spark.createDataFrame(rows, "id string, pos_i int, feature string, value double")
    r = attribution.signed_words(df).first()
    assert r.support_words == ["best", "good"] and r.oppose_words == ["worse", "bad"]


def test_jarque_bera_of_normal_sample(spark):
    rnd = random.Random(4)
    rows = [("n", rnd.gauss(0, 1), math.exp(rnd.gauss(0, 1))) for _ in range(800)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    out = {r.feature: r.normal for r in stats.jarque_bera(df, "k", ["x", "y"]).collect()}
    assert out["y"] is False and out["x"] is True


def test_ks_statistic_by_its_definition(spark):
    rng = random.Random(2)
    values = sorted(rng.expovariate(1.0) for _ in range(300))
    n, mean = len(values), sum(values) / len(values)
    sd = math.sqrt(sum((x - mean) ** 2 for x in values) / (n - 1))
    cdf = [(1 + math.erf((x - mean) / sd / math.sqrt(2))) / 2 for x in values]
    want = max(max((k + 1) / n - c, c - k / n) for k, c in enumerate(cdf))
    rows = [(c, x) for c in ("a", None) for x in values] + [("one", 3.0), ("same", 1.0), ("same", 1.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    got = {r.g: r for r in stats.ks_normality(df, "g", ["value"]).collect()}
    assert set(got) == {"a", None, "one", "same"}
    series = sum(2 * (-1) ** (k - 1) * math.exp(-2 * k * k * n * want * want) for k in range(1, 101))
    for c in ("a", None):
        assert got[c].statistic == pytest.approx(want, abs=1e-9) and got[c].n == n
        assert got[c].p == pytest.approx(min(1.0, series), abs=1e-9) and got[c].normal == (series > 0.05)
    assert got["one"].statistic is None and got["same"].p is None


def test_normal_law(spark):
    from pyspark.sql import functions as F

    zs = [-30.0, -8.0, -5.5, -1.0, 0.0, 0.3, 2.0, 6.0, 7.9, 40.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.normal_cdf(F.col("z")).alias("f")).collect()
    for r in rows:
        assert r.f == pytest.approx((1 + math.erf(r.z / math.sqrt(2))) / 2, abs=1e-12)


def test_step_up_of_a_large_family(spark):
    import random

    rng = random.Random(3)
    rows = [("big", i, rng.choice([0.0, 1.0, round(rng.random() ** 3, 3)])) for i in range(900)]
    rows += [(None, 1000 + i, 0.01 * (i + 1)) for i in range(5)] + [("big", 2000, None), ("none", 2001, None)]
    out = stats.correct(spark.createDataFrame(rows, "family string, i int, p double"), by=["family"])
    got = {r.i: r for r in out.collect()}
    assert len(got) == len(rows) and out.columns[:3] == ["family", "i", "p"]
    for family in ("big", None):
        known = sorted((r[2], r[1]) for r in rows if r[0] == family and r[2] is not None)
        best, m = 1.0, len(known)
        for rank in range(m, 0, -1):
            p, i = known[rank - 1]
            best = min(best, p * m / rank)
            assert got[i].bh == pytest.approx(best, abs=1e-12) and got[i].bonferroni == pytest.approx(min(1.0, p * m))
            assert got[i].reject_bh == (got[i].bh <= 0.05)
    assert got[2000].bh == got[2001].bonferroni == 1.0


def test_class_bias_is_term_bias_of_two_tables(spark):
    rows = [("x", f"t{k}", (k * 7) % 90 + 1) for k in range(30)] + [("y", f"t{k}", (k * 31) % 80 + 1) for k in range(5, 40)]
    freq = spark.createDataFrame([*rows, ("z", "t1", 5)], "label string, term string, n long")
    parts = [freq.filter(f"label = '{c}'").select("term", "n") for c in "xy"]
    one = {tuple(r) for r in stats.class_bias(freq, "label", ("x", "y"), with_p=False).collect()}
    assert one and one == {tuple(r) for r in stats.term_bias(*parts, ("x", "y"), with_p=False).collect()}


def test_lexical_classes_tell_words_from_subwords(spark):
    rows = [("oh", "INTJ", True, 1.0), ("wow", "INTJ", True, 2.0), ("nation", "NOUN", False, 4.0), ("he", "PRON", True, 8.0)]
    toks = spark.createDataFrame(
        [(t, t, p, p, v, x, False) for t, p, v, x in rows],
        "text string, lemma string, pos string, tag string, v boolean, value double, is_punct boolean",
    )
    out = attribution.lexical_classes(toks, interjections=["oh"], has_vector="v")
    got = {}
    for r in out.collect():
        got.setdefault(r.bucket, []).append(r.value)
    assert got["interjection"] == [1.0] and got["nominalization"] == [4.0]
    assert "lexical_word" not in got and sorted(got["word_length"]) == [2.0, 2.0, 3.0]
