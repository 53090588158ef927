"""Expensive values are made once a row: filters that the optimizer infers find them finished."""

import statistics
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from rostrum.catalog.statistics import vectors
from rostrum.functions import clean, fixed
from rostrum.operators import lookup, stats, topic


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def found(spark, pattern, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in rows.select(F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).collect()]


def test_contractions_are_asked_for_by_their_characters(spark):
    search, keys = clean.contraction_search(), list(fixed.CONTRACTIONS)
    # One branch for each first character, which is looked for ahead, in place of one for each word.
    assert search.count("I") == 2
    texts = [*keys, " ".join(keys), "x" + "x".join(keys), "éI've I'veé can'ts Cannot. we'rewe're", "It's-it's_it's", ""]
    assert found(spark, search, texts) == found(spark, clean.contraction_pattern(), texts)


@pytest.mark.parametrize("mapping", [{}, {"a": "1", "ab": "2"}, {"a.c": "1"}])
def test_other_words_are_alternatives(mapping):
    assert clean.contraction_search(mapping) == clean.contraction_pattern(mapping)


def test_vectors_cut_a_text_once(spark):
    docs = spark.createDataFrame([(1, "The the it"), (2, None), (3, ""), (None, "of")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 0), (None, 1)], "doc_id long, quality int")
    rows = vectors(SimpleNamespace(documents=docs, labels=labels))
    assert optimized(stats.frame_bias(rows, "quality", 1)).count("regexp_extract_all") == 1
    got = stats.frame_bias(rows, "quality", 1).collect()
    assert [(r.a, r.b, r.c, r.d) for r in got if r.frame_index == 0] == [(1, 0, 1, 1)]


def test_frame_lists_are_made_once_a_side(spark):
    docs = spark.createDataFrame([(1, "b a b"), (1, "b a b"), (None, "a"), (2, "c"), (3, None)], "id long, text string")
    frames = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("frame"), F.array(w).alias("denotations")))
    rules = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "name string")
    out = lookup.frame_rule_matches(docs.select("id", frames.alias("frames")), rules)
    assert optimized(out).count("array_distinct") == 2
    got = sorted((str(r.id), r.main_frame, tuple(r.matched_frames)) for r in out.collect())
    assert got == [("1", "b", ("a", "b")), ("1", "b", ("a", "b")), ("None", "a", ("a",))]


def test_main_topic_reads_the_tokens_once(spark):
    rows = [(i, d, k, dep, x) for i, d in ((1, 0), (1, 1), (None, 0)) for k, dep, x in (
        (0, "nsubj", "tax"), (1, "ROOT", "rise"), (2, "dobj", "tax"), (3, "dobj", None), (9, "dobj", "far"))]
    toks = spark.createDataFrame([*rows, (2, 0, 0, "nsubj", "tax")], "id long, sent_i int, i int, dep string, lemma string")
    issues = spark.createDataFrame(
        [(1, 0, "tax"), (1, 0, "tax"), (1, 1, "far"), (2, 0, "tax"), (None, 0, "tax")], "id long, sent_i int, issue string"
    )
    out = topic.main_topic(toks, issues, 3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 2
    assert [tuple(r) for r in out.collect()] == [(1, 0, "tax")]


def test_normal_law_standardizes_a_value_once(spark):
    df = spark.createDataFrame([("a", float(k * k)) for k in range(9)] + [("b", 1.0), ("c", None)], "g string, x double")
    out = stats.ks_normality(df, "g", ["x"])
    assert optimized(out).count(" - _mean#") == 1
    got = {r.g: (r.n, r.statistic and round(r.statistic, 9)) for r in out.collect()}
    values = [float(k * k) for k in range(9)]
    mean, sd = statistics.mean(values), statistics.stdev(values)
    law = [statistics.NormalDist(mean, sd).cdf(v) for v in values]
    gap = max(max((k + 1) / 9 - f, f - k / 9) for k, f in enumerate(law))
    assert got == {"a": (9, round(gap, 9)), "b": (1, None)}
