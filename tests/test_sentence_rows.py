"""Neutral texts are made in the rows of the sentences: tokens are not shuffled."""

import pytest

from rostrum.operators import annotate, anonymize

TEXTS = [
    "It is quickly done. Cats  were seen\tquickly, they said!", "quickly\nquickly so", "", None,
    "The quickly 12 x. The motion is\nslowly", "1 2 3. !",
]
POOLS = {"ADV": ["now", "then", "soon"], "NOUN": ["thing"]}


def sents(spark, ids):
    docs = spark.createDataFrame(list(zip(ids, TEXTS)), "id long, text string")
    return annotate.sentences(docs)


def rows(df):
    return sorted(map(str, df.collect()))


def exchanged(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


@pytest.mark.parametrize("ids", [(1, 2, 3, 4, 5, 6), (1, 1, 1, None, None, 2)])
def test_neutral_texts_of_token_arrays(spark, ids):
    s = sents(spark, ids)
    want = anonymize.neutralize(annotate.tokens(s), ["quickly", "slowly", "motion"], POOLS)
    got = anonymize.neutralize(annotate.gathered(s), ["quickly", "slowly", "motion"], POOLS)
    assert rows(got) == rows(want)


def test_only_sentences_are_shuffled(spark):
    s = sents(spark, (1, 2, 3, 4, 5, 6))
    assert exchanged(anonymize.neutralize(annotate.tagged(s), ["quickly"], POOLS)) == 1
