"""Stance hits are found where the sentences are: no token is shuffled."""

from pyspark.sql import functions as F

from rostrum.operators import annotate, stance

LEXICON = [
    ("positive", "ADJ", "notable"), ("positive", "ADJ", "notable"), ("certainty", "ADV", "surely"),
    ("pro", "VERB", "needed"), ("doubt", None, "it may"), ("hedge", "", "may be so"), ("emphatic", "NOUN", "so"),
]
TEXTS = [
    "It may be so. It is not notable, not surely needed, non-notable.",
    "so It may be so it may may be so", "", "Not needed. Surely not.", "1 a1 İt Ünotable  ΑΣ x.\tit\tmay",
]


def sents(spark, ids=(1, 2, 3, 4, 5)):
    docs = spark.createDataFrame(list(zip(ids, TEXTS)), "id long, text string")
    return annotate.sentences(docs)


def lexicon(spark):
    return spark.createDataFrame(LEXICON, "category string, pos string, entry string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_tags_in_rows_are_those_of_the_token_table(spark):
    for ids in ((1, 2, 3, 4, 5), (1, 1, 1, None, None)):
        s = sents(spark, ids)
        toks = annotate.tokens(s)
        for fields in (annotate.ARRAY_FIELDS, ("i", "text", "lemma", "pos"), ("i", "text"), ("i", "text", "ws")):
            want = annotate.sentence_arrays(toks, fields=fields)
            assert rows(annotate.gathered(s, fields=fields)) == rows(want)
        one = annotate.tagged(s).select("id", "sent_i", F.inline("tokens"))
        assert rows(one) == rows(toks.select(one.columns))


def test_hits_in_rows_are_those_of_the_joins(spark):
    s = annotate.gathered(sents(spark))
    toks = annotate.tokens(sents(spark))
    want = stance.word_hits(toks, lexicon(spark)).unionByName(stance.phrase_hits(s, lexicon(spark)))
    want = want.unionByName(stance.negation_hits(s, lexicon(spark)))
    got = stance.all_hits(s, None, lexicon(spark))
    assert rows(got) == rows(want) and {r.kind for r in got.collect()} == {"word", "phrase", "negation"}
    features = [("positive", "ADJ"), ("negative", "ADJ"), ("doubt", ""), ("hedge", ""), ("emphatic", "NOUN")]
    in_rows = stance.vectors(stance.with_hits(s, lexicon(spark)), None, features)
    assert rows(in_rows) == rows(stance.vectors(s, want, features))


def test_no_token_is_shuffled(spark):
    s = annotate.tagged(sents(spark))
    for out in (
        stance.phrase_hits(s, lexicon(spark)),
        stance.word_hits(s.select("id", "sent_i", F.inline("tokens")), lexicon(spark)),
        stance.vectors(stance.with_hits(s, lexicon(spark)), None, [("doubt", "")]),
    ):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "Aggregate" not in plan


def test_odd_characters_are_tagged_as_in_the_token_table(spark):
    # Some of these have a lower case that is a letter, though the pattern of words does not know them.
    odd = "Ɤ Ƛ Ⓐ ⓐs Ⅷ ½ x12 12x a_s news Glass US thes K İS ẞs ªs $ - – _ \U0001f600"
    s = annotate.sentences(spark.createDataFrame([(1, odd), (2, "It is not news. Cats were seen quickly")], "id long, text string"))
    toks = annotate.tokens(s)
    for fields in (annotate.ARRAY_FIELDS, ("i", "text", "lemma", "pos"), ("i", "lemma"), ("i", "is_punct")):
        got = annotate.tagged(s, fields=fields).select("id", "sent_i", F.inline("tokens"))
        assert rows(got) == rows(toks.select(got.columns))
