from pyspark.sql import functions as F

from rostrum.operators import annotate, anonymize, gazetteer, segment, spans, stance, topic

TOK = "id string, sent_i int, i int, text string, lemma string, pos string, dep string, head_i int"


def toks(spark, *sentences):
    """Sentences of ``text/lemma/pos[/dep/head]`` items."""
    rows = []
    for s, line in enumerate(sentences):
        for i, item in enumerate(line.split()):
            text, lemma, pos, dep, head = (item.split("/") + ["", "0"])[:5] if item.count("/") < 4 else item.split("/")
            rows.append(("d", s, i, text, lemma, pos, dep or None, int(head)))
    return spark.createDataFrame(rows, TOK)


def lexicon(spark, *rows):
    return spark.createDataFrame(list(rows), "category string, pos string, entry string")


def hit_set(df):
    return {(r.category, r.pos, r.start, r.end) for r in df.collect()}


def test_negation_is_crossed(spark):
    lex = lexicon(spark, ("positive", "ADJ", "clear"), ("certainty", "ADV", "fully"), ("pro", "VERB", "back"))
    t = toks(
        spark, "not/not/PART clear/clear/ADJ", "non/non/ADJ -/-/PUNCT clear/clear/ADJ",
        "not/not/PART fully/fully/ADV", "not/not/PART back/back/NOUN", "not/not/PART back/back/VERB",
    )
    got = {(r.sent_i, r.category, r.start, r.end) for r in stance.negation_hits(annotate.sentence_arrays(t), lex).collect()}
    assert got == {(0, "negative", 0, 2), (1, "negative", 0, 3), (2, "doubt", 0, 2), (4, "con", 0, 2)}


def test_two_phrases_give_one_value_per_token(spark):
    lex = lexicon(spark, ("emphatic", "ADV", "in fact"), ("emphatic", "ADV", "a lot"))
    t = toks(spark, "in/in/ADP fact/fact/NOUN ,/,/PUNCT we/we/PRON did/do/VERB a/a/DET lot/lot/NOUN")
    sents = annotate.sentence_arrays(t)
    vec = stance.vectors(sents, stance.all_hits(sents, t, lex), [("emphatic", "ADV")]).first()
    assert vec.emphatic_adv == [1, 1, 0, 0, 1, 1]


def test_words_only_leaves_phrases_out(spark):
    lex = lexicon(spark, ("hedge", "ADV", "a lot"), ("hedge", "ADV", "maybe"))
    t = toks(spark, "maybe/maybe/ADV a/a/DET lot/lot/NOUN")
    assert hit_set(stance.all_hits(annotate.sentence_arrays(t), t, lex, words_only=True)) == {("hedge", "ADV", 0, 1)}


def test_modals_match_any_class(spark):
    t = toks(spark, "we/we/PRON must/must/AUX have/have/VERB to/to/PART")
    lex = stance.modal_lexicon(spark)
    sents = annotate.sentence_arrays(t)
    assert hit_set(stance.all_hits(sents, t, lex)) == {("necessity_modal", "", 1, 2), ("necessity_modal", "", 2, 4)}


def test_constructions(spark):
    t = toks(
        spark, "we/we/PRON made/make/VERB a/a/DET commitment/commitment/NOUN",
        "raised/raise/VERB ,/,/PUNCT the/the/DET concern/concern/NOUN", "as/as/SCONJ I/I/PRON have/have/AUX said/say/VERB",
        "do/do/AUX fight/fight/VERB for/for/ADP it/it/PRON",
    )
    got = {(r.sent_i, r.category, r.pos, r.start, r.end) for r in stance.pattern_hits(annotate.sentence_arrays(t)).collect()}
    assert got == {
        (0, "pro", "VERB", 1, 4), (1, "con", "VERB", 0, 3), (2, "emphatic", "ADV", 0, 4),
        (3, "emphatic", "VERB", 0, 2), (3, "pro", "VERB", 1, 3),
    }


def test_binary_features(spark):
    df = spark.createDataFrame([([0, 1], [0, 0])], "a array<int>, b array<int>")
    assert stance.binary_features(df, {"x": ["a", "b"], "y": ["b"]}).first().asDict() == {"x": 1, "y": 0}


def test_longest_span_wins(spark):
    rows = [([(0, 2), (1, 4), (4, 5), (3, 5)],)]
    df = spark.createDataFrame(rows, "s array<struct<start:int,end:int>>")
    assert [tuple(x) for x in df.select(spans.longest_spans("s").alias("k")).first().k] == [(1, 4), (4, 5)]


def test_gazetteer_prefers_the_longer_term(spark):
    t = toks(spark, "health/health/NOUN care/care/NOUN costs/cost/NOUN taxes/tax/NOUN co/co/X -/-/PUNCT op/op/X")
    table = spark.createDataFrame(
        [("Taxes", "co-op", "health care"), ("", None, "care"), (None, "", "cost")],
        "exact string, hyphenated string, lemmatized string",
    )
    out = gazetteer.match_phrases(annotate.sentence_arrays(t), gazetteer.from_columns(table))
    assert {(r.start, r.end, r.entry) for r in out.collect()} == {(0, 2, "health care"), (2, 3, "cost"), (4, 7, "co-op")}
    names = spark.createDataFrame([("cost", "Q1", "Cost")], "entry string, qid string, name string")
    known = gazetteer.match_phrases(annotate.sentence_arrays(t), gazetteer.from_columns(table), names).collect()
    assert [(r.entry, r.qids) for r in known] == [("cost", ["Q1"])]


def test_anonymize_by_offset_and_extra_words(spark):
    docs = spark.createDataFrame([("1", "Ann met Ann in Rome, HIV"), ("2", "none")], "id string, text string")
    ents = spark.createDataFrame([("1", 0, 3, "PERSON"), ("1", 15, 19, "GPE"), ("1", 8, 11, "XX")], "id string, start int, end int, label string")
    out = {r.id: r.text for r in anonymize.anonymize(docs, ents, None, ["hiv"]).collect()}
    assert out == {"1": "PERSON met Ann in GPE, [ENTITY]", "2": "none"}


def test_spans_of(spark):
    df = spark.createDataFrame([("a1b22",), ("x",)], "t string")
    got = [[(e.start, e.end, e.text) for e in r[0]] for r in df.select(anonymize.spans_of("t", r"\d+", "N")).collect()]
    assert got == [[(1, 2, "1"), (3, 5, "22")], []]


def test_neutral_words_are_stable_and_keep_space(spark):
    sents = spark.createDataFrame([("1", 0, "We quickly  go."), ("1", 1, "Oh quickly")], "id string, sent_i int, sentence string")
    t = annotate.tokens(sents)
    one = anonymize.neutralize(t, ["quickly"], {"ADV": ["now"]}).first().text
    assert one == "We now  go.Oh now"


def test_coreference_at_the_boundary(spark):
    coref = spark.createDataFrame(
        [("p", 1, "Ann", 0), ("p", 1, "she", 5), ("p", 2, "x", 0), ("p", 2, "y", 1), ("p", 3, "It", 0), ("p", 3, "it", 6),
         ("p", 4, "last", 3), ("p", 4, "a", 0)],
        "id string, cluster_id int, text string, start int",
    )
    n1 = spark.createDataFrame([("p", 4)], "id string, n1 int")
    got = {r.cluster_id: [m.side for m in r.mentions] for r in topic.coreference_clusters(coref, n1).collect()}
    # 2 lies in the first member, 3 repeats one text; 4 has a mention on the boundary token.
    assert got == {1: [1, 2], 4: [1, 2]}


def pair_toks(spark, a, b):
    return toks(spark, "-/-/-", a, b).filter("sent_i > 0").withColumnRenamed("sent_i", "side")


def test_rules_and_classifier(spark):
    t = pair_toks(
        spark, "Taxes/tax/NOUN rise/rise/VERB/ROOT/1 fast/fast/ADV/advmod/1",
        "But/but/CCONJ tax/tax/NOUN is/be/AUX rise/rise/VERB/ROOT/3 fast/fast/ADV/advmod/3",
    )
    lexical = {(r.s1_word, r.s1_i, r.s2_i) for r in topic.lexical_links(t).collect()}
    assert lexical == {("tax", 0, 1), ("rise", 1, 3), ("fast", 2, 4)}
    syntactic = {(r.s1_word, r.s1_i, r.s2_i) for r in topic.syntactic_links(t).filter("s1_word = 'fast'").collect()}
    assert syntactic == {("fast", 2, 4)}
    vec = spark.createDataFrame([("tax", [1.0, 0.0]), ("rise", [0.9, 0.1]), ("fast", [0.0, 1.0])], "lemma string, embedding array<float>")
    semantic = {(r.s1_word, r.s2_word) for r in topic.semantic_links(t, vec).collect()}
    assert semantic == {("tax", "rise"), ("rise", "tax")}
    pairs = spark.createDataFrame([("d", "x", "But no", "not_continue"), ("e", "x", "However", "continue")], "id string, s1 string, s2 string, label string")
    marks = topic.transition_markers(pairs)
    out = {r.id: (r.kinds, r.rule_label) for r in topic.classify(pairs, [topic.lexical_links(t), marks]).collect()}
    assert out == {"d": (["lexical", "transition_shift"], "continue"), "e": (["transition_shift"], "not_continue")}


def test_alignment_reports_mismatch(spark):
    found = spark.createDataFrame([("p", "lexical", "tax", 1, "tax", 0)], "id string, kind string, s1_word string, s1_i int, s2_word string, s2_i int")
    n1 = spark.createDataFrame([("p", 3)], "id string, n1 int")
    att = spark.createDataFrame([("p", 1, "Tax", 0.5), ("p", 3, "ta", 0.1)], "id string, pos_i int, feature string, value double")
    labels = spark.createDataFrame([("p", "continue")], "id string, label_human string")
    out = {r.side: (r.value, r.mismatch) for r in topic.align(found, n1, att, labels).collect()}
    assert out == {"s1": (0.5, False), "s2": (0.1, True)}


def test_gates(spark):
    df = spark.createDataFrame([("Q. Is it so",), ("Is it?",), ("It is.",), ("it is.",)], "s string")
    assert [r[0] for r in df.select(segment.well_shaped("s")).collect()] == [False, False, True, False]
    pairs = spark.createDataFrame([("A b [SEP] C d",), ("A b [SEP] c",), ("A (b) [SEP] C",)], "t string")
    assert [r[0] for r in pairs.select(segment.malformed_pair("t")).collect()] == [False, True, True]


def test_main_topic_needs_role_and_distance(spark):
    far = " ".join(f"w{k}/w/X" for k in range(8))
    t = toks(spark, "Taxes/tax/NOUN/nsubj/1 rise/rise/VERB/ROOT/1", f"Taxes/tax/NOUN/nsubj/9 {far} rise/rise/VERB/ROOT/9")
    issues = spark.createDataFrame([("d", 0, "tax"), ("d", 1, "tax")], "id string, sent_i int, issue string")
    assert [(r.sent_i, r.issue) for r in topic.main_topic(t, issues).collect()] == [(0, "tax")]
