import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rostrum.functions import clean, fixed
from rostrum.functions import text as T


def apply(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    "step, before, after",
    [
        (clean.drop_strings, "a [Israeli Prime Minister] b[Laughter]", "a   b "),
        (clean.drop_brackets, "a (b) [c] (d\ne)", "a   (d\ne)"),
        (clean.drop_parentheses, "a (b) [c]", "a  [c]"),
        (clean.drop_timestamps, "x [00:12:34] (1:02:03) y", "x   y"),
        (clean.to_ascii, "café – “x” it’s ok", "caf - x it's ok"),
        (clean.expand_contractions, "I've said don't.", "I have said do not ."),
        (clean.expand_contractions, "Wasn't wasn't He's", "Wasn't was not He is "),
        (clean.drop_links, "see http://a.b/c now", "see   now"),
        (clean.final_cleanup, "  <b>x</b> me@b.c  y  .\n", "x y."),
        (clean.drop_entity_label, "ENTITY : hello", "hello"),
        (clean.speaker_tags, "[SPEAKER] [INTERVIEWER15] [SPEAKER16]", "ENTITY ENTITY [SPEAKER16]"),
        (clean.mask_words, "covid-19 and HIV", "[ENTITY] and [ENTITY]"),
        (clean.drop_unopened, "a (b) c] d) e", "e"),
        (clean.drop_unopened, "(a) [b] c", "(a) [b] c"),
        (clean.drop_leading_marks, "# 1. - Example", "Example"),
        (clean.drop_leading_marks, "[# x", "[# x"),
        (clean.drop_speaker_prefix, "MR. SMITH: Yes: no", "Yes: no"),
        (clean.drop_speaker_prefix, "we say this, to all of you: no", "we say this, to all of you: no"),
        (clean.placeholders, "in the 1990s at 12 \U0001F600", "in the DATE at NUMBER EMOJI"),
    ],
)
def test_steps(spark, step, before, after):
    assert apply(spark, step("t"), before) == [after]


def test_speaker_prefix_reference_mode(spark):
    assert apply(spark, clean.drop_speaker_prefix("t", "reference"), "we say: no: x") == ["no: x"]
    with pytest.raises(ValueError):
        clean.drop_speaker_prefix("t", "other")


def test_placeholders_numbers_last_keeps_dates(spark):
    c = clean.placeholders("t", numbers_last=True)
    assert apply(spark, c, "on 01/02/2000 at 12:34 PM, 7") == ["on DATE at TIME, NUMBER"]


def test_entity_text_is_replaced_everywhere(spark):
    ents = F.array(F.struct(F.lit("MONEY").alias("label"), F.lit("$5").alias("text")))
    assert apply(spark, clean.replace_entities("t", ents), "$5 or $5") == ["NUMBER or NUMBER"]


def test_steps_run_in_fixed_order(spark):
    # The time stamp is gone before its own step: brackets come first.
    c = clean.clean_text("t", ["timestamps", "brackets", "cleanup"])
    assert apply(spark, c, "a [00:00:01] b") == ["a b"]
    with pytest.raises(ValueError):
        clean.clean_text("t", ["nothing"])


def brute_unopened(s):
    depth, cut = {"(": 0, "[": 0}, 0
    for i, ch in enumerate(s):
        if ch in depth:
            depth[ch] += 1
        elif ch in ")]":
            o = "(" if ch == ")" else "["
            if depth[o]:
                depth[o] -= 1
            else:
                cut = i + 1
    return s[cut:].strip()


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="()[]ab ", max_size=20), min_size=1, max_size=30))
def test_unopened_against_brute_force(spark, values):
    assert apply(spark, clean.drop_unopened("t"), *values) == [brute_unopened(v) for v in values]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab@ .\n<>", max_size=25), min_size=1, max_size=30))
def test_cleanup_leaves_single_spaces(spark, values):
    for out in apply(spark, clean.final_cleanup("t"), *values):
        assert "  " not in out and out == out.strip() and "@" not in out


def test_urls(spark):
    urls = ["https://www.a.co.uk/x", "http://news.bbc.com/y?z", "http://x.y.z.org", "none"]
    assert apply(spark, T.host("t"), *urls) == ["a.co.uk", "news.bbc.com", "x.y.z.org", ""]
    assert apply(spark, T.core_domain("t"), *urls) == ["a.co.uk", "bbc.com", "z.org", ""]


def test_ids_and_lists(spark):
    assert apply(spark, T.padded_id("t", F.lit("S")), "12", "123456789012") == ["0000000012S", "123456789012S"]
    assert apply(spark, T.comma_list("t"), "a , b,c") == [["a", "b", "c"]]
    assert apply(spark, T.decode_multi_hot(T.encode_multi_hot(T.tokens("t"), ["a", "b", "c"]), ["a", "b", "c"]), "c a") == [["a", "c"]]
    assert apply(spark, T.holds_all(T.tokens("t"), ["a", "b"]), "b x a", "a a") == [True, False]


def test_tokens_and_sentences(spark):
    assert apply(spark, T.tokens("t"), "Don't, été!") == [["Don", "'", "t", ",", "été", "!"]]
    assert apply(spark, T.sentences("t"), "A b. C?  D\nE") == [["A b.", "C?", "D", "E"]]
    assert apply(spark, T.has_word("t"), "12 !", "a 1") == [False, True]


def test_fixed_word_lists_are_words():
    assert len(set(fixed.DISCOURSE_MARKERS)) == len(fixed.DISCOURSE_MARKERS)
    assert not any(" " in m for m in fixed.DISCOURSE_MARKERS)
