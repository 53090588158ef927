"""From raw texts to a table of class differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import clean, fixed
from rostrum.functions import text as T
from rostrum.operators import annotate, features, stats

QUICK = ["sentences", "sentence_length", "word_length", "personal_pronoun_d"]


def line_steps(c):
    """Cleaning that keeps line ends, which part sentences."""
    out = clean.drop_brackets(c)
    src = "".join(k for k, _ in fixed.CHAR_MAP if k != "\n")
    dst = "".join(v for k, v in fixed.CHAR_MAP if k != "\n")
    out = F.regexp_replace(F.translate(out, src, dst), r"[^\x00-\x7F]", "")
    out = F.regexp_replace(clean.drop_links(out), r"\S*@\S*\s?", "")
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"[ \t\r\f]+", " ")), " +", " ")


def quick_features(docs: DataFrame, id: str, text: str, label: str) -> DataFrame:
    """Sentence count, words per sentence, word length and pronouns per sentence.

    Everything is computed inside the row of a document, with array functions: the texts
    are never exploded and never shuffled.
    """
    sents = F.transform(
        T.sentences(line_steps(text)),
        lambda s: F.transform(T.tokens(s), lambda w: F.struct(w.alias("w"), T.is_alpha(w).alias("a"))),
    )
    counted = F.filter(
        F.transform(
            sents,
            lambda s: F.struct(
                F.size(F.filter(s, lambda w: w["a"])).alias("words"),
                F.aggregate(
                    s, F.lit(0), lambda acc, w: acc + F.when(w["a"], F.length(w["w"])).otherwise(0)
                ).alias("chars"),
                F.size(
                    F.filter(s, lambda w: F.lower(w["w"]).isin(fixed.PERSONAL_PRONOUNS))
                ).alias("pron"),
            ),
        ),
        lambda s: s["words"] > 0,
    )
    rows = docs.select(F.col(id).alias("id"), F.col(label).alias("label"), counted.alias("_s"))

    def total(field):
        return F.aggregate("_s", F.lit(0), lambda acc, s: acc + s[field]).cast("double")

    # A text without sentences gets NULLs, which the statistics skip. A filter here would
    # be evaluated a second time below the joins.
    n = F.nullif(F.size("_s").cast("double"), F.lit(0.0))
    return rows.select(
        "id", "label", n.alias("sentences"),
        (total("words") / n).alias("sentence_length"),
        F.try_divide(total("chars"), total("words")).alias("word_length"),
        (total("pron") / n).alias("personal_pronoun_d"),
    )


def quick_tests(docs, id, text, label, classes, p: bool = True) -> DataFrame:
    """Welch tests of the quick features between two classes."""
    return stats.t_tests(quick_features(docs, id, text, label), "label", classes, QUICK, p)


def prepare(docs: DataFrame, text="text", minimum=fixed.MIN_DOCUMENT_TOKENS, steps=clean.BODY_STEPS):
    """Clean the texts and drop the short ones, in one projection."""
    from rostrum.operators import segment

    return segment.long_enough(docs.withColumn(text, clean.clean_text(text, steps)), text, minimum)


def full_tests(docs: DataFrame, label, classes, tokenizer=annotate.tagged, markers=None, alpha=0.05):
    """All ten features from a token table to corrected tests.

    ``docs`` is ``(id, text, label)``. ``tokenizer`` maps a sentence table to a token
    table or to token arrays; pass one that calls a parser to fill the clause and passive
    features.
    """
    toks = tokenizer(annotate.sentences(docs, "id", "text"))
    means = features.document_means(toks, markers)
    rows = means.join(docs.select(F.col("id").cast("string").alias("id"), label), "id")
    return stats.correct(stats.t_tests(rows, label, classes, features.FEATURES), alpha=alpha)
