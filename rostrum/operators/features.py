"""Ten linguistic features of a document, from its token table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import fixed

SENTENCE_FEATURES = [
    "sentence_length", "sentence_complexity", "personal_pronoun_d", "passive_voice_d",
    "nominalization_d", "lexical_d", "interjection_d", "modal_verb_d", "discourse_marker_d",
]
FEATURES = SENTENCE_FEATURES[:1] + ["word_length"] + SENTENCE_FEATURES[1:]


def _rules(markers, get=F.col) -> dict[str, Column]:
    """A test of a token for each feature; ``get`` reads a field of it."""
    word = F.lower(get("text"))
    suffix = "(" + "|".join(fixed.NOMINAL_SUFFIXES) + ")$"
    return {
        "sentence_length": get("is_alpha"),
        "sentence_complexity": get("dep").isin(fixed.CLAUSE_DEPS),
        "personal_pronoun_d": word.isin(fixed.PERSONAL_PRONOUNS),
        "passive_voice_d": get("dep") == "auxpass",
        "nominalization_d": (get("pos") == "NOUN") & word.rlike(suffix),
        "lexical_d": get("pos").isin(fixed.LEXICAL_POS),
        "interjection_d": get("pos") == "INTJ",
        "modal_verb_d": get("tag") == "MD",
        "discourse_marker_d": F.lower(get("lemma")).isin(
            fixed.DISCOURSE_MARKERS if markers is None else markers
        ),
    }


def sentence_counts(toks: DataFrame, markers=None) -> DataFrame:
    """One row per sentence that has a word: a count for each feature, and the letters of
    its words.

    Tokens of a sentence sit together, so the map-side half of the aggregate leaves about
    one row per sentence for the shuffle. Fixed-width sums only: a plain hash aggregate.
    A table of token arrays is counted in its rows and not shuffled at all.
    """
    if "tokens" in toks.columns:
        return _counts_in_row(toks, markers)
    rules = _rules(markers)
    letters = F.sum(F.when(F.col("is_alpha"), F.length("text"))).alias("letters")
    counts = toks.groupBy("id", "sent_i").agg(
        *[F.count_if(rule).cast("int").alias(name) for name, rule in rules.items()], letters
    )
    return counts.filter(F.col("sentence_length") > 0)


def _counts_in_row(sents: DataFrame, markers) -> DataFrame:
    def count(name):
        hits = F.filter("tokens", lambda t: F.coalesce(_rules(markers, lambda f: t[f])[name], F.lit(False)))
        return F.size(hits).alias(name)

    words = F.filter("tokens", lambda t: t["is_alpha"])
    letters = F.aggregate(words, F.lit(0).cast("long"), lambda n, t: n + F.length(t["text"])).alias("letters")
    counts = sents.select("id", "sent_i", *[count(name) for name in _rules(markers)], letters)
    return counts.filter(F.col("sentence_length") > 0)


def sentence_features(toks: DataFrame, markers=None) -> DataFrame:
    """The same counts, with the length of each word in order."""
    rules = _rules(markers)
    word = F.when(F.col("is_alpha"), F.struct(F.col("i").alias("i"), F.length("text").alias("n")))
    return (
        toks.groupBy("id", "sent_i")
        .agg(
            *[F.count_if(rule).cast("int").alias(name) for name, rule in rules.items()],
            F.collect_list(word).alias("_words"),
        )
        .filter(F.col("sentence_length") > 0)
        .withColumn("word_length", F.transform(F.array_sort("_words"), lambda w: w["n"]))
        .drop("_words")
    )


def linguistic_features(toks: DataFrame, markers=None) -> DataFrame:
    """One row per document: an array per feature, one value per sentence
    (``word_length``: one per word)."""
    rows = F.array_sort(F.collect_list(F.struct("sent_i", *FEATURES)))
    docs = sentence_features(toks, markers).groupBy("id").agg(rows.alias("_s"))
    return docs.select(
        "id",
        *[
            (
                F.flatten(F.col("_s.word_length")) if f == "word_length" else F.col(f"_s.{f}")
            ).alias(f)
            for f in FEATURES
        ],
    )


def array_mean(c) -> Column:
    """Mean of a numeric array; NULL when it is empty."""
    c = F.col(c) if isinstance(c, str) else c
    total = F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return F.when(F.size(c) > 0, total / F.size(c))


def array_means(df: DataFrame, cols=FEATURES) -> DataFrame:
    """Replace each array column by its mean."""
    return df.withColumns({c: array_mean(c) for c in cols})


def document_means(toks: DataFrame, markers=None) -> DataFrame:
    """The means of :func:`linguistic_features` without building the arrays."""
    return sentence_counts(toks, markers).groupBy("id").agg(
        *[F.avg(f).alias(f) for f in SENTENCE_FEATURES],
        (F.sum("letters") / F.sum("sentence_length")).alias("word_length"),
    )
