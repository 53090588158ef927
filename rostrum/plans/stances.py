"""From sentences to binary stance features and the issues they are about."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import clean
from rostrum.operators import annotate, gazetteer, lookup, segment, stance, topic

FIELDS = ("i", "text", "lemma", "pos")


def document_bits(docs: DataFrame, lexicon: DataFrame, tokenizer=annotate.tokens, groups=None) -> DataFrame:
    """Eight binary features per text: 1 when any of its sentences has a hit.

    ``docs`` is ``(id, text)``; ``lexicon`` is ``(category, pos, entry)``. The modal words
    are added to the lexicon.
    """
    toks = tokenizer(annotate.sentences(docs, "id", "text"))
    sents = annotate.sentence_arrays(toks, fields=FIELDS)
    words = lexicon.select("category", "pos", "entry").unionByName(stance.modal_lexicon(docs.sparkSession))
    hits = stance.all_hits(sents, toks, words)
    vectors = stance.vectors(sents, hits, stance.standard_features(), stance.pattern_hits(sents))
    bits = stance.binary_features(vectors, groups, ["id", "sent_i"])
    names = [c for c in bits.columns if c not in ("id", "sent_i")]
    return bits.groupBy("id").agg(*[F.max(c).alias(c) for c in names])


def extract_sentences(
    docs: DataFrame,
    terms: DataFrame,
    tokenizer,
    frames: DataFrame | None = None,
    rules: DataFrame | None = None,
) -> DataFrame:
    """Sentences about an issue, through the gates in order of cost.

    Shape and clause gates come first, then the gazetteer and the main-topic rule, and the
    frame rule last. ``tokenizer`` must fill ``dep`` and ``head_i``; ``frames`` is
    ``(id, sent_i, frames)``.
    """
    steps = ("known_strings", "brackets", "parentheses", "leading", "timestamps", "ascii", "links", "cleanup")
    sents = annotate.sentences(docs, "id", "text")
    sents = sents.withColumn("sentence", clean.clean_text("sentence", steps))
    sents = sents.filter(segment.well_shaped("sentence"))
    toks = tokenizer(sents)
    keep = segment.clause_counts(toks).select("id", "sent_i")
    arrays = annotate.sentence_arrays(toks.join(keep, ["id", "sent_i"], "left_semi"), fields=FIELDS)
    found = gazetteer.match_phrases(arrays, gazetteer.from_columns(terms))
    issues = found.select("id", "sent_i", F.col("first_lemma").alias("issue"))
    about = topic.main_topic(toks, issues)
    out = sents.join(about, ["id", "sent_i"])
    if frames is None:
        return out
    return lookup.frame_rule_matches(out.join(frames, ["id", "sent_i"]), rules)
