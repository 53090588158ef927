"""Phrase matching against a gazetteer of exact, lemma and hyphenated terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import phrases, spans

KINDS = {"exact": "text", "lemmatized": "lemma", "hyphenated": "lemma"}


def from_columns(table: DataFrame) -> DataFrame:
    """Turn three padded columns into ``(kind, entry)`` rows; blanks are dropped."""
    pairs = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(k).alias("entry")) for k in KINDS if k in table.columns]
    )
    rows = table.select(F.explode(pairs).alias("_p")).select("_p.kind", "_p.entry")
    return rows.filter(F.coalesce(F.trim("entry"), F.lit("")) != "").distinct()


def match_phrases(
    sents: DataFrame, gazetteer: DataFrame, names: DataFrame | None = None, counted: bool = False
) -> DataFrame:
    """Longest non-overlapping gazetteer terms of each sentence: place, entry, the words as they
    stand in the text, and the lemma of the first one.

    ``sents`` is ``(id, sent_i, tokens)``. Entries are matched as token sequences: on the
    surface form for ``exact``, on lemmas otherwise. ``names(entry, qid, name)`` adds the
    distinct identifiers of the matched term; terms unknown to it are dropped.
    Entries are found from their rarest token, see :mod:`rostrum.operators.phrases`: the rarest
    one among the entries, or with ``counted`` in the corpus, which reads it once more.
    """
    terms = gazetteer.select(
        "kind", T.tokens("entry").alias("words"), F.struct("entry").alias("payload")
    ).distinct()
    found = None
    for field, kinds in (("text", ["exact"]), ("lemma", ["lemmatized", "hyphenated"])):
        entries = terms.filter(F.col("kind").isin(kinds)).select("words", "payload").distinct()
        counts = phrases.token_counts(sents, field, entries) if counted else None
        hit = phrases.find(sents, field, phrases.parts(entries, counts), ["tokens"]).select(
            "id", "sent_i", "start", "end", "payload.entry",
            F.array_join(F.slice("tokens.text", F.col("start") + 1, F.col("end") - F.col("start")), " ").alias("text"),
            F.get("tokens.lemma", F.col("start")).alias("first_lemma"),
        )
        found = hit if found is None else found.unionByName(hit)
    per_sentence = found.groupBy("id", "sent_i").agg(
        F.collect_set(F.struct("start", "end", "entry", "text", "first_lemma")).alias("_s")
    )
    kept = per_sentence.select(
        "id", "sent_i", F.explode(spans.longest_spans("_s")).alias("_m")
    ).select("id", "sent_i", "_m.*")
    if names is None:
        return kept
    ids = names.groupBy("entry").agg(
        F.array_sort(F.collect_set("qid")).alias("qids"),
        F.array_sort(F.collect_set("name")).alias("names"),
    )
    return kept.join(ids, "entry").withColumn("label", F.lit("ISSUE"))
