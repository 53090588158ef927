"""Token n-grams and non-overlapping spans inside one sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ngrams(words, n: int) -> Column:
    """``array<struct<start, end, gram>>`` of ``n`` neighbouring words of an array column."""
    words = F.col(words) if isinstance(words, str) else words
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts,
        lambda s: F.struct(
            s.alias("start"),
            (s + n).alias("end"),
            F.concat_ws(" ", *[F.get(words, s + k) for k in range(n)]).alias("gram"),
        ),
    )


def longest_spans(spans) -> Column:
    """Longest spans first, then leftmost; a span that overlaps a kept one is dropped.

    ``spans`` is ``array<struct<start, end, …>>`` of one sentence.
    """
    spans = F.col(spans) if isinstance(spans, str) else spans
    keyed = F.transform(
        spans,
        lambda s: F.struct((s["start"] - s["end"]).alias("size"), s["start"].alias("at"), s.alias("span")),
    )
    ordered = F.transform(F.array_sort(keyed), lambda k: k["span"])
    none = F.slice(ordered, 1, 0)
    kept = F.aggregate(
        ordered,
        none,
        lambda acc, s: F.when(
            F.exists(acc, lambda k: (s["start"] < k["end"]) & (s["end"] > k["start"])), acc
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_sort(kept)


def gram_rows(
    sents: DataFrame, field: str, lengths, keep=(), lower: bool = False, surface: bool = False
) -> DataFrame:
    """Explode the n-grams of several lengths: ``id, sent_i, start, end, gram``.

    ``surface`` adds the words as they stand in the text and the lemma of the first one.
    """
    words = F.transform("tokens", lambda t: F.lower(t[field]) if lower else t[field])
    held = [F.col("tokens.text").alias("_t"), F.col("tokens.lemma").alias("_l")] if surface else []
    rows = sents.select("id", "sent_i", *keep, *held, words.alias("_w"))
    grams = F.flatten(F.array(*[ngrams("_w", n) for n in sorted(set(lengths))]))
    if surface:
        grams = F.transform(
            grams,
            lambda g: F.struct(
                g["start"].alias("start"), g["end"].alias("end"), g["gram"].alias("gram"),
                F.array_join(F.slice("_t", g["start"] + 1, g["end"] - g["start"]), " ").alias("text"),
                F.get("_l", g["start"]).alias("first_lemma"),
            ),
        )
    more = ["_g.text", "_g.first_lemma"] if surface else []
    return rows.select("id", "sent_i", *keep, F.explode(grams).alias("_g")).select(
        "id", "sent_i", *keep, "_g.start", "_g.end", "_g.gram", *more
    )
