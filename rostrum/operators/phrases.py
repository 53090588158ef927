"""Phrases of a table found in token arrays, without n-grams.

The entries are split into parts by their rarest token, the anchor, with its place in the entry and
the entry's first token. A part is a trie: a map from the path of a node to the entries that end
there. A sentence meets the parts whose anchor it holds, by one join on the token; where the first
token stands in its place too, the trie is walked from there, token by token, until no node follows.
So the work of a sentence follows the rare tokens it holds, not its n-grams or the number of entries.
The parts are written as a table before the join, so that their bytes are known when it is planned:
small tables of entries are broadcast, and the sentences are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.streaming.resume import cut_lineage


def token_counts(sents: DataFrame, field: str, entries: DataFrame) -> DataFrame:
    """``(token, n)``: how often the tokens of ``entries`` occur in the corpus."""
    wanted = entries.select(F.explode("words").alias("token")).distinct()
    tokens = sents.select(F.explode(F.col(f"tokens.{field}")).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n")).join(wanted, "token", "left_semi")


def anchors(entries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``(words, anchor, at)``: the rarest token of each ``words`` and its place.

    It is the token with the smallest count, of equal ones the longest; ``counts(token, n)`` are
    those of a corpus, where a token that is missing counts 0, or else the numbers of entries.
    """
    places = entries.select("words", F.posexplode("words").alias("at", "token")).distinct()
    if counts is None:
        counts = places.groupBy("token").agg(F.countDistinct("words").alias("n"))
    rarity = F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), (-F.length("token")).alias("size"), "token", "at"
    )
    return (
        places.join(counts.select("token", "n"), "token", "left")
        .groupBy("words").agg(F.min(rarity).alias("r"))
        .select("words", F.col("r.token").alias("anchor"), F.col("r.at").alias("at"))
    )


def parts(entries: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``(anchor, at, first, depth, trie)`` from ``(words, payload)``, by their :func:`anchors`."""
    entries = entries.filter(F.size("words") > 0)
    chosen = anchors(entries, counts)
    steps = entries.join(chosen, "words").select(
        "anchor", "at", F.get("words", F.lit(0)).alias("first"), "words", "payload",
        F.explode(F.sequence(F.lit(1), F.size("words"))).alias("k"),
    )
    ending = F.when(F.col("k") == F.size("words"), F.col("payload"))
    nodes = steps.groupBy(
        "anchor", "at", "first", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("path")
    ).agg(F.collect_set(ending).alias("ends"))
    return nodes.groupBy("anchor", "at", "first").agg(
        F.max("k").alias("depth"), F.map_from_entries(F.collect_list(F.struct("path", "ends"))).alias("trie")
    )


def _walk(words: str, start: str, kind: str) -> Column:
    """Entries that the trie finds from ``start``: ``array<struct<end, payload>>``."""
    nothing = f"cast(array() as array<struct<end: int, payload: {kind}>>)"
    path = f"concat_ws(' ', acc.path, get({words}, {start} + k - 1))"
    node = f"try_element_at(trie, {path})"
    return F.expr(f"""aggregate(sequence(1, depth),
      named_struct('path', cast(array() as array<string>), 'hits', {nothing}),
      (acc, k) -> CASE WHEN acc.path IS NULL THEN acc
        WHEN get({words}, {start} + k - 1) IS NULL OR {node} IS NULL
          THEN named_struct('path', cast(null as array<string>), 'hits', acc.hits)
        ELSE named_struct('path', concat(acc.path, array(get({words}, {start} + k - 1))), 'hits',
          concat(acc.hits, transform({node}, p -> named_struct('end', {start} + k, 'payload', p)))) END,
      acc -> acc.hits)""")


def find(sents: DataFrame, field: str, found_parts: DataFrame, keep=()) -> DataFrame:
    """``(id, sent_i, *keep, start, end, payload)``: every entry at every place where it stands.

    ``sents`` is ``(id, sent_i, tokens)``; ``field`` of the tokens is compared.
    """
    found_parts = cut_lineage(found_parts)
    kind = found_parts.schema["trie"].dataType.valueType.elementType.simpleString()
    rows = sents.select(
        "id", "sent_i", *keep, F.col(f"tokens.{field}").alias("_words")
    ).select("*", F.posexplode("_words").alias("_i", "_token"))
    met = rows.join(found_parts, F.col("_token") == F.col("anchor"))
    met = met.withColumn("_start", F.col("_i") - F.col("at")).filter(
        (F.col("_start") >= 0) & (F.get("_words", F.col("_start")) == F.col("first"))
    )
    hits = met.select("id", "sent_i", *keep, F.col("_start").alias("start"), F.explode(_walk("_words", "_start", kind)).alias("_h"))
    return hits.select("id", "sent_i", *keep, "start", "_h.end", "_h.payload")
