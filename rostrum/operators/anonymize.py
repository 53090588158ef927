"""Replace entity spans by labels, and words by neutral words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import clean, fixed
from rostrum.operators import features


def spans_of(c, pattern: str, label: str) -> Column:
    """``array<struct<start, end, label, text>>`` of all matches of a pattern."""
    c = F.col(c) if isinstance(c, str) else c
    gaps = F.split(c, pattern, -1)
    hits = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    state = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,end:int,label:string,text:string>>").alias("found"),
    )

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.coalesce(F.length(pair["hit"]), F.lit(0))
        span = F.struct(
            start.alias("start"), end.alias("end"), F.lit(label).alias("label"), pair["hit"].alias("text")
        )
        return F.struct(
            end.alias("at"),
            F.when(pair["hit"].isNull(), acc["found"])
            .otherwise(F.array_append(acc["found"], span))
            .alias("found"),
        )

    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    return F.aggregate(pairs, state, step, lambda acc: acc["found"])


def mask_spans(c, ents) -> Column:
    """Put the label in place of each span of ``ents`` (no overlaps), by offset."""
    c = F.col(c) if isinstance(c, str) else c
    ents = F.array_sort(F.col(ents) if isinstance(ents, str) else ents)

    def piece(e, k):
        left = F.coalesce(F.get(ents, k - 1)["end"], F.lit(0))
        return F.concat(F.substr(c, left + 1, e["start"] - left), e["label"])

    tail = F.substr(
        c, F.coalesce(F.get(ents, F.size(ents) - 1)["end"], F.lit(0)) + 1, F.length(c)
    )
    masked = F.concat(F.array_join(F.transform(ents, piece), ""), tail)
    return F.when(F.size(ents) > 0, masked).otherwise(c)


def anonymize(
    df: DataFrame, entities: DataFrame, labels=None, extra=(), text="text", id="id", ignore_case=True
) -> DataFrame:
    """Replace the entities of ``entities(id, start, end, label)`` by their labels.

    ``labels=None`` takes all labels. ``extra`` words become ``[ENTITY]`` afterwards.
    The entities of one document are gathered per document, which bounds the group.
    """
    labels = fixed.ALL_ENTITY_LABELS if labels is None else labels
    spans = (
        entities.filter(F.col("label").isin(list(labels)))
        .groupBy(id)
        .agg(F.collect_list(F.struct("start", "end", "label")).alias("_ents"))
    )
    x = df.join(spans, id, "left")
    out = F.when(F.col("_ents").isNull(), F.col(text)).otherwise(mask_spans(text, "_ents"))
    if extra:
        out = clean.mask_words(out, extra, ignore_case=ignore_case)
    return x.withColumn(text, out).drop("_ents")


def pair_text(s1, s2, marked: bool = False) -> Column:
    """``s1 [SEP] s2``, or the form with ``[CLS]`` and a closing ``[SEP]``."""
    s1, s2 = (F.col(x) if isinstance(x, str) else x for x in (s1, s2))
    body = F.concat(s1, F.lit(fixed.PAIR_SEPARATOR), s2)
    return F.concat(F.lit("[CLS] "), body, F.lit(" [SEP]")) if marked else body


def anonymize_pairs(pairs: DataFrame, entities: DataFrame, extra=None, text="text", id="id") -> DataFrame:
    """Pair anonymisation: thirteen labels, then every extra word, case-sensitive."""
    return anonymize(
        pairs, entities, fixed.PAIR_ENTITY_LABELS,
        fixed.EXTRA_ENTITIES if extra is None else extra, text, id, ignore_case=False,
    )


def neutralize(toks: DataFrame, words, pools: dict, seed: int = 42) -> DataFrame:
    """Replace biased words by neutral words of the same class and rebuild the text.

    The choice is the MD5 of ``seed-id-sent_i-i``: the same on every run, every partitioning
    and in every engine. White space is kept. Returns ``(id, text)``. Of token arrays, one row per
    sentence (:func:`rostrum.operators.annotate.gathered`), only the new texts are shuffled.
    """
    in_row = "tokens" in toks.columns

    def word(get):
        picked = get("text")
        biased = get("lemma").isin(list(words)) & ~get("is_stop") & ~get("is_punct")
        name = F.md5(F.concat_ws("-", F.lit(str(seed)), "id", "sent_i", get("i")).cast("binary"))
        at = F.conv(F.substr(name, F.lit(1), F.lit(8)), 16, 10).cast("long")
        for pos, pool in pools.items():
            options = F.array(*[F.lit(w) for w in pool])
            choice = F.get(options, F.pmod(at, F.lit(len(pool)).cast("long")).cast("int"))
            picked = F.when(get("pos") == pos, choice).otherwise(picked)
        # Few words are biased: for the others nothing more is evaluated.
        picked = F.when(biased, picked).otherwise(get("text"))
        return F.concat(picked, get("ws"))

    if in_row:
        placed = F.array_sort(F.transform("tokens", lambda t: F.struct(t["i"].alias("i"), word(lambda f: t[f]).alias("w"))))
        joined = F.array_join(F.transform(placed, lambda p: p["w"]), "")
        rows = toks.select("id", F.struct("sent_i", joined.alias("w")).alias("_w"))
    else:
        rows = toks.select("id", F.struct("sent_i", "i", word(F.col).alias("w")).alias("_w"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("_w")).alias("_r")).select(
        "id", F.array_join(F.transform("_r", lambda r: r["w"]), "").alias("text")
    )


def feature_shift(before: DataFrame, after: DataFrame, cols=features.FEATURES) -> DataFrame:
    """Features of a text before and after substitution, and the differences."""
    left = before.select("id", *[F.col(c).alias(f"{c}_before") for c in cols])
    right = after.select("id", *[F.col(c).alias(f"{c}_after") for c in cols])
    return left.join(right, "id").withColumns(
        {f"{c}_shift": F.col(f"{c}_after") - F.col(f"{c}_before") for c in cols}
    )
