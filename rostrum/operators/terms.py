"""Term, source, lexicon and vocabulary counts."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import text as T


def term_frequencies(toks: DataFrame, label="label") -> DataFrame:
    """Lemma counts per class, without stop words and punctuation."""
    kept = toks.filter(~F.col("is_stop") & ~F.col("is_punct"))
    return kept.groupBy(label, F.lower("lemma").alias("term")).agg(F.count(F.lit(1)).alias("n"))


def top_terms(freq: DataFrame, k: int, label="label", term="term", n="n") -> DataFrame:
    """The ``k`` most frequent terms of each class; ties go to the lower term."""
    w = Window.partitionBy(label).orderBy(F.desc(n), term)
    return freq.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def distinct_words(toks: DataFrame, pos: str) -> DataFrame:
    """Distinct lower-case words of a class, for example interjections."""
    return toks.filter(F.col("pos") == pos).select(F.lower("text").alias("word")).distinct()


def lemmas_by_suffix(toks: DataFrame, pos: str, suffix: str) -> DataFrame:
    """Distinct lemmas of a class that end with a suffix."""
    hit = (F.col("pos") == pos) & F.endswith(F.col("lemma"), F.lit(suffix))
    return toks.filter(hit).select("lemma").distinct().orderBy("lemma")


def source_counts(df: DataFrame, url="url") -> DataFrame:
    """Distinct URLs per core domain.

    Each distinct URL leaves one row per task, so a hot source is reduced before the
    shuffle by domain.
    """
    return (
        df.select(F.col(url).alias("_u"))
        .distinct()
        .groupBy(T.core_domain("_u").alias("source"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def domain_counts(df: DataFrame, url="url") -> DataFrame:
    """Rows per host."""
    return df.groupBy(T.host(url).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


def filled_share(df: DataFrame, col) -> DataFrame:
    """Records that carry a value, and their share of all."""
    filled = F.count_if(F.col(col).isNotNull() & (F.col(col).cast("string") != ""))
    return df.agg(
        filled.alias("n_filled"),
        F.count(F.lit(1)).alias("n_total"),
        (filled / F.count(F.lit(1))).alias("share"),
    )


def lexicon_overlaps(lexicon: DataFrame) -> DataFrame:
    """Entries that stand in more than one category."""
    return (
        lexicon.groupBy("entry")
        .agg(F.countDistinct("category").alias("n_categories"))
        .filter(F.col("n_categories") > 1)
    )


def multiword_entries(lexicon: DataFrame) -> DataFrame:
    """Entries of several tokens."""
    counted = lexicon.withColumn("n_tokens", T.n_tokens("entry"))
    return counted.filter(F.col("n_tokens") > 1)


def feature_hits(hits: DataFrame, label="label") -> DataFrame:
    """Hit counts per class, word class, feature and kind of hit, most frequent first."""
    keys = [label, "pos", "category", "kind"]
    return (
        hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys)
    )


# --- semantic frames ----------------------------------------------------------


def frame_frequencies(df: DataFrame, label="label", frames="frames", k: int = 10) -> DataFrame:
    """The ``k`` most frequent frames of each class."""
    rows = df.select(label, F.explode(frames).alias("frame"))
    freq = rows.groupBy(label, "frame").agg(F.count(F.lit(1)).alias("n"))
    return top_terms(freq, k, label, "frame")


def subsequence_counts(names, size: int) -> dict:
    """How often each tuple of ``size`` names occurs as a subsequence of a list.

    Counts of shorter tuples are extended name by name, so the selections themselves are
    never written out.
    """
    counts = [Counter({(): 1})] + [Counter() for _ in range(size)]
    for name in names:
        for k in range(size, 0, -1):
            for head, n in counts[k - 1].items():
                counts[k][head + (name,)] += n
    return counts[size]


def frame_combinations(df: DataFrame, size: int, label="label", frames="frames") -> DataFrame:
    """Counts of all ordered selections of ``size`` frames of one row, in list order.

    Each row leaves one count per distinct tuple of names; there is no self-join, and
    counts are added before the shuffle.
    """

    @F.pandas_udf("array<struct<frames:string,n:long>>")
    def tuples(lists: pd.Series) -> pd.Series:
        return pd.Series(
            [
                [{"frames": " + ".join(t), "n": n} for t, n in subsequence_counts(x, size).items()]
                for x in lists
            ]
        )

    long_enough = df.filter(F.size(frames) >= size)
    rows = long_enough.select(label, F.explode(tuples(F.col(frames))).alias("_p"))
    return rows.groupBy(label, F.col("_p.frames").alias("frames")).agg(F.sum("_p.n").alias("n"))


def top_combinations(df: DataFrame, size: int, label="label", frames="frames", k: int = 10):
    return top_terms(frame_combinations(df, size, label, frames), k, label, "frames")


def vocabulary(df: DataFrame, names="frames") -> DataFrame:
    """Distinct entries of an array column over the corpus, sorted."""
    return df.select(F.explode(names).alias("name")).distinct().orderBy("name")
