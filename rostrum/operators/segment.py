"""Sentence windows, length gates and sentence filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions import fixed
from rostrum.functions import text as T
from rostrum.operators import ordered


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def long_enough(df: DataFrame, text="text", minimum=fixed.MIN_DOCUMENT_TOKENS, count=T.n_tokens):
    """Keep texts of at least ``minimum`` tokens. ``count`` is any Column function,
    so a subword count from a user's vocabulary can be plugged in."""
    return df.filter(count(text) >= minimum)


def rejoin(sents: DataFrame, by="id", order="sent_i", sentence="sentence", out="text") -> DataFrame:
    """Put kept sentences back together, in order, with single spaces.

    ``by`` must name one document; a document bounds the size of a group.
    """
    by = [by] if isinstance(by, str) else list(by)
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(sentence).alias("s"))))
    return sents.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["s"]), " ").alias(out))


def pack_windows(sents: Column, low: int, high: int) -> Column:
    """Greedy windows over ``array<struct<sentence, n>>``, as ``array<array<string>>``.

    A sentence is added until the window would exceed ``high`` tokens. The window is
    then kept when it has at least ``low`` tokens and dropped otherwise, and a new one
    starts with that sentence. Windows do not overlap. One sentence of more than
    ``high`` tokens stands alone in its window.
    """
    empty = F.array().cast("array<string>")
    state = F.struct(
        F.lit(0).cast("long").alias("n"),
        empty.alias("window"),
        F.array().cast("array<array<string>>").alias("done"),
    )

    def step(acc, s):
        n = s["n"].cast("long")
        fits = (acc["n"] + n) <= F.lit(high).cast("long")
        keep = acc["n"] >= F.lit(low).cast("long")
        return F.struct(
            F.when(fits, acc["n"] + n).otherwise(n).alias("n"),
            F.when(fits, F.array_append(acc["window"], s["sentence"]))
            .otherwise(F.array(s["sentence"]))
            .alias("window"),
            F.when(~fits & keep, F.array_append(acc["done"], acc["window"]))
            .otherwise(acc["done"])
            .alias("done"),
        )

    return F.aggregate(
        sents,
        state,
        step,
        lambda acc: F.when(
            acc["n"] >= F.lit(low).cast("long"), F.array_append(acc["done"], acc["window"])
        ).otherwise(acc["done"]),
    )


def windows(
    df: DataFrame,
    id="id",
    text="text",
    low=fixed.WINDOW_MIN_TOKENS,
    high=fixed.WINDOW_MAX_TOKENS,
    count=T.n_tokens,
    keep=(),
) -> DataFrame:
    """Cut each text into windows of ``low`` to ``high`` tokens.

    Rows are ``(id, *keep, window_i, text, n_tokens)``. Every document is folded inside
    its own row, so there is no shuffle.
    """
    sents = F.transform(
        T.sentences(text),
        lambda s: F.struct(s.alias("sentence"), count(s).cast("long").alias("n")),
    )
    packed = df.select(
        F.col(id), *keep, F.posexplode(pack_windows(sents, low, high)).alias("window_i", "_w")
    )
    joined = packed.withColumn("text", F.array_join("_w", " "))
    return joined.withColumn("n_tokens", count("text")).drop("_w")


def number_windows(df: DataFrame, order_by=("id", "window_i"), out="window_id") -> DataFrame:
    """Ids 1, 2, 3 … over all windows in an explicit order."""
    return ordered.numbered(df, list(order_by), (), out)


def minimal_meaning(toks: DataFrame) -> DataFrame:
    """Sentences that have a subject, a root and an object."""
    dep = F.col("dep")
    found = toks.groupBy("id", "sent_i").agg(
        *[
            F.bool_or(F.coalesce(dep.isin(deps), F.lit(False))).alias(name)
            for name, deps in (
                ("_s", fixed.SUBJECT_DEPS), ("_r", fixed.ROOT_DEPS), ("_o", fixed.OBJECT_DEPS)
            )
        ]
    )
    return found.select("id", "sent_i", (F.col("_s") & F.col("_r") & F.col("_o")).alias("has_meaning"))


def clause_counts(toks: DataFrame, most: int = fixed.MAX_CLAUSES) -> DataFrame:
    """Sentences with one to ``most`` verbs, and how many."""
    return (
        toks.groupBy("id", "sent_i")
        .agg(F.count_if(F.col("pos") == "VERB").alias("n_clauses"))
        .filter(F.col("n_clauses").between(1, most))
    )


def well_shaped(c="sentence", most_tokens: int = fixed.MAX_SENTENCE_TOKENS) -> Column:
    """Short, starts with a capital, is no question and carries no ``Q.`` label."""
    c = _col(c)
    return (
        (T.n_tokens(c) < most_tokens)
        & c.rlike(r"^\p{Lu}")
        & ~F.endswith(c, F.lit("?"))
        & ~F.startswith(c, F.lit("Q."))
    )


def _lower_tokens(c) -> Column:
    return T.tokens(F.lower(_col(c)))


def _any_of(c, words) -> Column:
    return F.arrays_overlap(_lower_tokens(c), F.array(*[F.lit(w) for w in words]))


def first_person(c="text") -> Column:
    return _any_of(c, fixed.FIRST_PERSON)


def personal_voice(c="text", more_than: int = fixed.MIN_GATE_WORDS) -> Column:
    """More than ``more_than`` words, a first-person pronoun and no other person."""
    words = F.size(F.filter(T.tokens(c), T.is_alpha))
    return (
        (words > more_than)
        & first_person(c)
        & ~_any_of(c, fixed.SECOND_PERSON + fixed.THIRD_PERSON)
    )


def contains_any(c, patterns, ignore_case: bool = False) -> Column:
    """One compiled alternation in place of a join on ``contains``."""
    body = "|".join(re.escape(p) for p in patterns)
    return _col(c).rlike(("(?i)" if ignore_case else "") + body)


def drop_containing(df: DataFrame, text="text", patterns=None) -> DataFrame:
    patterns = fixed.IGNORED_IN_PAIR if patterns is None else patterns
    return df.filter(~contains_any(text, patterns))


def malformed_pair(c="text") -> Column:
    """A member has a bracket, or starts with a lower-case letter, digit or mark."""
    members = F.split(_col(c), r"\[SEP\] ")
    return F.exists(
        members, lambda s: s.rlike(fixed.PAIR_BRACKETS) | s.rlike(r"^[\p{Ll}\p{N}\p{P}]")
    )


def drop_by_source(
    df: DataFrame,
    sources: DataFrame,
    on="text_id",
    title="title",
    text="source_text",
    title_patterns=None,
    text_patterns=None,
) -> DataFrame:
    """Keep rows whose source exists and has no ignored title or text."""
    title_patterns = fixed.IGNORED_IN_TITLE if title_patterns is None else title_patterns
    text_patterns = fixed.IGNORED_IN_TEXT if text_patterns is None else text_patterns
    good = sources.filter(
        ~contains_any(title, title_patterns, ignore_case=True) & ~contains_any(text, text_patterns)
    )
    return df.join(good.select(on).distinct(), on, "left_semi")


def first_per_class(df: DataFrame, label, order_by, n: int) -> DataFrame:
    """First ``n`` rows of each class. The limit is applied before the shuffle too."""
    w = Window.partitionBy(label).orderBy(*ordered._cols(order_by))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
