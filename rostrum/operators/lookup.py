"""Lookups between datasets. Every per-row fetch of a script is one join here."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rostrum.operators.annotate import bound


def transfer_labels(df: DataFrame, labelled: DataFrame, key="text", label="label") -> DataFrame:
    """Give each row the label of an equal text, once per distinct label.

    Both sides are made distinct first: copies of one text on both sides would
    multiply otherwise.
    """
    return df.distinct().join(labelled.select(key, label).distinct(), key)


def attach(df: DataFrame, records: DataFrame, on, how: str = "left") -> DataFrame:
    """Record lookup by key."""
    return df.join(records, on, how)


def attach_two_hops(df, passages, texts, first="passage_id", second="text_id") -> DataFrame:
    """Row to passage to text."""
    return df.join(passages, first, "left").join(texts, second, "left")


def first_match(df: DataFrame, tables: list[DataFrame], key="id") -> DataFrame:
    """Record of the first table that has the key; NULL when none has it."""
    ranked = [t.withColumn("_priority", F.lit(i)) for i, t in enumerate(tables)]
    pool = ranked[0]
    for t in ranked[1:]:
        pool = pool.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_priority")
    best = pool.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") == 1)
    return df.join(best.drop("_n"), key, "left").withColumnRenamed("_priority", "source_rank")


def upsert(old: DataFrame, new: DataFrame, key="id") -> DataFrame:
    """Old rows without a newer version, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(
        new, allowMissingColumns=True
    )


def frame_rule_matches(df: DataFrame, rules: DataFrame, frames="frames", mode="matched") -> DataFrame:
    """Keep sentences whose frames meet the rule names, with the main frame.

    ``frames`` is ``array<struct<frame, denotations>>``. The main frame is the first
    matched frame; ``mode="reference"`` takes the first frame with a denotation, matched
    or not. Distinct lists of frame names meet the rules by a join, so neither the rules
    nor the sentences are gathered; a list then carries the few rules that it meets.
    """
    # Sorted without a comparator in SQL, and bound: filters on the lists find them finished.
    listed = F.sort_array(F.array_distinct(F.transform(frames, lambda f: f["frame"])))
    df = df.withColumn("_names", listed).select(*[F.col(f"`{c}`") for c in df.columns], bound("_names"))
    lists = df.select("_names").distinct()
    met = lists.withColumn("name", F.explode("_names")).join(rules.select("name").distinct(), "name")
    met = met.groupBy("_names").agg(F.sort_array(F.collect_list("name")).alias("_rules"))
    x = df.join(met, "_names").drop("_names")
    x = x.withColumn("matched_frames", F.col("_rules"))
    if mode == "matched":
        picked = F.filter(frames, lambda f: F.array_contains(F.col("_rules"), f["frame"]))
    else:
        picked = F.filter(frames, lambda f: F.size(f["denotations"]) > 0)
    return x.withColumn("main_frame", F.get(picked, F.lit(0))["frame"]).drop("_rules")
