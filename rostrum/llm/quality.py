"""Operator 3, quality classifier: perplexity under a Kneser-Ney model of trusted text.

An interpolated modified Kneser-Ney model is counted over trusted documents. Its counts lie in
shards by hash; the distinct words and pairs of a slice of documents are sorted and joined with
the sorted keys of each shard, so the documents are never shuffled, and a worker maps only the
shards that it meets. A document is kept if its perplexity is at most the quantile of its
language, taken over trusted documents that were not counted.

All trusted documents are used: three quarters of them, by a hash of their ids, are counted, and the
rest sets the quantiles, which are exact. All documents are scored and judged.

Defined results: a null or empty text has one token, the end, and is judged by its perplexity;
a null language, and one with fewer than ``least`` rows for its quantile, takes the quantile
over all languages; without trusted rows every document is kept. Repeated rows are judged
alike; repeated ids of trusted rows count once. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import folder, kneser
from rostrum.operators import selection

QUANTILE = 0.995
LEAST = 50


def log_perplexity():
    return -F.col("score") / F.col("n_tokens")


def judge(
    docs: DataFrame, trusted: DataFrame, id="doc_id", text="text", lang="lang", quantile: float = QUANTILE,
    least: int = LEAST,
) -> DataFrame:
    """``docs`` with ``log_perplexity``, ``threshold`` and ``kept``; ``trusted`` has ids in ``id``.

    The ids alone are broadcast, all of them: a plain join would shuffle every text for them.
    """
    own = [c for c in docs.columns if c not in (*kneser.SCORES, "log_perplexity", "threshold", "kept")]
    ids = trusted.select(F.col(id).alias(id)).filter(F.col(id).isNotNull()).distinct()
    known = docs.select(id, text, lang).join(F.broadcast(folder.written(ids, "trusted")), id, "left_semi")
    counted = F.pmod(F.xxhash64(F.col(id), F.lit(8)), F.lit(4)) != 0
    model = kneser.train(known.filter(counted), text)
    scored = kneser.score(known.filter(~counted).select(F.col(text).alias(text), F.col(lang).alias(lang)), model, text)
    rest = scored.select(F.col(lang).alias("lang"), log_perplexity().alias("x"))
    rest = folder.written(rest, "calibration")
    points = {"own": quantile}
    spoken = rest.filter("lang is not null")
    enough = spoken.groupBy("lang").count().filter(F.col("count") >= least)
    each = selection.quantiles(spoken, "lang", points, "x").join(enough, "lang")
    # One row per language.
    thresholds = {r.lang: r.own for r in each.collect()}
    whole = selection.quantiles(rest.withColumn("every", F.lit(0)), "every", points, "x").first()
    overall = whole.own if whole else None
    value = F.lit(overall if overall is not None else float("inf"))
    for name, x in sorted(thresholds.items()):
        value = F.when(F.col(lang) == name, F.lit(x)).otherwise(value)
    out = kneser.score(docs.select(*own), model, text).withColumn("log_perplexity", log_perplexity())
    out = out.withColumn("threshold", value).withColumn("kept", F.col("log_perplexity") <= F.col("threshold"))
    return out


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """All documents, judged by a model of those labelled as good."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    good = labels.filter("quality = 1").select("doc_id")
    out = judge(docs.select("doc_id", "text", "lang"), good)
    return out.select("doc_id", "lang", "n_tokens", "n_known", "log_perplexity", "threshold", "kept")
