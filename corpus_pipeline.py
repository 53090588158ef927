"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; ``run`` writes it as Parquet to
the shared folder and reads it back as the next stage's documents, so a lost executor never
costs more than its own stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm import decontaminate, folder, langid, neardup, packing, surrogates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no language: without a letter, or unlike all profiles.

    Profiles are learned from the documents themselves, by their ``lang``.
    """
    return langid.reject(docs, langid.learn(docs)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest document of each group of near-duplicates."""
    found = neardup.near_duplicates(docs)
    # Rows with a null id are compared with nothing and stay.
    dropped = found.filter("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs.select(*COLUMNS), items)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; the number of characters follows the text."""
    out = surrogates.replace(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("bigint"))
    return out.select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences, one row each."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packed),
]

# SQL has no tokenizer and no bundled vectors; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = folder.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
