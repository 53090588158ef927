"""Sources and sinks: JSON Lines, JSON, text, CSV and keyed tables.

Readers take an explicit schema; nothing is inferred over the data. Writers write one
file per task, never through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import fixed
from rostrum.functions import text as T
from rostrum.operators import lookup

SCHEMAS = {
    "raw_documents": (
        "id STRING, text STRING, label STRING, metadata STRUCT<text_id: STRING, title: STRING, "
        "source: STRING, publication_date: STRING, crawling_date: STRING, "
        "politician: ARRAY<STRING>, gender: ARRAY<STRING>>"
    ),
    "stance_sentences": "id STRING, text STRING, label STRING",
    "unlabeled_pool": "id STRING, text STRING, target STRING",
    "passages": (
        "id STRING, text ARRAY<STRUCT<sentence: STRING, role: STRING>>, "
        "metadata STRUCT<annotator: STRING, text_id: STRING>"
    ),
    "sentence_pairs": (
        "id STRING, passage_id STRING, text STRING, label STRING, annotator STRING, text_id STRING"
    ),
    "predictions": "id STRING, true_label STRING, predicted_label STRING",
    "frames": (
        "denotations ARRAY<STRUCT<id: INT, obj: STRING, role: STRING, "
        "span: STRUCT<begin: INT, end: INT>, text: STRING, token_span: ARRAY<INT> > >, "
        "frame STRING, lu STRING, relations ARRAY<STRUCT<obj: INT, pred: STRING, subj: INT>>, "
        "text STRING"
    ),
    "gazetteer": "exact STRING, hyphenated STRING, lemmatized STRING",
    "lexicon": "category STRING, pos STRING, entry STRING",
    "attributions": "Value DOUBLE, Feature STRING",
}


def read_jsonl(spark: SparkSession, path, schema: str) -> DataFrame:
    """JSON Lines with a fixed schema. An id declared STRING also reads integer ids."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).json(path)


def write_jsonl(df: DataFrame, path, mode: str = "overwrite") -> None:
    """``mode="append"`` adds the rows of a later run."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def read_json(spark: SparkSession, path, schema: str) -> DataFrame:
    """Whole-file JSON documents: one object or one array of objects per file."""
    return spark.read.schema(SCHEMAS.get(schema, schema)).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path, column: str = "value") -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", column)


def write_lines(df: DataFrame, column, path) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_sheet(spark: SparkSession, path) -> DataFrame:
    """Header row, then string cells; quoted cells may hold line breaks."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def write_sheet(df: DataFrame, path) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def write_tables(df: DataFrame, by, path) -> None:
    """Several named tables in one place: one folder per value of ``by``."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def read_attributions(spark: SparkSession, path) -> DataFrame:
    rows = spark.read.schema(SCHEMAS["attributions"]).csv(path, header=True)
    return rows.select(F.col("Feature").alias("feature"), F.col("Value").alias("value"))


def write_attributions(df: DataFrame, path) -> None:
    rows = df.select(F.col("value").alias("Value"), F.col("feature").alias("Feature"))
    rows.write.mode("overwrite").csv(path, header=True)


def sentences_to_records(
    sheet: DataFrame, id="sentence_id", sentence="sentence", most: int = fixed.MAX_SENTENCE_TOKENS
) -> DataFrame:
    """Sheet rows to ``(id, text)``: at most ``most`` tokens, a period appended."""
    return sheet.filter(T.n_tokens(sentence) <= most).select(
        F.col(id).alias("id"), F.concat(F.col(sentence), F.lit(".")).alias("text")
    )


def scan(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Collection scan; ``limit`` is an option of the caller."""
    return df if limit is None else df.limit(limit)


def upsert_table(old: DataFrame, new: DataFrame, path, key="id") -> None:
    """Write the merged table to a new path; a reader of the old one is not disturbed."""
    lookup.upsert(old, new, key).write.mode("errorifexists").parquet(path)


def matrix_rows(long: DataFrame) -> DataFrame:
    """Long correlations to one JSON object per column, as ``{row: value}``."""
    both = long.select("f1", "f2", "corr").unionByName(
        long.select(F.col("f2").alias("f1"), F.col("f1").alias("f2"), "corr")
    )
    entries = F.array_sort(F.collect_list(F.struct("f2", "corr")))
    return both.groupBy(F.col("f1").alias("column")).agg(F.map_from_entries(entries).alias("values"))


def parse_literal(c, schema: str) -> Column:
    """A literal kept in a string cell, read as JSON and never evaluated. Single quotes
    are accepted."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_json(c, schema, {"allowSingleQuotes": "true"})
