"""Registry of queries over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.functions import text as T
from rostrum.operators import annotate


class Tables:
    """The tables of one scale folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def texts(self) -> DataFrame:
        """Documents for work on the whole text."""
        return self.documents.select("doc_id", "text", "lang", "source")

    @property
    def turns(self) -> DataFrame:
        return self.conversations


@dataclass
class Query:
    run: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(fn, sql)
        return fn

    return register


def r6(c, name=None):
    """Round for comparison between engines."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.round(c.cast("double"), 6) + F.lit(0.0)
    return out.alias(name) if name else out


def rounded(df: DataFrame) -> DataFrame:
    """Round every floating-point column."""
    return df.select(
        *[r6(F.col(c), c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


# --- shared derivations, in Spark and in SQL -----------------------------------------

TOKEN_SQL = q(T.TOKEN)


def sents_sql(source="documents", id="doc_id", text="text", extra="") -> str:
    """CTE ``sents(id, sent_i, sentence, extra…)``."""
    more = f", {extra}" if extra else ""
    return f"""
sents AS (
  SELECT id, sent_i, sentence{more} FROM (
    SELECT id{more}, unnest(parts) AS sentence, unnest(range(len(parts))) AS sent_i FROM (
      SELECT CAST({id} AS VARCHAR) AS id{more},
        list_filter(string_split_regex(
          regexp_replace({text}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '[\\x01\\n]+'),
          lambda x: length(trim(x)) > 0) AS parts
      FROM {source})))"""


def toks_sql(extra="") -> str:
    """CTE ``toks(id, sent_i, i, text, extra…)`` over ``sents``."""
    more = f", {extra}" if extra else ""
    return f"""
toks AS (
  SELECT id, sent_i{more}, unnest(ts) AS text, unnest(range(len(ts))) AS i FROM (
    SELECT id, sent_i{more}, regexp_extract_all(sentence, {TOKEN_SQL}) AS ts FROM sents))"""


DEP_RULE = """CASE WHEN pos = 'PUNCT' THEN 'punct' WHEN pos = 'AUX' THEN 'ROOT'
  WHEN i = 0 THEN 'nsubj' WHEN pos = 'DET' THEN 'det'
  WHEN lemma LIKE '%tion' THEN 'dobj' WHEN lemma LIKE '%ed' THEN 'advcl'
  WHEN lemma LIKE '%ing' THEN 'auxpass' ELSE 'dep' END"""
HEAD_RULE = "CASE WHEN i > 0 THEN i - 1 ELSE 0 END"


def ann_sql(extra="") -> str:
    """CTE ``ann`` over ``toks``: the rule-based annotation and a stand-in parse."""
    more = f", {extra}" if extra else ""
    return f"""
kinds AS (
  SELECT *, lower(text) AS word, CASE WHEN regexp_full_match(text, '\\p{{L}}+') THEN 'alpha'
    WHEN regexp_full_match(text, '\\p{{N}}+') THEN 'num'
    WHEN regexp_full_match(text, '[{T.WORD_CHAR}]+') THEN 'word' ELSE 'punct' END AS kind FROM toks),
posd AS (SELECT *, {annotate.pos_rule()} AS pos FROM kinds),
lem AS (SELECT *, {annotate.lemma_rule()} AS lemma, {annotate.tag_rule()} AS tag,
  kind = 'alpha' AS is_alpha, kind = 'punct' AS is_punct,
  word IN {sql_list(annotate.STOP_WORDS)} AS is_stop FROM posd),
ann AS (SELECT *, {DEP_RULE} AS dep, {HEAD_RULE} AS head_i FROM lem)"""


def with_parse(toks: DataFrame) -> DataFrame:
    """A stand-in parse by rule, for operators that need ``dep`` and ``head_i``."""
    return toks.withColumns(
        {"dep": F.expr(DEP_RULE), "head_i": F.expr(HEAD_RULE).cast("int")}
    )


def doc_sentences(t: Tables, keep=()) -> DataFrame:
    return annotate.sentences(t.texts, "doc_id", "text", keep)


def doc_tokens(t: Tables, keep=()) -> DataFrame:
    return annotate.tokens(doc_sentences(t, keep), keep)


def tagged_sentences(t: Tables, keep=(), fields=annotate.ARRAY_FIELDS) -> DataFrame:
    """Token arrays in the rows of the sentences."""
    return annotate.tagged(doc_sentences(t, keep), keep, fields)


def parsed_in_row(sents: DataFrame) -> DataFrame:
    """:func:`with_parse` for token arrays."""
    dep, head = (re.sub(r"\b(pos|lemma|i)\b", r"x.\1", rule) for rule in (DEP_RULE, HEAD_RULE))
    return sents.withColumn("tokens", F.expr(
        f"transform(tokens, x -> struct(x.i, x.text, x.lemma, x.pos, x.tag, x.is_alpha, {dep} AS dep, {head} AS head_i))"
    ))


def labelled(t: Tables) -> DataFrame:
    """Documents with their class."""
    return t.documents.join(t.labels, "doc_id")


LABELLED_SQL = "(SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id))"


def labelled_tokens(t: Tables) -> DataFrame:
    sents = annotate.sentences(labelled(t), "doc_id", "text", ["quality"])
    return annotate.tokens(sents, ["quality"])


def ann_docs(extra="", source="documents") -> str:
    """``WITH`` clause that ends in ``ann`` over the documents."""
    return "WITH " + ",".join([sents_sql(source, extra=extra), toks_sql(extra), ann_sql()])


ANN_LABELLED = ann_docs("quality", LABELLED_SQL)
