"""Token tables.

``tokens`` fills the token table by rule, with expressions only. A user with a
tagger or parser fills the same schema through ``mapInPandas`` and passes the
table to the operators; no model is shipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import text as T

TOKEN_SCHEMA = (
    "id string, sent_i int, i int, text string, ws string, lemma string, pos string, "
    "tag string, dep string, head_i int, is_alpha boolean, is_punct boolean, is_stop boolean"
)

# Closed word classes of the rule-based tagger.
CLOSED_CLASSES = {
    "INTJ": ["oh", "ah", "yes", "hello", "thanks"],
    "DET": ["the", "a", "an", "this", "that", "these", "those"],
    "PRON": ["i", "me", "you", "he", "him", "she", "her", "it", "we", "us", "they", "them"],
    "ADP": ["of", "to", "in", "for", "on", "with", "by", "as", "at", "from"],
    "CCONJ": ["and", "or", "but"],
    "SCONJ": ["because", "if", "than", "while"],
    "PART": ["not"],
    "AUX": [
        "is", "are", "was", "were", "be", "been", "has", "have", "had", "do", "does", "did",
        "will", "would", "shall", "can", "could", "may", "might", "must", "should",
    ],
}
MODAL_WORDS = ["will", "would", "shall", "can", "could", "may", "might", "must", "should"]
LEMMAS = {
    "be": ["is", "are", "was", "were", "been"],
    "have": ["has", "had"],
    "do": ["does", "did"],
}
# Suffix -> class, tried in this order after the closed classes.
SUFFIX_CLASSES = [
    ("ly", "ADV"), ("ing", "VERB"), ("ed", "VERB"), ("able", "ADJ"), ("ible", "ADJ"),
    ("ble", "ADJ"), ("ous", "ADJ"), ("ful", "ADJ"), ("ive", "ADJ"),
]


def _sql_list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def pos_rule(word: str = "word", kind: str = "kind") -> str:
    """The tagger as a SQL expression over a lower-case word and its kind
    (``alpha``, ``num``, ``word`` or ``punct``). Plain enough for any SQL engine."""
    cases = [f"WHEN {kind} = 'punct' THEN 'PUNCT'", f"WHEN {kind} = 'num' THEN 'NUM'"]
    cases += [f"WHEN {word} IN {_sql_list(ws)} THEN '{pos}'" for pos, ws in CLOSED_CLASSES.items()]
    cases += [f"WHEN {word} LIKE '%{s}' THEN '{pos}'" for s, pos in SUFFIX_CLASSES]
    return f"CASE {' '.join(cases)} ELSE 'NOUN' END"


def tag_rule(word: str = "word", pos: str = "pos") -> str:
    return f"CASE WHEN {word} IN {_sql_list(MODAL_WORDS)} THEN 'MD' ELSE {pos} END"


def lemma_rule(word: str = "word", pos: str = "pos") -> str:
    cases = [f"WHEN {word} IN {_sql_list(ws)} THEN '{l}'" for l, ws in LEMMAS.items()]
    cases.append(
        f"WHEN {pos} = 'NOUN' AND length({word}) > 3 AND {word} LIKE '%s' "
        f"AND {word} NOT LIKE '%ss' THEN substring({word}, 1, length({word}) - 1)"
    )
    return f"CASE {' '.join(cases)} ELSE {word} END"


STOP_WORDS = [
    w for pos in ("DET", "PRON", "ADP", "CCONJ", "SCONJ", "PART", "AUX")
    for w in CLOSED_CLASSES[pos]
]


def sentences(df: DataFrame, id: str = "id", text: str = "text", keep=()) -> DataFrame:
    """One row per sentence: ``id, sent_i, sentence`` and the columns in ``keep``."""
    return df.select(
        F.col(id).cast("string").alias("id"),
        *keep,
        F.posexplode(T.sentences(text)).alias("sent_i", "sentence"),
    )


def plain_tokens(sents: DataFrame, keep=()) -> DataFrame:
    """One row per token of a sentence table: ``id, sent_i, i, text``."""
    return sents.select(
        "id", "sent_i", *keep, F.posexplode(T.tokens("sentence")).alias("i", "text")
    )


def tokens(sents: DataFrame, keep=()) -> DataFrame:
    """Fill the token schema from ``(id, sent_i, sentence)`` by rule.

    ``dep`` and ``head_i`` stay NULL; they need a parser.
    """
    piece = rf"(?:{T.TOKEN})\s*"
    pieces = F.regexp_extract_all("sentence", F.lit(piece), F.lit(0))
    rows = sents.select("id", "sent_i", *keep, F.posexplode(pieces).alias("i", "_piece"))
    rows = rows.withColumn("text", F.regexp_replace("_piece", r"\s+$", ""))
    rows = rows.withColumns(
        {
            "ws": F.substr("_piece", F.length("text") + 1, F.length("_piece")),
            "word": F.lower("text"),
            "kind": F.when(T.is_alpha("text"), "alpha")
            .when(F.col("text").rlike(r"^\p{N}+$"), "num")
            .when(F.col("text").rlike(rf"^[{T.WORD_CHAR}]+$"), "word")
            .otherwise("punct"),
        }
    )
    rows = rows.withColumn("pos", F.expr(pos_rule()))
    token = F.struct(
        "i", "text", "ws",
        F.expr(lemma_rule()).alias("lemma"),
        "pos",
        F.expr(tag_rule()).alias("tag"),
        F.lit(None).cast("string").alias("dep"),
        F.lit(None).cast("int").alias("head_i"),
        (F.col("kind") == "alpha").alias("is_alpha"),
        (F.col("kind") == "punct").alias("is_punct"),
        F.col("word").isin(STOP_WORDS).alias("is_stop"),
    )
    # The columns leave through a generator: a filter or join on them is then tested on
    # the finished values. Pushed below, it would repeat the rules for every reference.
    return rows.select("id", "sent_i", *keep, F.inline(F.array(token)))


ARRAY_FIELDS = (
    "i", "text", "ws", "lemma", "pos", "tag", "dep", "head_i", "is_alpha", "is_punct", "is_stop"
)


def _spark_pos(text: str, word: str) -> str:
    """:func:`pos_rule` with cheap tests first: closed classes and suffixes hold letters only, so their
    words are neither numbers nor punctuation, and few other words do not end in a plain letter."""
    closed = _sql_list([w for ws in CLOSED_CLASSES.values() for w in ws])
    suffixes = " ".join(f"WHEN {word} LIKE '%{s}' THEN '{pos}'" for s, pos in SUFFIX_CLASSES)
    return (
        f"CASE WHEN {word} IN {closed} THEN {pos_rule(word, repr('alpha'))} {suffixes} "
        f"WHEN substring({word}, -1) BETWEEN 'a' AND 'z' THEN 'NOUN' WHEN {text} RLIKE '{NUMBER}' THEN 'NUM' "
        f"WHEN length({text}) = 1 AND NOT {text} RLIKE '^[{WORD}]$' THEN 'PUNCT' ELSE 'NOUN' END"
    )


def _spark_lemma(word: str, pos: str) -> str:
    """:func:`lemma_rule` with a hashed test in front of the irregular forms, the class of a word being
    asked for last."""
    closed = [w for ws in CLOSED_CLASSES.values() for w in ws]
    irregular = [w for ws in LEMMAS.values() for w in ws]
    forms = " ".join(f"WHEN {word} IN {_sql_list(ws)} THEN '{lemma}'" for lemma, ws in LEMMAS.items())
    return (
        f"CASE WHEN {word} IN {_sql_list(dict.fromkeys(irregular + closed))} THEN CASE {forms} ELSE {word} END "
        f"WHEN {word} LIKE '%s' AND length({word}) > 3 AND {word} NOT LIKE '%ss' AND {pos} = 'NOUN' "
        f"THEN substring({word}, 1, length({word}) - 1) ELSE {word} END"
    )


# Patterns inside SQL text, where a backslash is written twice.
WORD = T.WORD_CHAR.replace("\\", "\\\\")
NUMBER, LETTERS = (p.replace("\\", "\\\\") for p in (r"^\p{N}+$", T.ALPHA))


def _tags(rows: DataFrame, sentences, fields) -> DataFrame:
    """``rows`` with ``tokens``: those of all ``sentences``, one after the other, with ``fields``.

    The rules run over arrays of strings, not of structs, and each array is an argument of the next
    function, so that it is made once; only those that ``fields`` need are there.
    """
    spaced = "ws" in fields
    tagged = not set(fields) <= {"i", "text", "ws", "dep", "head_i"}
    # White space after a token belongs to it.
    found = F.lit(rf"(?:{T.TOKEN})\s*" if spaced else T.TOKEN)
    rows = rows.withColumn("tokens", F.flatten(F.transform(sentences, lambda s: F.transform(
        F.regexp_extract_all(s, found, F.lit(0)), lambda t, i: F.struct(i.alias("i"), t.alias("text"))
    ))))
    if spaced:
        rows = rows.withColumn("tokens", F.transform("tokens", lambda x: F.struct(
            x["i"].alias("i"), F.regexp_replace(x["text"], r"\s+$", "").alias("text"), x["text"].alias("piece")
        )))
    if tuple(fields) == ("i", "text"):
        return rows
    kept = rows.columns
    if tagged:
        # One call for a sentence; no token holds a line end, so each is lowered as if by itself.
        lowered = F.split(F.lower(F.array_join("tokens.text", "\n")), "\n")
        rows = rows.withColumn("_words", F.slice(lowered, F.lit(1), F.size("tokens")))
    if {"lemma", "pos", "tag", "is_punct"} & set(fields):
        rows = rows.withColumn("_pos", F.expr(f"zip_with(tokens.text, _words, (t, w) -> {_spark_pos('t', 'w')})"))
    rules = {
        "i": "tokens.i", "text": "tokens.text",
        "ws": "transform(tokens, x -> substr(x.piece, length(x.text) + 1, length(x.piece)))",
        "lemma": f"zip_with(_words, _pos, (w, p) -> {_spark_lemma('w', 'p')})", "pos": "_pos",
        "tag": f"zip_with(_words, _pos, (w, p) -> {tag_rule('w', 'p')})",
        "dep": "array_repeat(cast(null as string), size(tokens))",
        "head_i": "array_repeat(cast(null as int), size(tokens))",
        "is_alpha": f"transform(tokens.text, t -> t RLIKE '{LETTERS}')", "is_punct": "transform(_pos, p -> p = 'PUNCT')",
        "is_stop": f"transform(_words, w -> w IN {_sql_list(STOP_WORDS)})",
    }
    columns = F.arrays_zip(*[F.expr(rules[f]).alias(f) for f in fields])
    return rows.withColumn("tokens", columns).select(*kept)


def bound(name: str):
    """The column through a generator: filters and generators above it read its finished values, where
    Spark would else write its expression into each of them."""
    return F.explode(F.array(name)).alias(name)


def tagged(sents: DataFrame, keep=(), fields=ARRAY_FIELDS) -> DataFrame:
    """The same tokens as one array per sentence, ``id, sent_i, *keep, tokens``.

    Everything is computed in the row of the sentence: tokens are neither exploded nor
    gathered, so nothing is shuffled. ``fields`` names those to compute.
    """
    rows = sents.select("id", "sent_i", *keep, F.array("sentence").alias("_sentences"))
    rows = _tags(rows, F.col("_sentences"), fields)
    return rows.select("id", "sent_i", *keep, bound("tokens"))


def gathered(sents: DataFrame, keep=(), fields=ARRAY_FIELDS) -> DataFrame:
    """``sentence_arrays(tokens(sents))`` with one shuffle of the sentences in place of their tokens.

    Sentences that share their ``(id, sent_i)`` are one, with their tokens in order.
    """
    rows = sents.groupBy("id", "sent_i", *keep).agg(F.collect_list("sentence").alias("_sentences"))
    rows = _tags(rows, F.col("_sentences"), fields)
    rows = rows.select("id", "sent_i", *keep, F.size("_sentences").alias("_n"), bound("tokens"))
    ordered = F.when(F.col("_n") > 1, F.array_sort("tokens")).otherwise(F.col("tokens"))
    return rows.filter(F.size("tokens") > 0).select("id", "sent_i", *keep, ordered.alias("tokens"))


def sentence_arrays(toks: DataFrame, keep=(), fields=ARRAY_FIELDS) -> DataFrame:
    """Gather tokens into one array per sentence, in order.

    One shuffle by ``(id, sent_i)``; a sentence bounds the size of a group. ``fields``
    names the columns to carry, ``i`` first.
    """
    present = [c for c in fields if c in toks.columns]
    return toks.groupBy("id", "sent_i", *keep).agg(
        F.array_sort(F.collect_list(F.struct(*present))).alias("tokens")
    )
