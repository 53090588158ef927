"""Sentences, tokens, windows and gates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from rostrum.catalog.base import (
    TOKEN_SQL, Tables, ann_docs, doc_sentences, doc_tokens, q, query, rounded, sents_sql, sql_list,
    toks_sql, with_parse,
)
from rostrum.functions import fixed
from rostrum.functions import text as T
from rostrum.operators import annotate, segment, topic
from rostrum.streaming import resume



def ntok(c: str) -> str:
    return f"len(regexp_extract_all({c}, {TOKEN_SQL}))"


@query("sg01_sentences", f"WITH {sents_sql()} SELECT id, sent_i, sentence FROM sents")
def sg01(t):
    return doc_sentences(t)


@query("sg02_token_counts", f"SELECT doc_id, {ntok('text')} AS n_tokens FROM documents")
def sg02(t):
    return t.texts.select("doc_id", T.n_tokens("text").alias("n_tokens"))


@query("sg03_length_gate", f"SELECT doc_id, lang FROM documents WHERE {ntok('text')} >= 450")
def sg03(t):
    return segment.long_enough(t.texts).select("doc_id", "lang")


@query(
    "sg04_has_word",
    f"WITH {sents_sql()},{toks_sql()} SELECT id, sent_i, bool_or(regexp_full_match(text, '\\p{{L}}+')) AS has_word "
    "FROM toks GROUP BY ALL",
)
def sg04(t):
    return doc_sentences(t).filter(F.size(T.tokens("sentence")) > 0).select(
        "id", "sent_i", T.has_word("sentence").alias("has_word")
    )


@query(
    "sg05_minimal_meaning",
    ann_docs() + f""" SELECT id, sent_i, bool_or(dep IN {sql_list(fixed.SUBJECT_DEPS)})
    AND bool_or(dep = 'ROOT') AND bool_or(dep IN {sql_list(fixed.OBJECT_DEPS)}) AS has_meaning
    FROM ann GROUP BY id, sent_i""",
)
def sg05(t):
    return segment.minimal_meaning(with_parse(doc_tokens(t)))


# A sentence joins the window unless it would pass the limit; then a new one starts. The fold is
# a recursion over the sentences of a text.
WINDOWS = f"""WITH RECURSIVE {sents_sql(extra='lang')},
nt AS (SELECT id, lang, sent_i, sentence, {ntok('sentence')} AS n FROM sents),
fw AS (SELECT id, sent_i, CASE WHEN n <= 510 THEN 0 ELSE 1 END AS g, n AS total FROM nt WHERE sent_i = 0
  UNION ALL SELECT nt.id, nt.sent_i, CASE WHEN total + n <= 510 THEN g ELSE g + 1 END, CASE WHEN total + n <= 510 THEN total + n ELSE n END
  FROM fw JOIN nt ON nt.id = fw.id AND nt.sent_i = fw.sent_i + 1),
gw AS (SELECT fw.id, any_value(lang) AS lang, g, string_agg(sentence, ' ' ORDER BY nt.sent_i) AS text FROM fw JOIN nt ON nt.id = fw.id AND nt.sent_i = fw.sent_i
  GROUP BY fw.id, g HAVING sum(n) >= 400),
wd AS (SELECT CAST(id AS BIGINT) AS doc_id, lang, row_number() OVER (PARTITION BY id ORDER BY g) - 1 AS window_i, text, {ntok('text')} AS n_tokens FROM gw)"""


@query("sg06_windows", WINDOWS + " SELECT doc_id, lang, window_i, text, n_tokens FROM wd")
def sg06(t):
    return segment.windows(t.texts, "doc_id", "text", keep=["lang"])


@query("sg06_window_ids", WINDOWS + " SELECT row_number() OVER (ORDER BY doc_id, window_i) AS window_id, doc_id, window_i, n_tokens FROM wd")
def sg06_ids(t):
    # The texts are cut once; numbering reads the windows several times.
    w = resume.cut_lineage(segment.windows(t.texts, "doc_id", "text").select("doc_id", "window_i", "n_tokens"))
    return segment.number_windows(w, ["doc_id", "window_i"]).select("window_id", "doc_id", "window_i", "n_tokens")


@query(
    "sg07_rejoin",
    f"WITH {sents_sql()} SELECT id, string_agg(sentence, ' ' ORDER BY sent_i) AS text FROM sents "
    f"WHERE {ntok('sentence')} > 5 GROUP BY id",
)
def sg07(t):
    return segment.rejoin(doc_sentences(t).filter(T.n_tokens("sentence") > 5))


@query(
    "sg08_clause_counts",
    ann_docs() + """ SELECT * FROM (SELECT id, sent_i, count(*) FILTER (WHERE pos = 'VERB') AS n_clauses
    FROM ann GROUP BY id, sent_i) WHERE n_clauses BETWEEN 1 AND 4""",
)
def sg08(t):
    return segment.clause_counts(doc_tokens(t))


@query(
    "sg09_sentence_shape",
    f"""WITH {sents_sql()} SELECT id, sent_i FROM sents WHERE {ntok('sentence')} < 50
    AND regexp_matches(sentence, '^\\p{{Lu}}') AND NOT ends_with(sentence, '?') AND NOT starts_with(sentence, 'Q.')""",
)
def sg09(t):
    return doc_sentences(t).filter(segment.well_shaped("sentence")).select("id", "sent_i")


def overlap(c: str, words) -> str:
    return f"list_has_any(regexp_extract_all(lower({c}), {TOKEN_SQL}), [{', '.join(q(w) for w in words)}])"


# Test texts have no first person: one is put in front.
VOICE = "(SELECT id, sent_i, 'We ' || sentence AS text FROM sents)"


@query(
    "sg10_personal_voice",
    f"""WITH {sents_sql()} SELECT id, sent_i FROM {VOICE}
    WHERE len(list_filter(regexp_extract_all(text, {TOKEN_SQL}), lambda x: regexp_full_match(x, '\\p{{L}}+'))) > 15
    AND {overlap('text', fixed.FIRST_PERSON)} AND NOT {overlap('text', fixed.SECOND_PERSON + fixed.THIRD_PERSON)}""",
)
def sg10(t):
    rows = doc_sentences(t).withColumn("text", F.concat(F.lit("We "), F.col("sentence")))
    return rows.filter(segment.personal_voice("text")).select("id", "sent_i")


@query(
    "sg11_first_person",
    f"""SELECT doc_id FROM documents WHERE {overlap("text || CASE WHEN lang = 'en' THEN ' Our' ELSE '' END", fixed.FIRST_PERSON)}""",
)
def sg11(t):
    text = F.concat(F.col("text"), F.when(F.col("lang") == "en", " Our").otherwise(""))
    return t.documents.filter(segment.first_person(text)).select("doc_id")


# Words of the test texts in the place of the fixed patterns, which do not occur in them.
PATTERNS = ["tionth", "Q.", "ingly", "aux éc"]


def contains_sql(c, patterns, case=False):
    f = (lambda x: f"lower({x})") if case else (lambda x: x)
    return "(" + " OR ".join(f"contains({f(c)}, {f(q(p))})" for p in patterns) + ")"


@query("sg12_drop_patterns", f"SELECT doc_id FROM documents WHERE NOT {contains_sql('text', PATTERNS)}")
def sg12(t):
    return segment.drop_containing(t.documents, "text", PATTERNS).select("doc_id")


@query(
    "sg12_drop_fixed_patterns",
    f"""SELECT doc_id FROM (SELECT doc_id, text || CASE WHEN lang = 'de' THEN ' THE PRESIDENT: ' ELSE '' END AS text
    FROM documents) WHERE NOT {contains_sql('text', fixed.IGNORED_IN_PAIR)}""",
)
def sg12_fixed(t):
    text = F.concat("text", F.when(F.col("lang") == "de", " THE PRESIDENT: ").otherwise(""))
    return segment.drop_containing(t.documents.withColumn("text", text)).select("doc_id")


@query(
    "sg13_malformed_pairs",
    """SELECT conv_id, turn FROM (
      SELECT conv_id, turn, text || ' [SEP] ' || lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)
    WHERE t IS NOT NULL AND NOT list_bool_or(list_transform(string_split(t, '[SEP] '),
      lambda s: regexp_matches(s, '[{}\\[\\]()]') OR regexp_matches(s, '^[\\p{Ll}\\p{N}\\p{P}]')))""",
)
def sg13(t):
    a = t.conversations.select("conv_id", "turn", F.col("text").alias("s1"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s2"))
    pairs = a.join(b, ["conv_id", "turn"]).withColumn("t", F.concat_ws(fixed.PAIR_SEPARATOR, "s1", "s2"))
    return pairs.filter(~segment.malformed_pair("t")).select("conv_id", "turn")


@query(
    "sg14_drop_by_source",
    f"""SELECT l.doc_id, l.quality FROM labels l JOIN documents d USING (doc_id)
    WHERE NOT {contains_sql("d.source || ' ' || d.lang", ["SRC7", "src1 DE"], True)} AND NOT {contains_sql('d.text', PATTERNS)}""",
)
def sg14(t):
    sources = t.documents.select(
        "doc_id", F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("source_text")
    )
    return segment.drop_by_source(
        t.labels, sources, "doc_id", "title", "source_text", ["SRC7", "src1 DE"], PATTERNS
    ).select("doc_id", "quality")


@query("sg15_drop_values", "SELECT doc_id, source FROM documents WHERE source NOT IN ('src3', 'src11')")
def sg15(t):
    from rostrum.operators import curate

    return curate.without_values(t.documents, "source", ["src3", "src11"]).select("doc_id", "source")


@query(
    "sg16_first_per_class",
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r
    FROM documents) WHERE r <= 30""",
)
def sg16(t):
    return segment.first_per_class(t.documents, "lang", [F.desc("n_chars"), "doc_id"], 30).select("doc_id", "lang")


@query(
    "sg17_holds_all",
    f"""SELECT doc_id FROM documents WHERE list_has_all(regexp_extract_all(lower(text), {TOKEN_SQL}), ['the', 'of', 'that'])""",
)
def sg17(t):
    return t.documents.filter(T.holds_all(T.tokens(F.lower("text")), ["the", "of", "that"])).select("doc_id")
