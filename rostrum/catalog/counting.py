"""Terms, frames, sources and lexicons."""

from pyspark.sql import functions as F

from rostrum.catalog.base import (
    ANN_LABELLED, LABELLED_SQL, ann_docs, doc_tokens, labelled, labelled_tokens, query, rounded,
    sents_sql, sql_list, toks_sql,
)
from rostrum.catalog.cleaning import CORE_EXPR, HOST
from rostrum.functions import text as T
from rostrum.operators import annotate, lookup, stats, terms

FREQ = "SELECT quality, lower(lemma) AS term, count(*) AS n FROM ann WHERE NOT is_stop AND NOT is_punct GROUP BY ALL"


@query("ag09_term_frequencies", ANN_LABELLED + " " + FREQ)
def ag09(t):
    return terms.term_frequencies(labelled_tokens(t), "quality")


@query(
    "ag10_top_terms",
    ANN_LABELLED + f", f AS ({FREQ}) SELECT quality, term, n, rank FROM (SELECT *, row_number() OVER "
    "(PARTITION BY quality ORDER BY n DESC, term) AS rank FROM f) WHERE rank <= 50",
)
def ag10(t):
    return terms.top_terms(terms.term_frequencies(labelled_tokens(t), "quality"), 50, "quality")


# The texts hold no interjections: one is put in front of each.
CRY = "(SELECT doc_id, CASE lang WHEN 'en' THEN 'Oh ' WHEN 'fr' THEN 'AH, yes ' ELSE 'Well ' END || text AS text FROM documents)"


@query("ag11_interjections", ann_docs(source=CRY) + " SELECT DISTINCT word FROM ann WHERE pos = 'INTJ'")
def ag11(t):
    cry = F.when(F.col("lang") == "en", "Oh ").when(F.col("lang") == "fr", "AH, yes ").otherwise("Well ")
    docs = t.texts.withColumn("text", F.concat(cry, "text"))
    return terms.distinct_words(annotate.tokens(annotate.sentences(docs, "doc_id", "text")), "INTJ")


@query("ag12_lemmas_by_suffix", ann_docs() + " SELECT DISTINCT lemma FROM ann WHERE pos = 'NOUN' AND lemma LIKE '%tion'")
def ag12(t):
    return terms.lemmas_by_suffix(doc_tokens(t), "NOUN", "tion")


FRAMES = ["the", "of", "and", "is", "it", "in", "by", "than", "for", "with"]
FRAME_SQL = f"""
WITH {sents_sql(LABELLED_SQL, extra="quality")},
fr AS (SELECT id, sent_i, quality, list_filter(regexp_extract_all(lower(sentence), '{T.TOKEN}'), lambda x: x IN {sql_list(FRAMES)}) AS frames FROM sents),
fx AS (SELECT id, sent_i, quality, unnest(frames) AS frame, unnest(range(len(frames))) AS p FROM fr)"""


def frames(t):
    """Frame names per sentence, in list order: words that stand for frames."""
    sents = annotate.sentences(labelled(t), "doc_id", "text", ["quality"])
    names = F.filter(T.tokens(F.lower("sentence")), lambda w: w.isin(FRAMES))
    return sents.select("id", "sent_i", "quality", names.alias("frames"))


@query(
    "ag24_top_frames",
    FRAME_SQL + """ SELECT quality, frame, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, frame) AS rank
    FROM (SELECT quality, frame, count(*) AS n FROM fx GROUP BY ALL)) WHERE rank <= 10""",
)
def ag24(t):
    return terms.frame_frequencies(frames(t), "quality")


def combos(size: int) -> str:
    joins = " ".join(
        f"JOIN fx f{k} ON f{k}.id = f1.id AND f{k}.sent_i = f1.sent_i AND f{k}.p > f{k - 1}.p" for k in range(2, size + 1)
    )
    names = " || ' + ' || ".join(f"f{k}.frame" for k in range(1, size + 1))
    return FRAME_SQL + f""", c AS (SELECT f1.quality, {names} AS frames, count(*) AS n FROM fx f1 {joins} GROUP BY ALL)
SELECT quality, frames, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, frames) AS rank FROM c) WHERE rank <= 10"""


@query("ag25_frame_triples", combos(3))
def ag25_3(t):
    return terms.top_combinations(frames(t), 3, "quality")


# Shorter tuples are counted per position and extended, so no join runs over four positions.
QUADRUPLES = FRAME_SQL + """,
two AS (SELECT b.id, b.sent_i, b.quality, a.frame AS f1, b.frame AS f2, b.p, count(*) AS n FROM fx a JOIN fx b ON a.id = b.id AND a.sent_i = b.sent_i AND a.p < b.p GROUP BY ALL),
three AS (SELECT c.id, c.sent_i, c.quality, f1, f2, c.frame AS f3, c.p, sum(n) AS n FROM two JOIN fx c ON c.id = two.id AND c.sent_i = two.sent_i AND two.p < c.p GROUP BY ALL),
later AS (SELECT a.id, a.sent_i, a.p, b.frame AS f4, count(*) AS m FROM fx a JOIN fx b ON a.id = b.id AND a.sent_i = b.sent_i AND a.p < b.p GROUP BY ALL),
c AS (SELECT quality, f1 || ' + ' || f2 || ' + ' || f3 || ' + ' || f4 AS frames, CAST(sum(n * m) AS BIGINT) AS n FROM three JOIN later USING (id, sent_i, p) GROUP BY ALL)
SELECT quality, frames, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, frames) AS rank FROM c) WHERE rank <= 10"""


@query("ag25_frame_quadruples", QUADRUPLES)
def ag25_4(t):
    return terms.top_combinations(frames(t), 4, "quality")


@query("ag26_vocabulary", FRAME_SQL + " SELECT DISTINCT frame AS name FROM fx")
def ag26(t):
    return terms.vocabulary(frames(t))


@query(
    "ag27_source_counts",
    f"SELECT source, count(*) AS n FROM (SELECT {CORE_EXPR} AS source FROM (SELECT DISTINCT url, string_split({HOST}, '.') AS p FROM pages)) GROUP BY source",
)
def ag27(t):
    return terms.source_counts(t.pages)


@query("ag28_domain_counts", f"SELECT regexp_replace({HOST}, '^www[.]', '') AS domain, count(*) AS n FROM pages GROUP BY ALL")
def ag28(t):
    return terms.domain_counts(t.pages)


@query(
    "ag35_filled_share",
    """SELECT count(quality) AS n_filled, count(*) AS n_total, round(count(quality) / count(*), 6) AS share
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def ag35(t):
    rows = lookup.attach(t.documents.select("doc_id"), t.labels, "doc_id")
    return rounded(terms.filled_share(rows, "quality"))


def lexicon(t):
    words = t.documents.select(
        F.col("lang").alias("category"), F.explode(F.array_distinct(T.tokens(F.lower("text")))).alias("entry")
    )
    return words.distinct()


@query(
    "ag36_lexicon_overlaps",
    f"""SELECT entry, count(DISTINCT lang) AS n_categories FROM (SELECT DISTINCT lang, unnest(list_distinct(regexp_extract_all(lower(text), '{T.TOKEN}'))) AS entry
    FROM documents) GROUP BY entry HAVING count(DISTINCT lang) > 1""",
)
def ag36(t):
    return terms.lexicon_overlaps(lexicon(t))


@query(
    "ag36_multiword_entries",
    f"""SELECT entry, n_tokens FROM (SELECT DISTINCT p_name AS entry, len(regexp_extract_all(p_name, '{T.TOKEN}')) AS n_tokens FROM part) WHERE n_tokens > 1""",
)
def ag36_multi(t):
    return terms.multiword_entries(t.part.select(F.col("p_name").alias("entry")).distinct())
