"""Sentence pairs and the rules of topic continuity, over the conversations."""

from pyspark.sql import functions as F

from rostrum.catalog.base import DEP_RULE, HEAD_RULE, ann_docs, ann_sql, doc_tokens, q, query, rounded, sents_sql, sql_list, toks_sql, with_parse
from rostrum.functions import fixed
from rostrum.functions import text as T
from rostrum.operators import annotate, segment, topic

ROLE = "CASE WHEN turn = 0 THEN 'beginning' WHEN role = 'user' THEN 'inside' WHEN role = 'assistant' AND turn % 3 = 0 THEN 'beginning' ELSE 'outside' END"
PAIRS = f"""
r0 AS (SELECT conv_id, turn, text, {ROLE} AS r FROM conversations),
r1 AS (SELECT conv_id, turn, text, CASE WHEN turn > 0 AND r = 'beginning' THEN 'inside' ELSE r END AS r FROM r0),
p0 AS (SELECT conv_id, turn AS i, text AS s1, lead(text) OVER w AS s2, r AS ra, lead(r) OVER w AS rb FROM r1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p1 AS (SELECT conv_id, i, s1, s2, CASE WHEN rb = 'inside' AND ra IN ('inside', 'beginning') THEN 'continue'
  WHEN ra = 'outside' AND rb = 'inside' THEN 'not_continue' WHEN ra IN ('inside', 'beginning') AND rb = 'outside' THEN 'not_continue' END AS label FROM p0),
pairs AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS id, * FROM p1 WHERE label IS NOT NULL)"""
PAIR_TOKS = f"""
sents AS (SELECT id, 1 AS sent_i, s1 AS sentence FROM pairs UNION ALL SELECT id, 2, s2 FROM pairs),{toks_sql()},{ann_sql()}"""
BASE = f"WITH {PAIRS},{PAIR_TOKS}"


def pairs(t):
    rows = t.turns.withColumn("role", F.expr(ROLE))
    out = topic.sentence_pairs(rows, "conv_id", "turn", "text", "role")
    return out.withColumn("id", F.concat_ws("-", "conv_id", "i"))


def pair_tokens(t):
    return topic.pair_tokens(pairs(t), lambda s: with_parse(annotate.tokens(s)))


@query("jn10_sentence_pairs", f"WITH {PAIRS} SELECT conv_id, i, s1, s2, label FROM pairs")
def jn10(t):
    return pairs(t).drop("id")


# Documents whose sentences carry a role, as arrays.
ARRAY_ROLE = "CASE WHEN {i} = 0 OR length({s}) % 7 = 0 THEN 'beginning' WHEN length({s}) % 3 = 0 THEN 'outside' ELSE 'inside' END"


@query(
    "jn10_array_pairs",
    f"""WITH {sents_sql()}, r0 AS (SELECT id, sent_i, sentence, {ARRAY_ROLE.format(i='sent_i', s='sentence')} AS r FROM sents),
r1 AS (SELECT id, sent_i, sentence, CASE WHEN sent_i > 0 AND r = 'beginning' THEN 'inside' ELSE r END AS r FROM r0),
p AS (SELECT id, sent_i AS i, sentence AS s1, lead(sentence) OVER w AS s2, r AS ra, lead(r) OVER w AS rb FROM r1 WINDOW w AS (PARTITION BY id ORDER BY sent_i))
SELECT * FROM (SELECT id, i, s1, s2, CASE WHEN rb = 'inside' AND ra IN ('inside', 'beginning') THEN 'continue'
  WHEN ra = 'outside' AND rb = 'inside' THEN 'not_continue' WHEN ra IN ('inside', 'beginning') AND rb = 'outside' THEN 'not_continue' END AS label FROM p) WHERE label IS NOT NULL""",
)
def jn10_arrays(t):
    def role(s, i):
        first = (i == 0) | (F.length(s) % 7 == 0)
        return F.when(first, "beginning").when(F.length(s) % 3 == 0, "outside").otherwise("inside")

    nested = F.transform(
        T.sentences("text"), lambda s, i: F.struct(s.alias("sentence"), role(s, i).alias("role"))
    )
    rows = t.texts.select(F.col("doc_id").cast("string").alias("id"), nested.alias("text"))
    return topic.array_pairs(rows, "id", "text")


N = lambda c: f"len(regexp_extract_all({c}, '{T.TOKEN}'))"


@query(
    "jn11_short_pairs",
    f"WITH {PAIRS} SELECT id, label FROM pairs WHERE {N(chr(115) + '1')} + {N('s2')} + 3 <= 512 AND {N('s1')} + {N('s2')} + 9 <= 510",
)
def jn11(t):
    return topic.short_pairs(pairs(t)).select("id", "label")


def shared(keys, kind, where, word="lemma") -> str:
    return f"""SELECT id, '{kind}' AS kind, {word} AS s1_word, min(i) FILTER (WHERE side = 1) AS s1_i, {word} AS s2_word, min(i) FILTER (WHERE side = 2) AS s2_i
    FROM {where} GROUP BY id, {keys} HAVING count(*) FILTER (WHERE side = 1) > 0 AND count(*) FILTER (WHERE side = 2) > 0"""


LEXICAL = f"""lx AS (SELECT id, sent_i AS side, i, lower(lemma) AS lemma FROM ann WHERE (pos IN {sql_list(fixed.CONTENT_POS)} OR word IN {sql_list(fixed.REFERENTIAL_PRONOUNS)}
  OR (word = 'that' AND pos = 'DET')) AND lemma NOT IN {sql_list(fixed.IGNORED_UNITS)})"""
SYNTACTIC = """sx AS (SELECT a.id, a.sent_i AS side, a.i, a.lemma, a.dep, h.lemma AS head FROM ann a JOIN ann h ON a.id = h.id AND a.sent_i = h.sent_i AND a.head_i = h.i WHERE a.dep <> 'punct')"""


@query("tp03_lexical_links", f"{BASE},{LEXICAL} {shared('lemma', 'lexical', 'lx')}")
def tp03(t):
    return topic.lexical_links(pair_tokens(t))


@query("tp04_syntactic_links", f"{BASE},{SYNTACTIC} {shared('head, lemma, dep', 'syntactic', 'sx')}")
def tp04(t):
    return topic.syntactic_links(pair_tokens(t))


# A lemma takes the embedding whose number follows from its letters.
KEY = "(ascii(lemma) * 31 + length(lemma) * 7 + ascii(right(lemma, 1)) * 3)"
VECTORS = f"""nv AS (SELECT count(*) AS n FROM embeddings),
vs AS MATERIALIZED (SELECT lemma, embedding FROM (SELECT DISTINCT lower(lemma) AS lemma FROM ann), nv JOIN embeddings ON vec_id = {KEY} % n)"""
SEMANTIC = f"""{VECTORS},
un AS MATERIALIZED (SELECT id, sent_i AS side, lower(lemma) AS lemma, list(i) AS at FROM ann WHERE pos IN {sql_list(fixed.SEMANTIC_POS)} GROUP BY ALL),
lp AS MATERIALIZED (SELECT DISTINCT a.lemma AS x, b.lemma AS y FROM un a JOIN un b ON a.id = b.id AND a.side = 1 AND b.side = 2 AND a.lemma <> b.lemma),
cs AS MATERIALIZED (SELECT x, y, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) AS c FROM lp JOIN vs v ON x = v.lemma JOIN vs w ON y = w.lemma),
sm AS (SELECT a.id, a.lemma AS s1_word, b.lemma AS s2_word, a.at AS t1, b.at AS t2, c FROM un a JOIN un b ON a.id = b.id AND a.side = 1 AND b.side = 2 JOIN cs ON x = a.lemma AND y = b.lemma WHERE c >= 0.75)"""


def vectors(t, toks):
    n = t.embeddings.agg(F.count(F.lit(1))).scalar()
    lemmas = toks.select(F.lower("lemma").alias("lemma")).distinct()
    keyed = lemmas.withColumn("vec_id", F.expr(KEY).cast("long") % n)
    return keyed.join(t.embeddings.select("vec_id", "embedding"), "vec_id").select("lemma", "embedding")


@query("tp05_semantic_links", f"{BASE},{SEMANTIC} SELECT DISTINCT id, s1_word, s2_word, round(c, 5) AS similarity FROM sm")
def tp05(t):
    toks = pair_tokens(t)
    out = topic.semantic_links(toks, vectors(t, toks), score=True)
    return out.select("id", "s1_word", "s2_word", F.round("similarity", 5).alias("similarity")).distinct()


@query(
    "jn12_similar_tokens",
    f"""{BASE},{SEMANTIC} SELECT id, s1_i, unnest(t2) AS s2_i FROM (SELECT id, unnest(t1) AS s1_i, t2 FROM sm)""",
)
def jn12(t):
    toks = pair_tokens(t)
    return topic.semantic_links(toks, vectors(t, toks)).select("id", "s1_i", "s2_i")


# Words that start sentences of the test texts stand for the markers.
GO, SHIFT = ["the", "is", "les", "der", "of"], ["and", "to", "que", "die", "a"]
MARKS = f"""tm AS (SELECT id, CASE WHEN w IN {sql_list(GO)} THEN 'transition_continue' WHEN w IN {sql_list(SHIFT)} THEN 'transition_shift' END AS kind, w AS s2_word
  FROM (SELECT id, lower(regexp_extract(s2, '{T.TOKEN}')) AS w FROM pairs))"""


@query("tp06_transition_markers", f"WITH {PAIRS},{MARKS} SELECT id, kind, s2_word FROM tm WHERE kind IS NOT NULL")
def tp06(t):
    return topic.transition_markers(pairs(t), "s2", GO, SHIFT).select("id", "kind", "s2_word")


def coref(t):
    """Repeated long words of a pair stand for a cluster of mentions."""
    toks = pair_tokens(t).filter((F.length("text") >= 6) & F.col("is_alpha"))
    n1 = lengths(t)
    rows = toks.join(n1, "id").withColumn("start", F.col("i") + F.when(F.col("side") == 2, F.col("n1")).otherwise(0))
    return rows.select("id", F.crc32(F.lower("text").cast("binary")).alias("cluster_id"), "text", F.col("start").cast("int").alias("start"))


def lengths(t):
    return pairs(t).select("id", T.n_tokens("s1").alias("n1"))


COREF = f"""n1 AS (SELECT id, {N('s1')} AS n1 FROM pairs),
cm AS (SELECT id, lower(text) AS k, text, i + CASE WHEN sent_i = 2 THEN n1 ELSE 0 END AS start, n1 - 1 AS edge FROM ann JOIN n1 USING (id) WHERE length(text) >= 6 AND is_alpha),
cc AS (SELECT id, k, min(start) FILTER (WHERE start < edge) AS s1_i, min(start) FILTER (WHERE start >= edge) AS s2_i FROM cm GROUP BY id, k
  HAVING NOT bool_and(start < edge) AND NOT bool_and(start > edge) AND NOT count(*) = 2)"""


@query("tp07_coreference_links", f"""{BASE},{COREF} SELECT cc.id, 'coreference' AS kind, a.text AS s1_word, s1_i, b.text AS s2_word, s2_i FROM cc
  JOIN cm a ON a.id = cc.id AND a.k = cc.k AND a.start = s1_i JOIN cm b ON b.id = cc.id AND b.k = cc.k AND b.start = s2_i""")
def tp07(t):
    return topic.coreference_links(coref(t), lengths(t)).select("id", "kind", "s1_word", "s1_i", "s2_word", "s2_i")


FOUND = f"""{BASE},{LEXICAL},{SYNTACTIC},{SEMANTIC},{MARKS},{COREF},
fd AS (SELECT DISTINCT id, kind FROM (SELECT id, kind FROM ({shared('lemma', 'lexical', 'lx')}) UNION ALL SELECT id, kind FROM ({shared('head, lemma, dep', 'syntactic', 'sx')})
  UNION ALL SELECT id, 'semantic' FROM sm UNION ALL SELECT id, 'coreference' FROM cc UNION ALL SELECT id, kind FROM tm WHERE kind IS NOT NULL)),
od AS (SELECT * FROM (VALUES ('lexical', 1), ('syntactic', 2), ('semantic', 3), ('coreference', 4), ('transition_continue', 5), ('transition_shift', 6)) v(kind, o)),
cl AS (SELECT pairs.id, any_value(label) AS label, coalesce(string_agg(kind, ',' ORDER BY o), '') AS kinds,
  CASE WHEN count(*) FILTER (WHERE o < 6) > 0 THEN 'continue' ELSE 'not_continue' END AS rule_label, count(o) AS n,
  coalesce(string_agg(kind, ' + ' ORDER BY kind), '') AS combination, arg_min(kind, o) AS first_kind
  FROM pairs LEFT JOIN (fd JOIN od USING (kind)) f ON pairs.id = f.id GROUP BY pairs.id)"""


def classified(t):
    p = pairs(t).select("id", "s1", "s2", "label")
    toks = pair_tokens(t)
    found = [
        topic.lexical_links(toks), topic.syntactic_links(toks), topic.semantic_links(toks, vectors(t, toks)),
        topic.transition_markers(p, "s2", GO, SHIFT), topic.coreference_links(coref(t), lengths(t)),
    ]
    return topic.classify(p, found).select("id", "label", "kinds", "rule_label")


@query("tp08_classify", f"{FOUND} SELECT id, label, kinds, rule_label FROM cl")
def tp08(t):
    return classified(t).withColumn("kinds", F.array_join("kinds", ","))


@query("tp09_disagreements", f"{FOUND} SELECT id, label, rule_label FROM cl WHERE label <> rule_label")
def tp09(t):
    return topic.disagreements(classified(t)).select("id", "label", "rule_label")


@query("ag29_kind_counts", f"{FOUND} SELECT kind, count(*) AS n FROM fd GROUP BY kind")
def ag29(t):
    return topic.kind_counts(classified(t))


@query("ag29_concurrency_counts", f"{FOUND} SELECT CAST(n AS INT) AS n_kinds, count(*) AS n FROM cl WHERE n > 0 GROUP BY ALL")
def ag29_concurrent(t):
    return topic.concurrency_counts(classified(t))


@query("ag29_combination_counts", f"{FOUND} SELECT combination, count(*) AS n FROM cl WHERE n > 0 GROUP BY ALL")
def ag29_combinations(t):
    return topic.combination_counts(classified(t))


@query("ag30_first_kind_counts", f"{FOUND} SELECT first_kind AS kind, count(*) AS n FROM cl WHERE rule_label = 'continue' GROUP BY ALL")
def ag30(t):
    return topic.first_kind_counts(classified(t))


@query(
    "jn13_align",
    f"""{BASE},{LEXICAL},{MARKS}, n1 AS (SELECT id, {N('s1')} AS n1 FROM pairs),
fd AS ({shared('lemma', 'lexical', 'lx')} UNION ALL SELECT id, kind, NULL, NULL, s2_word, 0 FROM tm WHERE kind IS NOT NULL),
sd AS (SELECT id, kind, 's1' AS side, s1_word AS word, s1_i AS i FROM fd UNION ALL SELECT id, kind, 's2', s2_word, s2_i FROM fd),
ps AS (SELECT sd.*, i + CASE WHEN side = 's2' THEN n1 ELSE 0 END AS pos_i FROM sd JOIN n1 USING (id) WHERE word IS NOT NULL),
tx AS (SELECT id, i + CASE WHEN sent_i = 2 THEN n1 ELSE 0 END AS pos_i, text AS feature, length(text) / 10 AS value FROM ann JOIN n1 USING (id))
SELECT ps.id, ps.pos_i, kind, side, word, ps.i, feature, round(value, 6) AS value, label, lower(word) IS DISTINCT FROM lower(feature) AS mismatch
FROM ps LEFT JOIN tx ON tx.id = ps.id AND tx.pos_i = ps.pos_i JOIN pairs ON pairs.id = ps.id""",
)
def jn13(t):
    toks = pair_tokens(t)
    found = topic.lexical_links(toks).unionByName(topic.transition_markers(pairs(t), "s2", GO, SHIFT))
    n1 = lengths(t)
    pos = F.col("i") + F.when(F.col("side") == 2, F.col("n1")).otherwise(0)
    att = toks.join(n1, "id").select(
        "id", pos.cast("int").alias("pos_i"), F.col("text").alias("feature"), (F.length("text") / 10).alias("value")
    )
    return rounded(topic.align(found, n1, att, pairs(t).select("id", "label")))


# --- issues ------------------------------------------------------------------------------

ISSUES = "iss AS (SELECT DISTINCT id, sent_i, lemma AS issue FROM ann WHERE lemma LIKE '%tion' OR i = 0)"


@query(
    "tp01_main_topic",
    ann_docs() + f""",{ISSUES}, rt AS (SELECT id, sent_i, min(i) AS r FROM ann WHERE dep = 'ROOT' GROUP BY ALL)
    SELECT DISTINCT a.id, a.sent_i, issue FROM ann a JOIN iss ON a.id = iss.id AND a.sent_i = iss.sent_i AND lemma = issue JOIN rt ON a.id = rt.id AND a.sent_i = rt.sent_i
    WHERE dep IN {sql_list(fixed.TOPIC_DEPS)} AND abs(i - r) <= 7""",
)
def tp01(t):
    toks = with_parse(doc_tokens(t))
    issues = toks.filter(F.col("lemma").like("%tion") | (F.col("i") == 0)).select("id", "sent_i", F.col("lemma").alias("issue"))
    return topic.main_topic(toks, issues)


@query("tp02_mentions_lemma", ann_docs() + " SELECT id, sent_i, bool_or(lemma = 'be') AS has_lemma FROM ann GROUP BY id, sent_i")
def tp02(t):
    return topic.mentions_lemma(doc_tokens(t), "be")
