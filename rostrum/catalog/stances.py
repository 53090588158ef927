"""Stance hits, vectors, constructions, anonymisation and the gazetteer.

The test texts are invented: words that occur in them stand for the lexicons, and "the"
stands for the negator.
"""

from pyspark.sql import functions as F

from rostrum.catalog.base import (
    ANN_LABELLED, Tables, ann_docs, doc_sentences, doc_tokens, labelled, labelled_tokens, q, query, r6, rounded, sents_sql,
    sql_list, tagged_sentences, with_parse,
)
from rostrum.catalog.statistics import SENT_FEATURES
from rostrum.functions import fixed
from rostrum.functions import text as T
from rostrum.operators import annotate, anonymize, features, gazetteer, spans, stance, terms

WORDS = {
    ("positive", "ADJ"): ["ble", "thble"], ("negative", "ADJ"): ["erble", "onble", "anble"],
    ("certainty", "ADV"): ["ly", "thly"], ("doubt", "ADV"): ["erly", "only", "hely"],
    ("emphatic", "VERB"): ["ed", "thed"], ("hedge", "VERB"): ["ing", "thing", "ered"],
    ("pro", "VERB"): ["ed", "reed"], ("con", "ADJ"): ["ble", "heble"],
}
PHRASES = {
    ("positive", "ADJ"): ["the the", "of the"], ("doubt", "ADV"): ["and the of", "be the"],
    ("predictive_modal", ""): ["the to"],
}
ROWS = [(c, p, e) for table in (WORDS, PHRASES) for (c, p), es in table.items() for e in es]
FEATS = sorted({(c, p) for c, p, _ in ROWS} | {(fixed.OPPOSITES[c], p) for c, p in WORDS})
LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(p)}, {q(e)})" for c, p, e in ROWS) + ") v(category, pos, entry))"
OPP = "opp AS (SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)})" for a, b in fixed.OPPOSITES.items()) + ") o(a, b))"
AROUND = """ar AS (SELECT *, lag(lower(text)) OVER w AS b1, lag(lower(text), 2) OVER w AS b2, lead(lemma) OVER w AS n1, lead(lemma, 2) OVER w AS n2
  FROM ann WINDOW w AS (PARTITION BY id, sent_i ORDER BY i))"""
WORD_HITS = """SELECT id, sent_i, category, lex.pos, 'word' AS kind, i AS start, i + 1 AS "end" FROM ar JOIN lex ON ar.lemma = entry AND (lex.pos = '' OR lex.pos = ar.pos)"""
PHRASE_HITS = """SELECT id, sent_i, category, lex.pos, 'phrase' AS kind, i AS start, i + 2 AS "end" FROM ar JOIN lex ON lemma || ' ' || n1 = entry
  UNION ALL SELECT id, sent_i, category, lex.pos, 'phrase', i, i + 3 FROM ar JOIN lex ON lemma || ' ' || n1 || ' ' || n2 = entry"""
NEG_HITS = """SELECT id, sent_i, opp.b AS category, lex.pos, 'negation' AS kind, CASE WHEN b1 = 'the' THEN i - 1 ELSE i - 2 END AS start, i + 1 AS "end"
  FROM ar JOIN lex ON lemma = entry JOIN opp ON category = a
  WHERE NOT contains(entry, ' ') AND (b1 = 'the' OR (lex.pos = 'ADJ' AND b1 IN ('-', '–') AND b2 = 'the')) AND (lex.pos <> 'VERB' OR ar.pos = 'VERB')"""
BASE = ann_docs() + f",{LEX},{OPP},{AROUND}"


def lexicon(t):
    return t.spark.createDataFrame(ROWS, "category string, pos string, entry string")


def gathered(t, sents=None):
    return annotate.gathered(doc_sentences(t) if sents is None else sents, fields=FIELDS)


FIELDS = ("i", "text", "lemma", "pos")
NEG = {"negators": ("the",), "plain": "the"}


@query("st01_word_hits", f"{BASE} {WORD_HITS}")
def st01(t):
    return stance.word_hits(doc_tokens(t), lexicon(t))


@query("st02_phrase_hits", f"{BASE} {PHRASE_HITS}")
def st02(t):
    return stance.phrase_hits(tagged_sentences(t, fields=FIELDS), lexicon(t))


@query("st03_negation_hits", f"{BASE} {NEG_HITS}")
def st03(t):
    return stance.negation_hits(tagged_sentences(t, fields=FIELDS), lexicon(t), **NEG)


# Modals are put in front of the sentences, for they do not occur in the texts.
MODAL_SOURCE = """(SELECT doc_id, CASE lang WHEN 'en' THEN 'We must go to it and may have to. ' WHEN 'de' THEN 'It would ought to be. ' ELSE 'They can. ' END || text AS text FROM documents)"""
MODAL_ROWS = [(f"{k}_modal", "", e) for tb in (fixed.MODALS, fixed.MODAL_PHRASES) for k, es in tb.items() for e in es]
MODAL_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(p)}, {q(e)})" for c, p, e in MODAL_ROWS) + ") v(category, pos, entry))"


@query(
    "st04_modal_hits",
    ann_docs(source=MODAL_SOURCE) + f",{MODAL_LEX},{AROUND} {WORD_HITS} UNION ALL {PHRASE_HITS}",
)
def st04(t):
    front = (
        F.when(F.col("lang") == "en", "We must go to it and may have to. ")
        .when(F.col("lang") == "de", "It would ought to be. ").otherwise("They can. ")
    )
    docs = t.texts.withColumn("text", F.concat(front, "text"))
    sents = gathered(t, annotate.sentences(docs, "doc_id", "text"))
    return stance.hit_rows(stance.with_hits(sents, stance.modal_lexicon(t.spark), ("word", "phrase")))


# Spans of kept tokens by pattern; longest first, then leftmost, those that overlap an earlier one are dropped.
PATTERN_HITS = f"""
kt AS (SELECT id, sent_i, k, pos, lemma, lead(lower(text)) OVER w AS w1, lead(lemma) OVER w AS l1, lead(pos) OVER w AS p1, lead(pos, 2) OVER w AS p2
  FROM (SELECT *, row_number() OVER (PARTITION BY id, sent_i ORDER BY i) - 1 AS k FROM ann WHERE text NOT IN {sql_list(fixed.DROPPED_PUNCT)})
  WINDOW w AS (PARTITION BY id, sent_i ORDER BY k)),
sp AS (SELECT id, sent_i, 'pro' AS category, 'VERB' AS pos, k AS start, k + 2 AS "end" FROM kt WHERE pos = 'VERB' AND p1 IN ('ADV', 'ADJ')
  UNION SELECT id, sent_i, 'pro', 'VERB', k, k + 3 FROM kt WHERE pos = 'VERB' AND w1 IN ('the', 'of') AND p2 IN ('ADV', 'ADJ')
  UNION SELECT id, sent_i, 'con', 'ADJ', k, k + 2 FROM kt WHERE pos = 'ADJ' AND (l1 IN ('of', 'the') OR p1 = 'NOUN')),
gr AS (SELECT id, sent_i, category, pos, list_reduce(list([struct_pack(s := start, e := "end")] ORDER BY start - "end", start),
  lambda kept, x: CASE WHEN len(list_filter(kept, lambda h: x[1].s < h.e AND x[1].e > h.s)) > 0 THEN kept ELSE list_concat(kept, x) END) AS kept
  FROM sp GROUP BY ALL)
SELECT id, sent_i, category, pos, m.s AS start, m.e AS "end" FROM (SELECT id, sent_i, category, pos, unnest(kept) AS m FROM gr)"""


@query("st05_pattern_hits", f"{ann_docs()},{PATTERN_HITS}")
def st05(t):
    return stance.pattern_hits(tagged_sentences(t, fields=FIELDS), PATTERNS).drop("kind")


PATTERNS = {
    ("pro", "VERB"): [[("pos", ["VERB"]), [("lower", ["the", "of"])], ("pos", ["ADV", "ADJ"])]],
    ("con", "ADJ"): [[("pos", ["ADJ"]), ("lemma", ["of", "the"])], [("pos", ["ADJ"]), ("pos", ["NOUN"])]],
}


KEPT = f"""kp AS (SELECT id, sent_i, i, text, row_number() OVER (PARTITION BY id, sent_i ORDER BY i) - 1 AS k FROM ann WHERE text NOT IN {sql_list(fixed.DROPPED_PUNCT)})"""


@query("st06_kept_tokens", ann_docs() + f",{KEPT} SELECT id, sent_i, k, i, text FROM kp")
def st06(t):
    return stance.kept_tokens(tagged_sentences(t, fields=("i", "text")))


FEAT_LIST = "(VALUES " + ", ".join(f"({q(c)}, {q(p)}, {q(stance.feature_name(c, p))})" for c, p in FEATS) + ") f(category, pos, name)"
HITS = f"hits AS ({WORD_HITS} UNION ALL {PHRASE_HITS} UNION ALL {NEG_HITS})"
VECTORS = f"""{BASE},{HITS},{KEPT},
cov AS (SELECT DISTINCT kp.id, kp.sent_i, kp.k, h.category, h.pos FROM kp JOIN hits h ON kp.id = h.id AND kp.sent_i = h.sent_i AND kp.i >= h.start AND kp.i < h."end"),
vec AS (SELECT kp.id, kp.sent_i, f.name, string_agg(CASE WHEN cov.k IS NULL THEN '0' ELSE '1' END, '' ORDER BY kp.k) AS v
  FROM kp CROSS JOIN {FEAT_LIST} LEFT JOIN cov ON cov.id = kp.id AND cov.sent_i = kp.sent_i AND cov.k = kp.k AND cov.category = f.category AND cov.pos = f.pos
  GROUP BY kp.id, kp.sent_i, f.name)"""


def stance_vectors(t, words_only=False):
    kinds = ("word",) if words_only else ("word", "phrase", "negation")
    return stance.vectors(stance.with_hits(gathered(t), lexicon(t), kinds, **NEG), None, FEATS)


def long_vectors(vec):
    names = [stance.feature_name(c, p) for c, p in FEATS]
    rows = F.array(
        *[F.struct(F.lit(n).alias("name"), F.array_join(F.col(n).cast("array<string>"), "").alias("v")) for n in names]
    )
    return vec.select("id", "sent_i", F.explode(rows).alias("_r")).select("id", "sent_i", "_r.name", "_r.v").filter("v <> ''")


@query("st07_vectors", f"{VECTORS} SELECT id, sent_i, name, v FROM vec")
def st07(t):
    return long_vectors(stance_vectors(t))


def bits(groups) -> str:
    known = {stance.feature_name(c, p) for c, p in FEATS}
    out = []
    for name, members in groups.items():
        inside = [m for m in members if m in known]
        out.append(f"CAST(max(CASE WHEN name IN {sql_list(inside)} AND contains(v, '1') THEN 1 ELSE 0 END) AS INT) AS {name}")
    return ", ".join(out)


def known(groups):
    names = {stance.feature_name(c, p) for c, p in FEATS}
    return {g: [m for m in ms if m in names] for g, ms in groups.items()}


@query("st08_eight_bits", f"{VECTORS} SELECT id, sent_i, {bits(stance.EIGHT)} FROM vec GROUP BY id, sent_i")
def st08(t):
    vec = stance_vectors(t).filter(F.size("positive_adj") > 0)
    return stance.binary_features(vec, known(stance.EIGHT), ["id", "sent_i"])


@query("st09_six_bits", f"{VECTORS} SELECT id, sent_i, {bits(stance.SIX)} FROM vec GROUP BY id, sent_i")
def st09(t):
    vec = stance_vectors(t).filter(F.size("positive_adj") > 0)
    return stance.binary_features(vec, known(stance.SIX), ["id", "sent_i"])


@query("st10_word_vectors", VECTORS.replace(HITS, f"hits AS ({WORD_HITS})") + " SELECT id, sent_i, name, v FROM vec")
def st10(t):
    return long_vectors(stance_vectors(t, words_only=True))


VOCAB = ["the", "of", "is", "der", "les", "que", "tion", "zzz"]


@query(
    "st11_multi_hot",
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '{T.TOKEN}') AS ws FROM documents)
    SELECT doc_id, {' || '.join(f"CASE WHEN list_contains(ws, '{v}') THEN '1' ELSE '0' END" for v in VOCAB)} AS code,
    array_to_string(list_filter([{', '.join(q(v) for v in VOCAB)}], lambda x: list_contains(ws, x)), ',') AS names FROM w""",
)
def st11(t):
    code = t.texts.select("doc_id", T.encode_multi_hot(T.tokens("text"), VOCAB).alias("c"))
    return code.select(
        "doc_id", F.array_join(F.col("c").cast("array<string>"), "").alias("code"),
        F.array_join(T.decode_multi_hot("c", VOCAB), ",").alias("names"),
    )


@query(
    "ag23_feature_hits",
    ANN_LABELLED + f",{LEX},{OPP},{AROUND},{HITS} SELECT quality, hits.pos, category, kind, count(*) AS n FROM hits JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, quality FROM labels) USING (id) GROUP BY ALL",
)
def ag23(t):
    sents = gathered(t, annotate.sentences(labelled(t), "doc_id", "text"))
    hits = stance.all_hits(sents, None, lexicon(t), **NEG)
    classes = t.labels.select(F.col("doc_id").cast("string").alias("id"), "quality")
    return terms.feature_hits(hits.join(classes, "id"), "quality")


@query(
    "jn08_lexicon_join",
    ann_docs() + f",{LEX} SELECT id, sent_i, i, lemma, ann.pos, category FROM ann JOIN (SELECT DISTINCT * FROM lex) l ON lemma = entry AND ann.pos = l.pos",
)
def jn08(t):
    from rostrum.operators import attribution

    toks = doc_tokens(t).select("id", "sent_i", "i", "lemma", "pos")
    return attribution.lexicon_join(toks, lexicon(t)).select("id", "sent_i", "i", "lemma", "pos", "category")


# --- gazetteer ---------------------------------------------------------------------------

def gazetteer_table(t):
    # The first one, two and three words of each benchmark text.
    start = F.split(F.lower("text"), " ")
    heads = F.array(*[F.array_join(F.slice(start, 1, n), " ") for n in (1, 2, 3)])
    words = t.benchmark.select(F.explode(heads).alias("lemmatized")).distinct()
    names = t.nation.select(F.col("n_name").alias("exact"))
    return words.select(F.lit(None).cast("string").alias("exact"), F.lit("").alias("hyphenated"), "lemmatized").unionByName(
        names.select("exact", F.lit("").alias("hyphenated"), F.lit(None).cast("string").alias("lemmatized"))
    )


# Entries by their tokens, and the places of a sentence where they stand; longest first, then leftmost,
# those that overlap an earlier one are dropped.
HEADS = """heads AS (SELECT DISTINCT array_to_string(string_split(lower(text), ' ')[1:n], ' ') AS entry FROM benchmark, range(1, 4) r(n))"""
GAZETTEER = f"""{HEADS},
terms AS (SELECT DISTINCT kind, entry, regexp_extract_all(entry, {q(T.TOKEN)}) AS words FROM (
  SELECT 'lemma' AS kind, entry FROM heads UNION ALL SELECT 'text', n_name FROM nation) WHERE trim(entry) <> ''),
lists AS (SELECT id, sent_i, list(text ORDER BY i) AS texts, list(lemma ORDER BY i) AS lemmas FROM ann GROUP BY id, sent_i),
places AS (SELECT ann.id, ann.sent_i, ann.i, ann.text, ann.lemma, texts, lemmas FROM ann JOIN lists USING (id, sent_i)),
found AS (
  SELECT DISTINCT id, sent_i, i AS start, i + len(words) AS "end", entry, array_to_string(texts[i + 1:i + len(words)], ' ') AS text, lemma AS first_lemma
  FROM places JOIN terms ON CASE kind WHEN 'lemma' THEN lemma ELSE text END = words[1]
  WHERE CASE kind WHEN 'lemma' THEN lemmas ELSE texts END[i + 1:i + len(words)] = words),
greedy AS (SELECT id, sent_i, list_reduce(
    list([struct_pack(start := start, "end" := "end", entry := entry, text := text, first_lemma := first_lemma)] ORDER BY start - "end", start, entry),
    lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: x[1].start < k."end" AND x[1]."end" > k.start)) > 0 THEN kept ELSE list_concat(kept, x) END
  ) AS kept FROM found GROUP BY id, sent_i)
SELECT id, sent_i, m.start, m."end", m.entry, m.text, m.first_lemma FROM (SELECT id, sent_i, unnest(kept) AS m FROM greedy)"""


@query("jn09_match_phrases", f"{ann_docs()},{GAZETTEER}")
def jn09(t):
    return gazetteer.match_phrases(gathered(t), gazetteer.from_columns(gazetteer_table(t)))


GRAM = """g AS (SELECT id, sent_i, i AS start, i + 1 AS "end", lemma AS gram FROM ar UNION ALL SELECT id, sent_i, i, i + 2, lemma || ' ' || n1 FROM ar
  UNION ALL SELECT id, sent_i, i, i + 3, lemma || ' ' || n1 || ' ' || n2 FROM ar)"""


@query(
    "jn09_gram_rows",
    f"{ann_docs()},{AROUND},{GRAM},{HEADS} SELECT * FROM g WHERE gram IN (SELECT entry FROM heads)",
)
def jn09_grams(t):
    terms = gazetteer_table(t).select(F.col("lemmatized").alias("gram")).distinct()
    return spans.gram_rows(tagged_sentences(t, fields=FIELDS), "lemma", (1, 2, 3)).join(terms, "gram", "left_semi").select(
        "id", "sent_i", "start", "end", "gram"
    )


# --- anonymisation: e-mails and runs of digits stand for entities -----------------------------

MAIL, DIGITS = r"[A-Za-z0-9._+\-]+@[A-Za-z0-9.\-]+", r"\b\d+\b"


def entities(t):
    found = anonymize.spans_of(F.regexp_replace("text", r"[^\s]*@[^\s]*", "x"), DIGITS, "CARDINAL")
    return t.texts.select(F.col("doc_id").alias("id"), F.explode(found).alias("_e")).select("id", "_e.*")


SHORT = "regexp_replace(text, '[^\\s]*@[^\\s]*', 'x', 'g')"


def short_docs(t):
    return t.texts.select(F.col("doc_id").alias("id"), F.regexp_replace("text", r"[^\s]*@[^\s]*", "x").alias("text"))


@query("an01_anonymize", f"SELECT doc_id AS id, regexp_replace({SHORT}, '\\b\\d+\\b', 'CARDINAL', 'g') AS text FROM documents")
def an01(t):
    return anonymize.anonymize(short_docs(t), entities(t), fixed.CORE_ENTITY_LABELS).select("id", "text")


def mixed_entities(t):
    """Long runs of digits and words in -tion are other kinds of entity; the latter are not chosen."""
    kind = F.when(F.col("end") - F.col("start") >= 4, "MONEY").otherwise(F.col("label"))
    words = short_docs(t).select("id", F.explode(anonymize.spans_of("text", r"\b[a-z]+tion\b", "ORG")).alias("_e"))
    return entities(t).withColumn("label", kind).unionByName(words.select("id", "_e.*"))


@query(
    "an02_anonymize_chosen",
    f"SELECT doc_id AS id, regexp_replace({SHORT}, '\\b\\d{{4,}}\\b', 'MONEY', 'g') AS text FROM documents",
)
def an02(t):
    return anonymize.anonymize(short_docs(t), mixed_entities(t), ["MONEY", "PERSON"]).select("id", "text")


@query(
    "an03_anonymize_extra",
    f"SELECT doc_id AS id, regexp_replace(regexp_replace({SHORT}, '\\b\\d+\\b', 'CARDINAL', 'g'), 'the|of', '[ENTITY]', 'gi') AS text FROM documents",
)
def an03(t):
    return anonymize.anonymize(short_docs(t), entities(t), None, ["the", "of"]).select("id", "text")


@query(
    "an04_anonymize_pairs",
    """WITH p AS (SELECT a.conv_id, a.turn, '[CLS] ' || a.text || ' [SEP] ' || b.text || ' [SEP]' AS text
      FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, replace(replace(regexp_replace(text, '[a-z]+tion', 'ORG', 'g'), 'The', '[ENTITY]'), 'of', '[ENTITY]') AS text FROM p""",
)
def an04(t):
    a = t.turns.select("conv_id", "turn", F.col("text").alias("s1"))
    b = t.turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("s2"))
    pairs = a.join(b, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), anonymize.pair_text("s1", "s2", True).alias("text")
    )
    found = anonymize.spans_of("text", r"[a-z]+tion", "ORG")
    ents = pairs.select("id", F.explode(found).alias("_e")).select("id", "_e.*")
    return anonymize.anonymize_pairs(pairs, ents, ["The", "of"])


POOLS = {"NOUN": ["thing", "item", "part"], "VERB": ["make", "take"], "ADV": ["now"]}


BIASED = ["ed", "ing", "ly", "thly", "thatin", "rewh"]
CHOICE = "CAST('0x' || substr(md5('42-' || id || '-' || sent_i || '-' || i), 1, 8) AS BIGINT)"
PICKED = " ".join(
    f"WHEN pos = '{pos}' THEN [{', '.join(map(q, pool))}][{CHOICE} % {len(pool)} + 1]" for pos, pool in POOLS.items()
)
# White space after a token belongs to it.
NEUTRAL = f"""{ann_docs()},
ws AS (SELECT id, sent_i, unnest(pieces) AS piece, unnest(range(len(pieces))) AS i FROM (
  SELECT id, sent_i, regexp_extract_all(sentence, '(?:{T.TOKEN})\\s*') AS pieces FROM sents)),
pk AS (SELECT id, sent_i, i, CASE WHEN lemma NOT IN {sql_list(BIASED)} OR is_stop OR kind = 'punct' THEN text {PICKED} ELSE text END
  || substr(piece, length(text) + 1) AS w FROM ann JOIN ws USING (id, sent_i, i))
SELECT id, string_agg(w, '' ORDER BY sent_i, i) AS text FROM pk GROUP BY id"""


def neutral(t):
    return anonymize.neutralize(doc_tokens(t), BIASED, POOLS)


@query("an05_neutralize", NEUTRAL)
def an05(t):
    fields = ("i", "text", "ws", "lemma", "pos", "is_punct", "is_stop")
    return anonymize.neutralize(annotate.gathered(doc_sentences(t), fields=fields), BIASED, POOLS)


def document_means_sql(ann: str) -> str:
    means = ", ".join(f"avg({f}) AS {f}" for f in features.SENTENCE_FEATURES)
    return f"({ann},{SENT_FEATURES} SELECT id, {means}, sum(chars) / sum(sentence_length) AS word_length FROM fs GROUP BY id)"


@query(
    "an06_feature_shift",
    f"SELECT b.id, " + ", ".join(
        f"round(b.{f}, 6) AS {f}_before, round(a.{f}, 6) AS {f}_after, round(a.{f} - b.{f}, 6) AS {f}_shift" for f in features.FEATURES)
    + f" FROM {document_means_sql(ann_docs())} b JOIN {document_means_sql(ann_docs(source=f'(SELECT id AS doc_id, text FROM ({NEUTRAL}))'))} a USING (id)",
)
def an06(t):
    toks = doc_tokens(t)
    changed = annotate.tokens(annotate.sentences(neutral(t), "id", "text"))
    before, after = (features.document_means(with_parse(x)) for x in (toks, changed))
    return rounded(anonymize.feature_shift(before, after))


CLASSES = {
    "interjection": ("pos = 'INTJ'", "length(text) - 4"),
    "nominalization": (f"regexp_matches(word, '({'|'.join(fixed.NOMINAL_SUFFIXES)})$')", "length(text) - 4"),
    "discourse_marker": (f"word IN {sql_list(fixed.DISCOURSE_MARKERS)}", "length(text) - 4"),
    "modal_verb": ("tag = 'MD'", "length(text) - 4"),
    "personal_pronoun": (f"word IN {sql_list(fixed.PERSONAL_PRONOUNS)}", "length(text) - 4"),
    "lexical_word": (f"pos IN {sql_list(fixed.LEXICAL_POS)}", "length(text) - 4"),
    "word_length": ("true", "length(text)"),
}


@query(
    "ag33_lexical_classes",
    ann_docs() + ", kc AS (SELECT * FROM ann WHERE word <> 'entity' AND NOT is_punct), bk AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS bucket, {v} AS value FROM kc WHERE {ok}" for n, (ok, v) in CLASSES.items())
    + ") SELECT bucket, count(*) AS n, round(avg(value), 6) AS mean FROM bk GROUP BY bucket",
)
def ag33(t):
    from rostrum.operators import attribution

    toks = doc_tokens(t).withColumn("value", F.length("text").cast("double") - 4)
    return attribution.lexical_classes(toks).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("value"), "mean")
    )
