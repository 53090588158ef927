"""Features, descriptive statistics, class comparison and distribution shapes."""

from pyspark.sql import functions as F

from rostrum.catalog.base import (
    ANN_LABELLED, LABELLED_SQL, Tables, ann_docs, doc_tokens, labelled_tokens, query, r6,
    rounded, sql_list, with_parse,
)
from rostrum.functions import fixed, tails
from rostrum.functions import text as T
from rostrum.operators import annotate, curate, features, stats
from rostrum.streaming import resume

SUFFIX = "(" + "|".join(fixed.NOMINAL_SUFFIXES) + ")$"
SENT_FEATURES = f"""
fs AS (SELECT id, sent_i,
  count(*) FILTER (WHERE is_alpha) AS sentence_length,
  count(*) FILTER (WHERE dep IN {sql_list(fixed.CLAUSE_DEPS)}) AS sentence_complexity,
  count(*) FILTER (WHERE word IN {sql_list(fixed.PERSONAL_PRONOUNS)}) AS personal_pronoun_d,
  count(*) FILTER (WHERE dep = 'auxpass') AS passive_voice_d,
  count(*) FILTER (WHERE pos = 'NOUN' AND regexp_matches(word, '{SUFFIX}')) AS nominalization_d,
  count(*) FILTER (WHERE pos IN {sql_list(fixed.LEXICAL_POS)}) AS lexical_d,
  count(*) FILTER (WHERE pos = 'INTJ') AS interjection_d,
  count(*) FILTER (WHERE tag = 'MD') AS modal_verb_d,
  count(*) FILTER (WHERE lemma IN {sql_list(fixed.DISCOURSE_MARKERS)}) AS discourse_marker_d,
  string_agg(CAST(length(text) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE is_alpha) AS word_length,
  sum(length(text)) FILTER (WHERE is_alpha) AS chars
  FROM ann GROUP BY id, sent_i HAVING count(*) FILTER (WHERE is_alpha) > 0)"""
SF = features.SENTENCE_FEATURES


@query(
    "ag01_sentence_features",
    ann_docs() + "," + SENT_FEATURES + f" SELECT id, sent_i, {', '.join(SF)}, word_length FROM fs",
)
def ag01(t):
    out = features.sentence_features(with_parse(doc_tokens(t)))
    return out.withColumn("word_length", F.array_join(F.col("word_length").cast("array<string>"), ","))


@query(
    "ag01_document_features",
    ann_docs() + "," + SENT_FEATURES + " SELECT id, "
    + ", ".join(f"string_agg(CAST({f} AS VARCHAR), ',' ORDER BY sent_i) AS {f}" for f in features.FEATURES)
    + " FROM fs GROUP BY id",
)
def ag01_docs(t):
    out = features.linguistic_features(with_parse(doc_tokens(t)))
    return out.select(
        "id", *[F.array_join(F.col(f).cast("array<string>"), ",").alias(f) for f in features.FEATURES]
    )


MEANS = ", ".join(f"round(avg({f}), 6) AS {f}" for f in SF) + ", round(sum(chars) / sum(sentence_length), 6) AS word_length"


@query("ag02_array_means", ann_docs() + "," + SENT_FEATURES + f" SELECT id, {MEANS} FROM fs GROUP BY id")
def ag02(t):
    return rounded(features.array_means(features.linguistic_features(with_parse(doc_tokens(t)))))


@query("ag02_document_means", ann_docs() + "," + SENT_FEATURES + f" SELECT id, {MEANS} FROM fs GROUP BY id")
def ag02_direct(t):
    return rounded(features.document_means(with_parse(doc_tokens(t))))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LONG = f"l AS (UNPIVOT (SELECT l_returnflag, {', '.join(NUM)} FROM lineitem) ON {', '.join(NUM)} INTO NAME feature VALUE value)"
MOMENTS = "avg(value) AS m, var_pop(value) AS v, avg(value * value * value) AS c3, avg(value * value * value * value) AS c4, avg(value * value) AS c2"
SKEW = "avg(((value - m) / s) ** 3)"
KURT = "avg(((value - m) / s) ** 4) - 3"


def described(by: str, source: str) -> str:
    return f"""
z AS (SELECT {by}, avg(value) AS m, stddev_pop(value) AS s FROM {source} GROUP BY ALL),
k AS (SELECT {by}, {SKEW} AS skewness, {KURT} AS kurtosis FROM {source} JOIN z USING ({by}) GROUP BY {by}),
c AS (SELECT {by}, value, count(*) AS n FROM {source} GROUP BY ALL),
o AS (SELECT {by}, value AS mode FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, value) AS r FROM c) WHERE r = 1)"""


@query(
    "ag03_describe_by_class",
    f"""WITH {LONG},{described("l_returnflag, feature", "l")}
SELECT l_returnflag, feature, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(any_value(mode), 6) AS mode, round(min(value), 6) AS min, round(max(value), 6) AS max,
  round(max(value) - min(value), 6) AS range, round(stddev_pop(value), 6) AS sd, round(var_pop(value), 3) AS variance,
  round(any_value(skewness), 6) AS skewness, round(any_value(kurtosis), 6) AS kurtosis
FROM l JOIN k USING (l_returnflag, feature) JOIN o USING (l_returnflag, feature) GROUP BY l_returnflag, feature""",
)
def ag03(t):
    out = stats.describe_by(t.lineitem, "l_returnflag", NUM)
    return rounded(out).withColumn("variance", F.round("variance", 3))


@query(
    "ag03_describe_features",
    ANN_LABELLED + "," + SENT_FEATURES + f""",
d AS (SELECT fs.*, quality FROM fs JOIN (SELECT CAST(doc_id AS VARCHAR) AS id, quality FROM labels) USING (id)),
l AS (SELECT quality, feature, CAST(value AS DOUBLE) AS value FROM (UNPIVOT (SELECT quality, {', '.join(SF)} FROM d) ON {', '.join(SF)} INTO NAME feature VALUE value))
SELECT quality, feature, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median,
  round(min(value), 6) AS min, round(max(value), 6) AS max, round(stddev_pop(value), 6) AS sd
FROM l GROUP BY quality, feature""",
)
def ag03_features(t):
    feats = features.linguistic_features(with_parse(labelled_tokens(t)))
    rows = feats.join(t.labels.select(F.col("doc_id").cast("string").alias("id"), "quality"), "id")
    # Tagged once: the statistics read their rows several times.
    out = stats.describe_by(resume.cut_lineage(rows.select("quality", *SF)), "quality", SF)
    return rounded(out.select("quality", "feature", "n", "mean", "median", "min", "max", "sd"))


EVENTS = "SELECT event_type, value FROM events"


@query(
    "ag04_group_stats",
    f"""WITH e AS (SELECT event_type AS feature, value FROM events),{described("feature", "e")}
SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(var_samp(value), 6) AS variance,
  round(max(value) - min(value), 6) AS range, round(any_value(skewness), 6) AS skewness, round(any_value(kurtosis), 6) AS kurtosis
FROM e JOIN k USING (feature) GROUP BY feature""",
)
def ag04(t):
    return rounded(stats.group_stats(t.events.select(F.col("event_type").alias("feature"), "value")))


@query(
    "ag05_class_variance",
    f"""WITH {LONG} SELECT feature, round(var_samp(value) FILTER (WHERE l_returnflag = 'A'), 3) AS "var_A",
  round(var_samp(value) FILTER (WHERE l_returnflag = 'N'), 3) AS "var_N",
  round(var_samp(value) FILTER (WHERE l_returnflag = 'R'), 3) AS "var_R" FROM l GROUP BY feature""",
)
def ag05(t):
    out = stats.class_variance(t.lineitem, "l_returnflag", NUM, ["A", "N", "R"])
    return out.select("feature", *[F.round(f"var_{c}", 3).alias(f"var_{c}") for c in "ANR"])


NULLED = """(SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice, l_discount, l_tax,
  l_quantity * 2 + l_linenumber AS twice FROM lineitem)"""
CORR_COLS = NUM + ["twice"]


def corr_sql(digits=3) -> str:
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            parts.append(
                f"SELECT l_returnflag, '{a}' AS f1, '{b}' AS f2, round(corr({a}, {b}), {digits}) AS corr FROM {NULLED} GROUP BY l_returnflag"
            )
    return " UNION ALL ".join(parts)


def nulled(t):
    return t.lineitem.withColumns(
        {
            "twice": F.col("l_quantity") * 2 + F.col("l_linenumber"),
            "l_quantity": F.when(F.col("l_linenumber") != 1, F.col("l_quantity")),
        }
    )


@query("ag06_correlations", corr_sql())
def ag06(t):
    return stats.correlations(nulled(t), "l_returnflag", CORR_COLS)


@query("ag07_correlated_features", f"SELECT DISTINCT f2 AS feature FROM ({corr_sql()}) WHERE abs(corr) > 0.8")
def ag07(t):
    return stats.correlated_features(stats.correlations(nulled(t), "l_returnflag", CORR_COLS))


@query(
    "ag08_class_counts",
    "SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang",
)
def ag08(t):
    return rounded(stats.class_counts(t.documents, "lang"))


FREQ = f"SELECT quality, lower(lemma) AS term, count(*) AS n FROM ann WHERE NOT is_stop AND NOT is_punct GROUP BY ALL"


def yates_sql(a, b, c, d) -> str:
    return (
        f"coalesce((({a}+{b}+{c}+{d}) * greatest(0.0, abs(({a}) * ({d}) - ({b}) * ({c})) - ({a}+{b}+{c}+{d}) / 2.0) ** 2)"
        f" / nullif(({a}+{b}) * ({c}+{d}) * ({a}+{c}) * ({b}+{d}), 0), 0.0)"
    )


def bias_sql(freq: str, total1: str, total2: str) -> str:
    return f"""
two AS (SELECT coalesce(x.term, y.term) AS term, CAST(coalesce(x.n, 0) AS DOUBLE) AS a, CAST(coalesce(y.n, 0) AS DOUBLE) AS c
  FROM (SELECT * FROM {freq} WHERE quality = 1) x FULL JOIN (SELECT * FROM {freq} WHERE quality = 0) y ON x.term = y.term),
tot AS (SELECT CAST({total1} AS DOUBLE) AS n1, CAST({total2} AS DOUBLE) AS n2),
st AS (SELECT term, a, c, n1, n2, {yates_sql('a', '(n1 - a)', 'c', '(n2 - c)')} AS statistic FROM two, tot),
ex AS (SELECT term, statistic, CASE WHEN a > n1 * (a + c) / (n1 + n2) THEN 'good' ELSE 'bad' END AS biased_class,
  CAST(CASE WHEN a > n1 * (a + c) / (n1 + n2) THEN a ELSE c END AS BIGINT) AS frequency FROM st WHERE statistic > {tails.chi2_critical(0.001)!r}),
nx AS (SELECT *, (statistic - min(statistic) OVER ()) / nullif(max(statistic) OVER () - min(statistic) OVER (), 0) AS statistic_norm FROM ex)"""


def class_freq(t):
    from rostrum.operators import terms

    return terms.term_frequencies(labelled_tokens(t), "quality")


@query(
    "ag13_term_bias",
    ANN_LABELLED + f", fq AS ({FREQ})," + bias_sql(
        "fq", "(SELECT sum(n) FROM fq WHERE quality = 1)", "(SELECT sum(n) FROM fq WHERE quality = 0)")
    + " SELECT term, round(statistic, 6) AS statistic, biased_class, frequency, round(statistic_norm, 6) AS statistic_norm FROM nx",
)
def ag13(t):
    return rounded(stats.class_bias(class_freq(t), "quality", (1, 0), ("good", "bad"), with_p=False))


TOP50 = """tf AS (SELECT quality, term, n FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY n DESC, term) AS r FROM fq) WHERE r <= 50)"""


@query(
    "ag13_term_bias_top_lists",
    ANN_LABELLED + f", fq AS ({FREQ}), {TOP50}," + bias_sql(
        "tf", "(SELECT sum(n) FROM tf WHERE quality = 1)", "(SELECT sum(n) FROM tf WHERE quality = 0)")
    + " SELECT term, round(statistic, 6) AS statistic, biased_class, frequency, round(statistic_norm, 6) AS statistic_norm FROM nx",
)
def ag13_top(t):
    from rostrum.operators import terms

    top = terms.top_terms(terms.term_frequencies(labelled_tokens(t), "quality"), 50, "quality")
    return rounded(stats.class_bias(top, "quality", (1, 0), ("good", "bad"), with_p=False))


@query(
    "ag13_term_bias_corpus_totals",
    ANN_LABELLED + f", fq AS ({FREQ}), {TOP50}," + bias_sql(
        "tf", "(SELECT count(*) FROM ann WHERE quality = 1)", "(SELECT count(*) FROM ann WHERE quality = 0)")
    + " SELECT term, round(statistic, 6) AS statistic, biased_class, frequency FROM nx",
)
def ag13_corpus(t):
    from rostrum.operators import terms

    toks = labelled_tokens(t)
    top = terms.top_terms(terms.term_frequencies(toks, "quality"), 50, "quality")
    sizes = [toks.agg(F.count_if(F.col("quality") == k)).scalar() for k in (1, 0)]
    out = stats.class_bias(top, "quality", (1, 0), ("good", "bad"), totals=sizes, with_p=False)
    return rounded(out.select("term", "statistic", "biased_class", "frequency"))


@query(
    "ag14_top_biased_terms",
    ANN_LABELLED + f", fq AS ({FREQ})," + bias_sql(
        "fq", "(SELECT sum(n) FROM fq WHERE quality = 1)", "(SELECT sum(n) FROM fq WHERE quality = 0)")
    + """ SELECT term, biased_class, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY biased_class
      ORDER BY round(statistic_norm, 9) DESC, term) AS rank FROM nx) WHERE rank <= 25""",
)
def ag14(t):
    bias = stats.class_bias(class_freq(t), "quality", (1, 0), ("good", "bad"), with_p=False)
    bias = bias.withColumn("statistic_norm", F.round("statistic_norm", 9))
    return stats.top_biased(bias, 25).select("term", "biased_class", "frequency", "rank")


VOCAB = ["the", "of", "and", "is", "it", "he", "than", "by", "der", "les", "que", "tion", "zzz"]
VEC_SQL = ", ".join(f"CAST(list_contains(ws, '{w}') AS INT)" for w in VOCAB)


def vectors(t, label="quality"):
    words = F.array_distinct(T.tokens(F.lower("text")))
    # Bound, so that a filter on the vectors finds finished words, and a join carries vectors only.
    docs = t.documents.select("doc_id", F.explode(F.array(words)).alias("words"))
    docs = docs.select("doc_id", T.encode_multi_hot("words", VOCAB).alias("semantic_frames"))
    docs = docs.select("doc_id", annotate.bound("semantic_frames"))
    return docs.join(t.labels.select("doc_id", label), "doc_id").select("doc_id", label, "semantic_frames")


@query(
    "ag15_frame_bias",
    f"""WITH v AS (SELECT quality, [{VEC_SQL}] AS vec FROM (SELECT quality, regexp_extract_all(lower(text), '{T.TOKEN}') AS ws FROM {LABELLED_SQL})),
e AS (SELECT quality, unnest(vec) AS bit, unnest(range(len(vec))) AS frame_index FROM v),
g AS (SELECT frame_index, CAST(count(*) FILTER (WHERE quality = 1 AND bit = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE quality = 1 AND bit = 0) AS DOUBLE) AS b,
  CAST(count(*) FILTER (WHERE quality = 0 AND bit = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (WHERE quality = 0 AND bit = 0) AS DOUBLE) AS d FROM e GROUP BY frame_index)
SELECT frame_index, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, CAST(d AS BIGINT) AS d, round({yates_sql('a','b','c','d')}, 6) AS statistic
FROM g ORDER BY statistic DESC, frame_index LIMIT 30""",
)
def ag15(t):
    return rounded(stats.frame_bias(vectors(t), "quality", 1))


@query(
    "ag16_chi2_scores",
    f"""WITH {LONG}, o AS (SELECT l_returnflag, feature, sum(value) AS o FROM l GROUP BY ALL),
s AS (SELECT l_returnflag, count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY l_returnflag),
x AS (SELECT feature, o, share * sum(o) OVER (PARTITION BY feature) AS e FROM o JOIN s USING (l_returnflag))
SELECT feature, round(sum((o - e) ** 2 / e), 4) AS statistic FROM x GROUP BY feature""",
)
def ag16(t):
    out = stats.chi2_scores(t.lineitem, "l_returnflag", NUM)
    return out.select("feature", F.round("statistic", 4).alias("statistic"))


def welch_sql(source: str, label: str, c1: str, c2: str) -> str:
    side = lambda c: f"FILTER (WHERE {label} = {c})"
    return f"""
g AS (SELECT feature, count(value) {side(c1)} AS n1, avg(value) {side(c1)} AS m1, var_samp(value) {side(c1)} AS v1,
  count(value) {side(c2)} AS n2, avg(value) {side(c2)} AS m2, var_samp(value) {side(c2)} AS v2 FROM {source} GROUP BY feature),
w AS (SELECT feature, n1, m1 AS mean1, sqrt(v1) AS sd1, n2, m2 AS mean2, sqrt(v2) AS sd2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
  (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS df FROM g)"""


WELCH_OUT = "feature, n1, round(mean1, 6) AS mean1, round(sd1, 6) AS sd1, n2, round(mean2, 6) AS mean2, round(sd2, 6) AS sd2, round(t, 6) AS t, round(df, 4) AS df"


def welch_out(df):
    return rounded(df).withColumn("df", F.round("df", 4))


@query("ag17_welch", f"WITH {LONG},{welch_sql('l', 'l_returnflag', repr('A'), repr('R'))} SELECT {WELCH_OUT} FROM w")
def ag17(t):
    return welch_out(stats.t_tests(t.lineitem, "l_returnflag", ("A", "R"), NUM, p=False))


@query("ag17_welch_with_p")
def ag17_p(t):
    return rounded(stats.t_tests(t.lineitem, "l_returnflag", ("A", "R"), NUM))


# A p-like value per part brand, to compare the corrections.
PVALS = "p0 AS (SELECT p_brand AS feature, CAST(p_type AS VARCHAR) AS family, avg(p_size) / 500.0 AS p FROM part GROUP BY ALL)"


@query(
    "ag18_corrections",
    f"""WITH {PVALS}, r AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, rank() OVER (PARTITION BY family ORDER BY p)
  + count(*) OVER (PARTITION BY family, p) - 1 AS rk FROM p0),
b AS (SELECT feature, family, p, least(1.0, p * m) AS bonferroni,
  least(1.0, min(p * m / rk) OVER (PARTITION BY family ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS bh FROM r)
SELECT feature, family, round(p, 6) AS p, round(bonferroni, 6) AS bonferroni, round(bh, 6) AS bh,
  bonferroni <= 0.05 AS reject_bonferroni, bh <= 0.05 AS reject_bh FROM b""",
)
def ag18(t):
    p = t.part.groupBy(F.col("p_brand").alias("feature"), F.col("p_type").alias("family")).agg(
        (F.avg("p_size") / 500.0).alias("p")
    )
    return rounded(stats.correct(p, by=["family"]))


@query(
    "ag19_log_welch",
    f"""WITH l0 AS (SELECT event_type AS label, 'k' || CAST(user_id % 5 AS VARCHAR) AS feature, ln(value) AS value FROM events WHERE value > 0),
{welch_sql('l0', 'label', repr('click'), repr('view'))[1:]} SELECT {WELCH_OUT} FROM w""",
)
def ag19(t):
    long = t.events.select(
        F.col("event_type").alias("label"),
        F.concat(F.lit("k"), (F.col("user_id") % 5).cast("string")).alias("feature"),
        "value",
    )
    out = stats.log_t_tests(long, "label", ("click", "view"))
    return welch_out(out.select("feature", "n1", "mean1", "sd1", "n2", "mean2", "sd2", "t", "df"))


@query(
    "ag20_normality",
    f"""WITH {LONG},{described("l_returnflag, feature", "l")}, j AS (SELECT l_returnflag, feature, count(value) AS n,
  count(value) / 6.0 * (pow(any_value(skewness), 2) + pow(any_value(kurtosis), 2) / 4.0) AS jb
  FROM l JOIN k USING (l_returnflag, feature) GROUP BY l_returnflag, feature)
SELECT l_returnflag, feature, n, round(jb, 6) AS jarque_bera, round(exp(-jb / 2), 6) AS p, exp(-jb / 2) > 0.05 AS normal FROM j""",
)
def ag20(t):
    return rounded(stats.jarque_bera(t.lineitem, "l_returnflag", NUM))


# The normal law as its series, by Horner's rule.
def normal_sql(z: str, terms: int = stats.TERMS) -> str:
    inner = "1.0"
    for k in range(terms, 0, -1):
        inner = f"(1.0+{inner}*zz/{2 * k + 1}.0)"
    return f"CASE WHEN {z} < -{stats.FAR} THEN 0 WHEN {z} > {stats.FAR} THEN 1 ELSE 0.5 + {z} * {inner} * exp(-zz / 2) / sqrt(2 * pi()) END"


@query(
    "ag20_ks_statistic",
    f"""WITH {LONG}, s AS (SELECT l_returnflag, feature, count(*) AS n, avg(value) AS m, stddev_samp(value) AS s FROM l GROUP BY ALL),
c AS (SELECT l_returnflag, feature, value, count(*) AS c FROM l GROUP BY ALL),
u AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag, feature ORDER BY value) AS u FROM c),
z AS (SELECT *, (value - m) / s AS z, pow((value - m) / s, 2) AS zz FROM u JOIN s USING (l_returnflag, feature)),
f AS (SELECT *, {normal_sql('z')} AS f FROM z),
d AS (SELECT l_returnflag, feature, any_value(n) AS n, max(greatest(u / n - f, f - (u - c) / n)) AS d FROM f GROUP BY ALL)
SELECT l_returnflag, feature, n, round(d, 6) AS statistic, CASE WHEN n * d * d < 0.04 THEN 1.0 ELSE round(greatest(0, least(1,
  list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * k * k * n * d * d))))), 6) END AS p FROM d""",
)
def ag20_ks(t):
    return rounded(stats.ks_normality(t.lineitem, "l_returnflag", NUM).drop("normal"))


STATUS = ["F", "O", "P"]


@query(
    "ag21_cross_table",
    "SELECT o_orderpriority, " + ", ".join(
        f"""round(count(*) FILTER (WHERE o_orderstatus = '{s}') / count(*) FILTER (WHERE o_orderstatus IN ('F','O','P')), 6) AS "share_{s}" """ for s in STATUS)
    + " FROM orders GROUP BY o_orderpriority",
)
def ag21(t):
    return rounded(stats.cross_table(t.orders, "o_orderpriority", "o_orderstatus", STATUS))


@query("ag22_value_counts", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY ALL")
def ag22(t):
    return stats.value_counts(t.orders, "o_orderpriority")


@query(
    "ag38_histogram",
    f"""WITH {LONG}, e AS (SELECT l_returnflag, feature, min(value) AS lo, max(value) AS hi FROM l GROUP BY ALL)
SELECT l_returnflag, feature, least(20, coalesce(CAST(floor((value - lo) * 20 / nullif(hi - lo, 0)) AS BIGINT) + 1, 1)) AS bin, count(*) AS n
FROM l JOIN e USING (l_returnflag, feature) GROUP BY ALL""",
)
def ag38(t):
    return stats.histogram(t.lineitem, "l_returnflag", NUM, 20)


@query(
    "ag39_box_summary",
    f"""WITH {LONG}, qs AS (SELECT l_returnflag, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3 FROM l GROUP BY ALL)
SELECT l_returnflag, feature, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
  round(min(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(value) FILTER (WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers
FROM l JOIN qs USING (l_returnflag, feature) GROUP BY l_returnflag, feature""",
)
def ag39(t):
    return rounded(stats.box_summary(t.lineitem, "l_returnflag", NUM))
