"""Evaluation, attribution and models."""

from pyspark.sql import functions as F

from rostrum.catalog.base import Tables, labelled, query, r6, rounded
from rostrum.operators import attribution, evaluate, models, stats
from rostrum.streaming.resume import cut_lineage

# Labels against a second, rule-made rater: long documents are called good. The score is
# coarse on purpose, so that many rows tie.
PRED = """(SELECT d.doc_id, quality AS label, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS predicted, floor(n_chars / 100.0) / 100 AS score
  FROM documents d JOIN labels l USING (doc_id))"""


def predictions(t):
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select(
        F.col("doc_id"), F.col("quality").alias("label"),
        F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("predicted"),
        (F.floor(F.col("n_chars") / 100.0) / 100).alias("score"),
    )


@query("ev01_confusion", f"SELECT label, predicted, count(*) AS n FROM {PRED} GROUP BY ALL")
def ev01(t):
    return evaluate.confusion(predictions(t))


@query(
    "ev01_confusion_matrix",
    f"SELECT label, count(*) FILTER (WHERE predicted = 0) AS predicted_0, count(*) FILTER (WHERE predicted = 1) AS predicted_1 FROM {PRED} GROUP BY label",
)
def ev01_matrix(t):
    return evaluate.confusion_matrix(predictions(t), [0, 1])


CLASS = f"""c AS (SELECT k AS class, count(*) FILTER (WHERE label = k) AS support, count(*) FILTER (WHERE predicted = k) AS claimed,
  count(*) FILTER (WHERE label = k AND predicted = k) AS tp FROM {PRED}, (VALUES (0), (1)) v(k) GROUP BY k),
m AS (SELECT class, support, coalesce(tp / nullif(claimed, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m)"""


@query("ev02_class_metrics", f"WITH {CLASS} SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f")
def ev02(t):
    return rounded(evaluate.class_metrics(predictions(t)))


@query(
    "ev02_summary_metrics",
    f"""WITH {CLASS} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
    (SELECT round(avg(CAST(label = predicted AS INT)), 6) FROM {PRED}) AS accuracy FROM f""",
)
def ev02_summary(t):
    return rounded(evaluate.summary_metrics(predictions(t)))


@query(
    "ev03_roc_auc",
    f"""WITH r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM {PRED})
    SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
      / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc FROM r""",
)
def ev03(t):
    return rounded(evaluate.roc_auc(predictions(t), 1))


@query(
    "ev03_roc_auc_orders",
    """WITH p AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, o_totalprice AS score FROM orders),
    r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM p)
    SELECT round((sum(r) FILTER (WHERE label = 1) - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
      / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)), 6) AS auc FROM r""",
)
def ev03_orders(t):
    rows = t.orders.select(F.col("o_orderstatus").alias("label"), F.col("o_totalprice").alias("score"))
    return rounded(evaluate.roc_auc(rows, "F"))


@query(
    "ev04_roc_points",
    f"""WITH s AS (SELECT score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM {PRED} GROUP BY score)
    SELECT round(score, 6) AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 6) AS fpr, round(sum(pos) OVER w / sum(pos) OVER (), 6) AS tpr
    FROM s WINDOW w AS (ORDER BY score DESC)""",
)
def ev04(t):
    return rounded(evaluate.roc_points(predictions(t), 1))


@query(
    "ev05_matthews",
    f"""SELECT round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM (SELECT
    CAST(count(*) FILTER (WHERE label = 1 AND predicted = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE label = 0 AND predicted = 0) AS DOUBLE) AS tn,
    CAST(count(*) FILTER (WHERE label = 0 AND predicted = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (WHERE label = 1 AND predicted = 0) AS DOUBLE) AS fn FROM {PRED})""",
)
def ev05(t):
    return rounded(evaluate.matthews(predictions(t)))


@query("ev06_misclassified", f"SELECT doc_id, label AS true_label, predicted AS predicted_label FROM {PRED} WHERE label <> predicted")
def ev06(t):
    return evaluate.misclassified(predictions(t), "doc_id")


@query("ev07_by_threshold", f"SELECT doc_id, CASE WHEN score > 0.5 THEN 'support' ELSE 'oppose' END AS label FROM {PRED}")
def ev07(t):
    return predictions(t).select("doc_id", evaluate.by_threshold("score", "support", "oppose").alias("label"))


@query("ev08_plane")
def ev08(t):
    return models.plane(t.embeddings, "embedding", ["vec_id", "label"])


TWO = "(SELECT event_id, value / (value + k) AS p0, k / (value + k) AS p1 FROM (SELECT event_id, value, CAST(props::JSON->>'k' AS BIGINT) AS k FROM events) WHERE value + k > 0)"


@query(
    "ml09_decide",
    f"""SELECT event_id, CASE WHEN p0 > p1 THEN 'support' ELSE 'oppose' END AS predicted, round(greatest(p0, p1), 6) AS score FROM {TWO}
    WHERE p0 <> p1 AND greatest(p0, p1) > 0.6""",
)
def ml09(t):
    k = F.get_json_object("props", "$.k").cast("long")
    rows = t.events.select("event_id", "value", k.alias("k")).filter(F.col("value") + F.col("k") > 0)
    total = F.col("value") + F.col("k")
    rows = rows.select("event_id", (F.col("value") / total).alias("p0"), (F.col("k") / total).alias("p1"))
    return rounded(evaluate.decide(rows, {"p0": "support", "p1": "oppose"}, 0.6, ["event_id"]))


NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
COEF = {"l_quantity": 0.5, "l_extendedprice": -0.001, "l_discount": 2.0}


@query(
    "ml06_linear_attribution",
    "WITH a AS (SELECT avg(l_quantity) AS q, avg(l_extendedprice) AS e, avg(l_discount) AS d FROM lineitem WHERE l_returnflag <> 'R') "
    + " UNION ALL ".join(
        f"SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id, '{c}' AS feature, round({w} * ({c} - {m}), 4) AS value FROM lineitem, a WHERE l_returnflag = 'R'"
        for (c, w), m in zip(COEF.items(), "qed")
    ),
)
def ml06(t):
    li = t.lineitem.withColumn("id", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    out = attribution.linear_attribution(
        li.filter("l_returnflag = 'R'"), li.filter("l_returnflag <> 'R'"), COEF
    )
    return out.select("id", "feature", F.round("value", 4).alias("value"))


def binary(t):
    return t.lineitem.filter(F.col("l_returnflag").isin("A", "R")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"),
        F.when(F.col("l_extendedprice") + 20000 * F.col("l_tax") * F.pmod("l_orderkey", F.lit(7)) > 40000, 1).otherwise(0).alias("y"),
        "l_quantity", "l_discount", "l_tax",
    )


X = ["l_quantity", "l_discount", "l_tax"]


@query("ml01_logit_table")
def ml01(t):
    return rounded(models.logit_table(binary(t), "y", X)[0].drop("odds_ratio"))


@query("ml01_logit_fit")
def ml01_fit(t):
    return rounded(models.logit_table(binary(t), "y", X)[1])


@query("ml02_odds_ratios")
def ml02(t):
    return rounded(models.logit_table(binary(t), "y", X)[0].select("term", "odds_ratio"))


@query("ml03_l2_logit")
def ml03(t):
    return rounded(models.sorted_coefficients(models.l2_logit(binary(t), "y", X), t.spark, X))


def embedded(t, cols):
    """All dimensions; the label has ten values, of which the upper half is told from the lower."""
    values = [F.get("embedding", F.lit(k)).cast("double").alias(c) for k, c in enumerate(cols)]
    return t.embeddings.select(F.col("vec_id").alias("id"), (F.col("label") >= 5).cast("int").alias("y"), *values)


@query("ml04_linear_svm")
def ml04(t):
    cols = [f"e{k}" for k in range(64)]
    model, _, _ = models.linear_svm(embedded(t, cols), "y", cols)
    return rounded(models.sorted_coefficients(model, t.spark, cols))


@query("ml05_permutation_importance")
def ml05(t):
    rows = binary(t)
    return rounded(models.permutation_importance(models.l2_logit(rows, "y", X), rows, "y", X))


NAMES = {"bad": 0, "good": 1}


def named(t):
    return labelled(t).select(
        F.col("doc_id").alias("id"), "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label")
    )


@query("ml07_text_classifier")
def ml07(t):
    from rostrum.operators import curate

    parts = curate.random_split(named(t), "label", "id")
    model = models.train_text(parts.filter("split = 'train'"), NAMES)
    # All documents are scored, unlabelled ones too.
    return rounded(models.score_text(model, t.documents.select(F.col("doc_id").alias("id"), "text"), NAMES))


@query("ml08_search")
def ml08(t):
    from rostrum.operators import curate

    # Five plans read the parts.
    parts = cut_lineage(curate.random_split(named(t), "label", "id"))
    model, reg, auc = models.search_text(
        parts.filter("split = 'train'"), parts.filter("split = 'validation'"), NAMES
    )
    scored = models.score_text(model, parts.filter("split = 'test'"), NAMES)
    return rounded(scored)


WORDS_OF = "list_distinct(list_filter(string_split_regex({}, '\\s+'), lambda w: w <> ''))"


@query(
    "ml10_pair_scoring",
    f"""SELECT id, CAST(score AS DOUBLE) AS score, CASE WHEN score > 3.0 THEN 'continue' ELSE 'not_continue' END AS label FROM (
    SELECT CAST(a.conv_id AS VARCHAR) || '-' || CAST(a.turn AS VARCHAR) AS id,
      len(list_intersect({WORDS_OF.format('a.text')}, {WORDS_OF.format('b.text')})) AS score
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)""",
)
def ml10(t):
    def share(batch):
        import pandas as pd

        same = [len(set(a.split()) & set(b.split())) for a, b in zip(batch["s1"], batch["s2"])]
        return pd.DataFrame({"id": batch["id"], "score": pd.Series(same, dtype="float64")})

    a = t.conversations.select("conv_id", "turn", F.col("text").alias("x"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("z"))
    pairs = a.join(b, ["conv_id", "turn"]).select(
        F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.col("x"), F.lit(" [SEP] "), F.col("z")).alias("text")
    )
    scored = models.score(models.split_pair(pairs).select("id", "s1", "s2"), share, "id string, score double")
    return scored.withColumn("label", evaluate.by_threshold("score", "continue", "not_continue", 3.0))


# --- attributions ---------------------------------------------------------------------

# One attribution per line: the part brand stands for the token, a signed price for the value.
ATT = "(SELECT l_orderkey AS id, l_linenumber AS pos_i, p_brand AS feature, p_type AS kind, (l_extendedprice - 38000) / 1000 AS value FROM lineitem JOIN part ON l_partkey = p_partkey)"


def attributions(t):
    part = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("feature"), F.col("p_type").alias("kind"))
    return t.lineitem.join(part, "l_partkey").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos_i"), "feature", "kind",
        ((F.col("l_extendedprice") - 38000) / 1000).alias("value"),
    )


@query(
    "ag31_group_sums",
    f"""SELECT lower(kind) AS feature, round(sum(value), 4) AS total, round(sum(greatest(value, 0.0)), 4) AS total_positive,
    round(sum(least(value, 0.0)), 4) AS total_negative FROM {ATT} GROUP BY ALL""",
)
def ag31(t):
    lexicon = t.part.select(
        F.lower("p_type").alias("category"), F.col("p_type").alias("pos"), F.col("p_brand").alias("entry")
    ).distinct()
    toks = attributions(t).withColumnsRenamed({"kind": "pos", "feature": "lemma"})
    out = attribution.group_sums(toks, lexicon)
    return out.select("feature", *[F.round(c, 4).alias(c) for c in ("total", "total_positive", "total_negative")])


@query("ag32_mean_absolute", f"SELECT feature, round(avg(abs(value)), 6) AS value FROM {ATT} GROUP BY feature")
def ag32(t):
    return rounded(attribution.mean_absolute(attributions(t)))


@query(
    "ag34_agreement",
    f"""WITH x AS (SELECT feature, avg(value) AS x FROM {ATT} WHERE kind < 'M' GROUP BY feature), y AS (SELECT feature, avg(value) AS y FROM {ATT} WHERE kind >= 'M' GROUP BY feature),
j AS (SELECT x, y FROM x JOIN y USING (feature)), z AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS x, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS y FROM j)
SELECT round(avg(x - y), 6) + 0.0 AS mean_difference, round(avg(x - y) - 1.96 * stddev_pop(x - y), 6) AS lower_limit, round(avg(x - y) + 1.96 * stddev_pop(x - y), 6) AS upper_limit,
  round((avg(x) - avg(y)) / sqrt(var_samp(x) / count(*) + var_samp(y) / count(*)), 6) + 0.0 AS t FROM z""",
)
def ag34(t):
    a = attributions(t)
    one = a.filter("kind < 'M'").groupBy("feature").agg(F.avg("value").alias("value"))
    two = a.filter("kind >= 'M'").groupBy("feature").agg(F.avg("value").alias("value"))
    return rounded(attribution.agreement(one, two, p=False).drop("df"))


@query(
    "ag34_agreement_minmax",
    f"""WITH x AS (SELECT feature, avg(value) AS x FROM {ATT} WHERE kind < 'M' GROUP BY feature), y AS (SELECT feature, avg(value) AS y FROM {ATT} WHERE kind >= 'M' GROUP BY feature),
j AS (SELECT x, y FROM x JOIN y USING (feature)), z AS (SELECT (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS x, (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS y FROM j)
SELECT round(avg(x - y), 6) AS mean_difference, round((avg(x) - avg(y)) / sqrt(var_samp(x) / count(*) + var_samp(y) / count(*)), 6) AS t FROM z""",
)
def ag34_minmax(t):
    a = attributions(t)
    one = a.filter("kind < 'M'").groupBy("feature").agg(F.avg("value").alias("value"))
    two = a.filter("kind >= 'M'").groupBy("feature").agg(F.avg("value").alias("value"))
    return rounded(attribution.agreement(one, two, scale="minmax", p=False).select("mean_difference", "t"))


@query(
    "ag37_signed_words",
    f"""SELECT id, coalesce(string_agg(feature, ',' ORDER BY value DESC, pos_i) FILTER (WHERE value > 0), '') AS support_words,
    coalesce(string_agg(feature, ',' ORDER BY value, pos_i) FILTER (WHERE value < 0), '') AS oppose_words FROM {ATT} GROUP BY id""",
)
def ag37(t):
    out = attribution.signed_words(attributions(t))
    return out.select(
        "id", F.array_join("support_words", ",").alias("support_words"), F.array_join("oppose_words", ",").alias("oppose_words")
    )
