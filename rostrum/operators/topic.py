"""Sentence pairs and the rules of topic continuity.

Pair tokens are ``(id, side, i, text, lemma, pos, …)`` with ``side`` 1 or 2. A finding is
``(id, kind, s1_word, s1_i, s2_word, s2_i)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import fixed
from rostrum.functions import text as T
from rostrum.operators import ordered, similar
from rostrum.operators.anonymize import pair_text
from rostrum.streaming import resume

KINDS = ["lexical", "syntactic", "semantic", "coreference", "transition_continue"]
FINDING = ["id", "kind", "s1_word", "s1_i", "s2_word", "s2_i"]


# --- pairs ----------------------------------------------------------------------------


def role_label(first, second):
    """Label of two neighbouring roles; NULL when the pair says nothing."""
    inside = (second == "inside") & first.isin("inside", "beginning")
    cut = ((first == "outside") & (second == "inside")) | (
        first.isin("inside", "beginning") & (second == "outside")
    )
    return F.when(inside, "continue").when(cut, "not_continue")


def sentence_pairs(
    sents: DataFrame, passage="passage_id", at="i", sentence="sentence", role="role", keep=()
) -> DataFrame:
    """Neighbouring sentences of a passage with their label, and the columns in ``keep``.

    ``at`` counts the sentences of a passage without gaps. A ``beginning`` after the first
    sentence counts as ``inside``. The pair is an equi-join on ``(passage, position)``: a
    passage that holds most of the rows is spread by position, unlike in a window.
    """
    role_c = F.when((F.col(at) > 0) & (F.col(role) == "beginning"), "inside").otherwise(F.col(role))
    rows = sents.select(
        passage, F.col(at).cast("long").alias("i"), *keep, F.col(sentence).alias("s"), role_c.alias("r")
    )
    first = rows.select(passage, "i", *keep, F.col("s").alias("s1"), F.col("r").alias("r1"))
    second = rows.select(passage, (F.col("i") - 1).alias("i"), F.col("s").alias("s2"), F.col("r").alias("r2"))
    pairs = first.join(second, [passage, "i"])
    pairs = pairs.withColumn("label", role_label(F.col("r1"), F.col("r2")))
    return pairs.filter(F.col("label").isNotNull()).select(passage, "i", *keep, "s1", "s2", "label")


def array_pairs(df: DataFrame, passage="passage_id", sentences="text", keep=()) -> DataFrame:
    """The same for passages stored as ``array<struct<sentence, role>>``: no shuffle."""
    s = F.col(sentences)

    def fixed_role(e, k):
        return F.when((k > 0) & (e["role"] == "beginning"), "inside").otherwise(e["role"])

    pairs = F.transform(
        s,
        lambda e, k: F.struct(
            k.alias("i"),
            e["sentence"].alias("s1"),
            F.get(s, k + 1)["sentence"].alias("s2"),
            role_label(fixed_role(e, k), fixed_role(F.get(s, k + 1), k + 1)).alias("label"),
        ),
    )
    rows = df.select(passage, *keep, F.explode(pairs).alias("_p")).select(passage, *keep, "_p.*")
    return rows.filter(F.col("label").isNotNull())


def short_pairs(
    pairs: DataFrame, most=fixed.PAIR_MAX_TOKENS, most_marked=fixed.WINDOW_MAX_TOKENS, count=T.n_tokens
) -> DataFrame:
    """Drop pairs that are too long in the plain or in the marked form."""
    return pairs.filter(
        (count(pair_text("s1", "s2")) <= most) & (count(pair_text("s1", "s2", True)) <= most_marked)
    )


def pair_tokens(pairs: DataFrame, tokenizer) -> DataFrame:
    """Tokens of both members. ``tokenizer`` maps ``(id, sent_i, sentence)`` to a token
    table; the member number travels in ``sent_i``."""
    members = F.array(
        F.struct(F.lit(1).alias("side"), F.col("s1").alias("s")),
        F.struct(F.lit(2).alias("side"), F.col("s2").alias("s")),
    )
    rows = pairs.select("id", F.explode(members).alias("_m")).select(
        "id", F.col("_m.side").alias("sent_i"), F.col("_m.s").alias("sentence")
    )
    return tokenizer(rows).withColumnRenamed("sent_i", "side")


# --- rules ----------------------------------------------------------------------------


def _shared(units: DataFrame, keys, kind: str, word: str) -> DataFrame:
    """Units present on both sides, with the lowest index of each side. One aggregate in
    place of a self-join."""
    g = units.groupBy("id", *keys).agg(
        F.min(F.when(F.col("side") == 1, F.col("i"))).alias("s1_i"),
        F.min(F.when(F.col("side") == 2, F.col("i"))).alias("s2_i"),
    )
    return g.filter(F.col("s1_i").isNotNull() & F.col("s2_i").isNotNull()).select(
        "id", F.lit(kind).alias("kind"), F.col(word).alias("s1_word"), "s1_i",
        F.col(word).alias("s2_word"), "s2_i",
    )


def lexical_links(toks: DataFrame) -> DataFrame:
    """Shared lemmas of content words and referential pronouns."""
    word = F.lower("text")
    key = (
        F.col("pos").isin(fixed.CONTENT_POS)
        | word.isin(fixed.REFERENTIAL_PRONOUNS)
        | ((word == "that") & (F.col("pos") == "DET"))
    )
    units = toks.filter(key).select("id", "side", "i", F.lower("lemma").alias("lemma"))
    return _shared(units.filter(~F.col("lemma").isin(fixed.IGNORED_UNITS)), ["lemma"], "lexical", "lemma")


def with_head_lemma(toks: DataFrame) -> DataFrame:
    """Add the lemma of each token's head, read inside the gathered sentence."""
    rows = F.array_sort(F.collect_list(F.struct("i", "lemma", "dep", "head_i")))
    g = toks.groupBy("id", "side").agg(rows.alias("_t"))
    full = F.transform(
        "_t",
        lambda t: F.struct(
            t["i"].alias("i"), t["lemma"].alias("lemma"), t["dep"].alias("dep"),
            F.get("_t", t["head_i"])["lemma"].alias("head_lemma"),
        ),
    )
    return g.select("id", "side", F.explode(full).alias("_u")).select("id", "side", "_u.*")


def syntactic_links(toks: DataFrame) -> DataFrame:
    """Shared ``(head lemma, lemma, dependency)`` triples without punctuation."""
    units = with_head_lemma(toks).filter(F.col("dep") != "punct")
    return _shared(units, ["head_lemma", "lemma", "dep"], "syntactic", "lemma")


def vector_classes(vectors: DataFrame) -> DataFrame:
    """``(lemma, class)``: lemmas with one vector are one class, named by the vector's hash."""
    name = F.md5(F.array_join(F.col("embedding").cast("array<string>"), ",").cast("binary"))
    return vectors.select("lemma", name.alias("class"), "embedding")


def similar_classes(
    vectors: DataFrame, threshold: float = fixed.SIMILARITY_THRESHOLD
) -> DataFrame:
    """``(x, y, similarity)``: classes of vectors that are close, both ways and with themselves."""
    distinct = vector_classes(vectors).groupBy("class").agg(F.first("embedding").alias("embedding"))
    pairs = resume.cut_lineage(similar.similar_pairs(distinct, threshold, "class"))
    own = distinct.filter(F.exists("embedding", lambda v: v != 0)).select(
        F.col("class").alias("x"), F.col("class").alias("y"), F.lit(1.0).alias("similarity")
    )
    return own.union(pairs.select("a", "b", "similarity")).union(pairs.select("b", "a", "similarity"))


def semantic_links(
    toks: DataFrame, vectors: DataFrame, threshold: float = fixed.SIMILARITY_THRESHOLD, score=False
) -> DataFrame:
    """Token pairs of the two members with different lemmas and a close meaning.

    ``vectors`` is ``(lemma, embedding)``. The close pairs of the vocabulary are found once, by
    :func:`rostrum.operators.similar.similar_pairs` over its distinct vectors, before any sentence
    is read. The lemmas of a first member then meet the classes close to their own, and the lemmas
    of the second by pair and class; no vector goes with them.
    """
    units = toks.filter(F.col("pos").isin(fixed.SEMANTIC_POS)).select(
        "id", "side", "i", F.lower("lemma").alias("lemma")
    )
    units = units.groupBy("id", "side", "lemma").agg(F.array_sort(F.collect_list("i")).alias("at"))
    known = units.join(vector_classes(vectors).select("lemma", "class"), "lemma")
    first = known.filter("side = 1").select(
        "id", F.col("lemma").alias("s1_word"), F.col("at").alias("_a1"), F.col("class").alias("x")
    )
    second = known.filter("side = 2").select(
        "id", F.col("lemma").alias("s2_word"), F.col("at").alias("_a2"), F.col("class").alias("y")
    )
    rows = first.join(similar_classes(vectors, threshold), "x").join(second, ["id", "y"])
    rows = rows.filter(F.col("s1_word") != F.col("s2_word"))
    rows = rows.withColumn("s1_i", F.explode("_a1")).withColumn("s2_i", F.explode("_a2"))
    out = rows.select(
        "id", F.lit("semantic").alias("kind"), "s1_word", "s1_i", "s2_word", "s2_i", "similarity"
    )
    return out if score else out.drop("similarity")


def transition_markers(pairs: DataFrame, second="s2", keep_on=None, shift=None) -> DataFrame:
    """First word of the second member as a marker of continuation or of shift."""
    keep_on = fixed.CONTINUE_MARKERS if keep_on is None else keep_on
    shift = fixed.SHIFT_MARKERS if shift is None else shift
    word = F.lower(F.get(T.tokens(second), F.lit(0)))
    kind = F.when(word.isin(list(keep_on)), "transition_continue").when(
        word.isin(list(shift)), "transition_shift"
    )
    rows = pairs.select("id", kind.alias("kind"), word.alias("s2_word")).filter(F.col("kind").isNotNull())
    return rows.select(
        "id", "kind", F.lit(None).cast("string").alias("s1_word"), F.lit(None).cast("int").alias("s1_i"),
        "s2_word", F.lit(0).alias("s2_i"),
    )


def coreference_clusters(coref: DataFrame, lengths: DataFrame) -> DataFrame:
    """Clusters that link the two members of a pair.

    ``coref`` is ``(id, cluster_id, text, start)`` on the tokens of both members in a row,
    ``lengths`` is ``(id, n1)``. The last token of the first member, ``n1 - 1``, is on
    neither side when a cluster is tested and on the second when a mention is placed.
    Clusters of two mentions with equal text are dropped; so are mentions of punctuation.
    """
    x = coref.join(lengths, "id").withColumn("_edge", F.col("n1") - 1)
    x = x.withColumn("side", F.when(F.col("start") < F.col("_edge"), 1).otherwise(2))
    words = F.when(
        F.col("text").rlike(r"[\p{L}\p{N}]"),
        F.struct(F.col("start").alias("start"), F.col("text").alias("text"), F.col("side").alias("side")),
    )
    g = x.groupBy("id", "cluster_id").agg(
        F.bool_and(F.col("start") < F.col("_edge")).alias("_all1"),
        F.bool_and(F.col("start") > F.col("_edge")).alias("_all2"),
        F.array_sort(F.collect_list(words)).alias("mentions"),
    )
    m = F.col("mentions")
    same = (F.size(m) == 2) & (F.lower(F.get(m, F.lit(0))["text"]) == F.lower(F.get(m, F.lit(1))["text"]))
    return g.filter(~F.col("_all1") & ~F.col("_all2") & ~same).select("id", "cluster_id", "mentions")


def coreference_links(coref: DataFrame, lengths: DataFrame) -> DataFrame:
    """First mention of each member, per linking cluster, as findings."""
    c = coreference_clusters(coref, lengths)
    first = F.get(F.filter("mentions", lambda x: x["side"] == 1), F.lit(0))
    second = F.get(F.filter("mentions", lambda x: x["side"] == 2), F.lit(0))
    return c.select(
        "id", F.lit("coreference").alias("kind"),
        first["text"].alias("s1_word"), first["start"].alias("s1_i"),
        second["text"].alias("s2_word"), second["start"].alias("s2_i"),
    )


def classify(pairs: DataFrame, findings: list[DataFrame]) -> DataFrame:
    """``continue`` when any rule of continuity fires; a shift marker does not veto.

    ``kinds`` lists the findings in rule order, a shift marker last.
    """
    rows = findings[0].select("id", "kind")
    for f in findings[1:]:
        rows = rows.unionByName(f.select("id", "kind"))
    order = F.array(*[F.lit(k) for k in KINDS + ["transition_shift"]])
    found = rows.groupBy("id").agg(F.collect_set("kind").alias("_k"))
    x = pairs.join(found, "id", "left")
    present = F.coalesce(F.col("_k"), F.array().cast("array<string>"))
    x = x.withColumn("kinds", F.filter(order, lambda k: F.array_contains(present, k)))
    fired = F.exists("kinds", lambda k: k.isin(KINDS))
    return x.withColumn("rule_label", F.when(fired, "continue").otherwise("not_continue")).drop("_k")


def disagreements(df: DataFrame, a="label", b="rule_label") -> DataFrame:
    return df.filter(F.col(a) != F.col(b))


def main_topic(toks: DataFrame, issues: DataFrame, most: int = fixed.TOPIC_MAX_DISTANCE) -> DataFrame:
    """Issues that are the main topic of a sentence: a token with the issue's lemma is a
    subject, object, attribute or adverbial and near the root of the same parse.

    ``issues`` is ``(id, sent_i, issue)`` with the lemma of the issue.
    """
    # The root and its candidates come from one pass: a sentence bounds the set of its tokens.
    root, close = F.col("dep") == "ROOT", F.col("dep").isin(fixed.TOPIC_DEPS)
    parses = toks.filter(root | close).groupBy("id", "sent_i").agg(
        F.min(F.when(root, F.col("i"))).alias("_root"),
        F.collect_set(F.when(close, F.struct("i", F.col("lemma").alias("issue")))).alias("_close"),
    )
    near = F.filter("_close", lambda t: F.abs(t["i"] - F.col("_root")) <= most)
    named = F.array_distinct(F.transform(near, lambda t: t["issue"]))
    found = parses.select("id", "sent_i", F.explode(named).alias("issue"))
    return found.join(issues.select("id", "sent_i", "issue"), ["id", "sent_i", "issue"], "left_semi")


def mentions_lemma(toks: DataFrame, lemma: str) -> DataFrame:
    """Does a lemma occur in each sentence?"""
    return toks.groupBy("id", "sent_i").agg(F.bool_or(F.col("lemma") == lemma).alias("has_lemma"))


# --- counts over findings ---------------------------------------------------------------


def kind_counts(df: DataFrame, kinds="kinds") -> DataFrame:
    return df.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def concurrency_counts(df: DataFrame, kinds="kinds") -> DataFrame:
    """Pairs by the number of kinds found; pairs without any are left out."""
    k = F.size(kinds).alias("n_kinds")
    return df.select(k).filter(F.col("n_kinds") > 0).groupBy("n_kinds").agg(F.count(F.lit(1)).alias("n"))


def combination_counts(df: DataFrame, kinds="kinds") -> DataFrame:
    combo = F.array_join(F.array_sort(F.array_distinct(kinds)), " + ").alias("combination")
    return df.filter(F.size(kinds) > 0).groupBy(combo).agg(F.count(F.lit(1)).alias("n"))


def first_kind_counts(df: DataFrame, kinds="kinds", label="rule_label") -> DataFrame:
    """Kind of the first finding only, over the pairs ruled ``continue``."""
    first = F.get(kinds, F.lit(0)).alias("kind")
    return (
        df.filter(F.col(label) == "continue").select(first).filter(F.col("kind").isNotNull())
        .groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    )


def align(findings: DataFrame, lengths: DataFrame, attributions: DataFrame, labels: DataFrame) -> DataFrame:
    """Attribution value of each word that a rule points at.

    Word ``i`` of the first member is position ``i``, of the second ``n1 + i``. Coreference
    positions already run over both members. A word that differs from the attributed
    feature is reported in ``mismatch``; a missing position gives NULL.
    ``attributions`` is ``(id, pos_i, feature, value)``, ``labels`` is ``(id, …)``.
    """
    sides = F.array(
        F.struct(F.lit("s1").alias("side"), F.col("s1_word").alias("word"), F.col("s1_i").alias("i")),
        F.struct(F.lit("s2").alias("side"), F.col("s2_word").alias("word"), F.col("s2_i").alias("i")),
    )
    rows = findings.select("id", "kind", F.explode(sides).alias("_s")).select("id", "kind", "_s.*")
    rows = rows.filter(F.col("word").isNotNull()).join(lengths, "id")
    shifted = (F.col("side") == "s2") & (F.col("kind") != "coreference")
    rows = rows.withColumn("pos_i", (F.col("i") + F.when(shifted, F.col("n1")).otherwise(0)).cast("int"))
    out = rows.join(attributions, ["id", "pos_i"], "left").join(labels, "id")
    return out.withColumn(
        "mismatch", ~F.lower("word").eqNullSafe(F.lower("feature"))
    ).drop("n1")
