"""Stance features: lexicon words, phrases, crossed negations and constructions.

Hits are rows, found by joins of tokens and n-grams with lexicon tables. Vectors are
assembled per sentence at the end.

``lexicon(category, pos, entry)`` holds words and phrases alike: an entry of several
words is a phrase on lemmas. ``pos`` is NULL or ``""`` when any word class will do.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rostrum.functions import fixed
from rostrum.operators import annotate, phrases, spans
from rostrum.streaming.resume import cut_lineage

HIT_COLUMNS = ["id", "sent_i", "category", "pos", "kind", "start", "end"]


def modal_lexicon(spark) -> DataFrame:
    """The modal words and phrases as a lexicon table."""
    rows = [
        (f"{kind}_modal", "", entry)
        for table in (fixed.MODALS, fixed.MODAL_PHRASES)
        for kind, entries in table.items()
        for entry in entries
    ]
    return spark.createDataFrame(rows, "category string, pos string, entry string")


def _any_class(c) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def word_hits(toks: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Tokens whose class and lemma stand in the lexicon."""
    words = (
        lexicon.filter(~F.contains(F.col("entry"), F.lit(" ")))
        .select("category", F.coalesce("pos", F.lit("")).alias("_pos"), F.col("entry").alias("lemma"))
        .distinct()
    )
    # As a table it is broadcast by its bytes: the tokens stay where they are.
    words = cut_lineage(words)
    hit = toks.select("id", "sent_i", "i", "lemma", F.col("pos").alias("_tok_pos")).join(words, "lemma")
    hit = hit.filter((F.col("_pos") == "") | (F.col("_pos") == F.col("_tok_pos")))
    return hit.select(
        "id", "sent_i", "category", F.col("_pos").alias("pos"), F.lit("word").alias("kind"),
        F.col("i").alias("start"), (F.col("i") + 1).alias("end"),
    )


def phrase_hits(sents: DataFrame, lexicon: DataFrame, counted: bool = False) -> DataFrame:
    """Lemma sequences that are lexicon phrases, found from their rarest lemma; see
    :mod:`rostrum.operators.phrases`. ``counted`` takes the rarest one in the corpus.
    """
    entries = lexicon.filter(F.contains(F.col("entry"), F.lit(" "))).select(
        F.split("entry", " ").alias("words"),
        F.struct("category", F.coalesce("pos", F.lit("")).alias("pos")).alias("payload"),
    ).distinct()
    counts = phrases.token_counts(sents, "lemma", entries) if counted else None
    hit = phrases.find(sents, "lemma", phrases.parts(entries, counts))
    return hit.select(
        "id", "sent_i", "payload.category", "payload.pos", F.lit("phrase").alias("kind"), "start", "end"
    )


def negation_hits(
    sents: DataFrame, lexicon: DataFrame, opposites=None, negators=("non", "not"), plain="not"
) -> DataFrame:
    """Negated words count for the opposite category.

    ADJ: a negator, an optional hyphen, then the lemma in any class. ADV: ``not`` and the
    lemma in any class. VERB: ``not`` and the lemma as a verb.
    """
    return hit_rows(with_hits(sents, lexicon, ("negation",), opposites, negators, plain))


def _entries(lexicon: DataFrame, kinds, opposites) -> DataFrame:
    """One row with ``_lexicon``: lists of entries by the lemma that finds them, dealt by its hash.

    A list is an array of maps, so that a lemma is compared with few others.
    """
    pos = F.coalesce("pos", F.lit("")).alias("pos")
    single = lexicon.filter(~F.contains(F.col("entry"), F.lit(" ")))
    one = F.array("entry").alias("words"), F.lit(0).alias("at"), F.col("entry").alias("lemma")
    out = []
    if "word" in kinds:
        out.append(single.select("category", pos, F.lit("word").alias("kind"), *one))
    if "negation" in kinds:
        table = F.create_map(*[F.lit(x) for kv in opposites.items() for x in kv])
        turned = single.withColumn("category", F.element_at(table, F.col("category")))
        turned = turned.filter(F.col("category").isNotNull())
        out.append(turned.select("category", pos, F.lit("negation").alias("kind"), *one))
    if "phrase" in kinds:
        words = F.split("entry", " ")
        several = lexicon.filter(F.contains(F.col("entry"), F.lit(" ")))
        found = phrases.anchors(several.select(words.alias("words"))).withColumnRenamed("anchor", "lemma")
        several = several.select("category", pos, F.lit("phrase").alias("kind"), words.alias("words"))
        out.append(several.join(found, "words").select("category", "pos", "kind", "words", "at", "lemma"))
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    listed = every.groupBy("lemma").agg(
        F.collect_set(F.struct("category", "pos", "kind", "words", "at")).alias("entries")
    )
    dealt = listed.groupBy(F.pmod(F.hash("lemma"), F.lit(BUCKETS)).alias("bucket")).agg(
        F.map_from_entries(F.collect_list(F.struct("lemma", "entries"))).alias("lists")
    )
    whole = dealt.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "lists"))).alias("m"))
    buckets = F.sequence(F.lit(0), F.lit(BUCKETS - 1))
    return whole.select(F.transform(buckets, lambda b: F.try_element_at(F.col("m"), b)).alias("_lexicon"))


BUCKETS = 256


def with_hits(
    sents: DataFrame, lexicon: DataFrame, kinds=("word", "phrase", "negation"), opposites=None,
    negators=("non", "not"), plain="not",
) -> DataFrame:
    """``sents`` with ``hits``: those of :func:`word_hits`, :func:`phrase_hits` and :func:`negation_hits`.

    The lexicon is one broadcast row and the hits are found in the row of the sentence, so no
    token is shuffled. For lexicons of words and phrases; large tables of phrases have
    :mod:`rostrum.operators.phrases`.
    """
    opposites = fixed.OPPOSITES if opposites is None else opposites
    x = sents.crossJoin(F.broadcast(cut_lineage(_entries(lexicon, kinds, opposites))))

    def looked_up(lemma, i):
        found = F.try_element_at(F.get("_lexicon", F.pmod(F.hash(lemma), F.lit(BUCKETS))), lemma)
        return F.when(found.isNotNull(), F.struct(i.alias("at"), found.alias("entries")))

    def placed(m):
        token = F.get("tokens", m["at"])
        return F.struct(token["i"].alias("i"), m["at"].alias("at"), token["pos"].alias("pos"), m["entries"].alias("entries"))

    # Over the lemmas alone: few tokens are met.
    met = F.filter(F.transform("tokens.lemma", looked_up), lambda m: m.isNotNull())
    x = x.withColumn("_met", F.transform(met, placed))

    def lower(at):
        return F.lower(F.get("tokens", at)["text"])

    def stands(e, m):
        start = m["at"] - e["at"]
        same = F.transform(e["words"], lambda w, k: F.get("tokens", start + k)["lemma"] == w)
        before = lower(m["at"] - 1)
        dashed = before.isin("-", "–") & lower(m["at"] - 2).isin(list(negators))
        direct = before == plain
        negated = (before.isin(list(negators)) | dashed) & (
            F.when(e["pos"] == "ADJ", F.lit(True))
            .when(e["pos"] == "ADV", direct)
            .when(e["pos"] == "VERB", direct & (m["pos"] == "VERB"))
            .otherwise(F.lit(False))
        )
        return (
            F.when(e["kind"] == "word", (e["pos"] == "") | (e["pos"] == m["pos"]))
            .when(e["kind"] == "phrase", (start >= 0) & F.forall(same, lambda s: F.coalesce(s, F.lit(False))))
            .otherwise(negated)
        )

    def hit(e, m):
        start = (
            F.when(e["kind"] == "word", m["i"]).when(e["kind"] == "phrase", m["at"] - e["at"])
            .when(lower(m["at"] - 1).isin("-", "–"), m["at"] - 2).otherwise(m["at"] - 1)
        )
        end = (
            F.when(e["kind"] == "word", m["i"] + 1)
            .when(e["kind"] == "phrase", m["at"] - e["at"] + F.size(e["words"])).otherwise(m["at"] + 1)
        )
        return F.struct(
            e["category"].alias("category"), e["pos"].alias("pos"), e["kind"].alias("kind"),
            start.alias("start"), end.alias("end"),
        )

    hits = F.transform(
        "_met", lambda m: F.transform(F.filter(m["entries"], lambda e: stands(e, m)), lambda e: hit(e, m))
    )
    x = x.withColumn("hits", F.flatten(hits))
    return x.select(*sents.columns, annotate.bound("hits"))


def all_hits(
    sents: DataFrame, toks: DataFrame | None, lexicon: DataFrame, opposites=None, words_only=False, **negation
) -> DataFrame:
    """Word, phrase and negation hits; ``words_only`` is the token-level variant.

    Without ``toks`` the words are found in the rows of ``sents`` too.
    """
    if toks is None:
        kinds = ("word",) if words_only else ("word", "phrase", "negation")
        return hit_rows(with_hits(sents, lexicon, kinds, opposites, **negation))
    hits = word_hits(toks, lexicon)
    if words_only:
        return hits
    return hits.unionByName(phrase_hits(sents, lexicon)).unionByName(
        negation_hits(sents, lexicon, opposites, **negation)
    )


def hit_rows(sents: DataFrame) -> DataFrame:
    """The ``hits`` of sentences as rows."""
    return sents.select("id", "sent_i", F.inline("hits")).select(*HIT_COLUMNS)


# --- punctuation-free tokens and vectors ----------------------------------------------


def kept_tokens(sents: DataFrame) -> DataFrame:
    """Tokens without punctuation, with their new index ``k`` and old index ``i``."""
    kept = F.filter("tokens", lambda t: ~t["text"].isin(fixed.DROPPED_PUNCT))
    return sents.select(
        "id", "sent_i", F.posexplode(F.transform(kept, lambda t: F.struct(t["i"], t["text"]))).alias("k", "_t")
    ).select("id", "sent_i", "k", "_t.i", "_t.text")


def feature_name(category: str, pos: str) -> str:
    return f"{category}_{pos.lower()}" if pos else category


def vectors(sents: DataFrame, hits: DataFrame | None, features: list[tuple[str, str]], patterns=None) -> DataFrame:
    """One 0/1 array over the punctuation-free tokens for each ``(category, pos)``.

    Each array has exactly one value per kept token, whatever the number of hits.
    Without ``hits`` they are the column of :func:`with_hits` in ``sents``.
    ``patterns`` adds spans on the punctuation-free index, see :func:`pattern_hits`.
    """
    kept = F.transform(F.filter("tokens", lambda t: ~t["text"].isin(fixed.DROPPED_PUNCT)), lambda t: t["i"])
    found = [] if hits is not None else [F.when(F.col("id").isNotNull(), F.col("hits")).alias("_hits")]
    # Only the indexes of the tokens go through the joins.
    x = sents.select("id", "sent_i", kept.alias("_kept"), *found)
    for name, rows in (("_hits", hits), ("_patterns", patterns)):
        if rows is not None:
            grouped = rows.groupBy("id", "sent_i").agg(
                F.collect_set(F.struct("category", "pos", "start", "end")).alias(name)
            )
            x = x.join(grouped, ["id", "sent_i"], "left")

    def mine(source, category, pos):
        own = F.filter(source, lambda h: (h["category"] == category) & (h["pos"] == pos))
        return F.coalesce(F.transform(own, lambda h: F.struct(h["start"], h["end"])), F.array().cast(SPANS))

    def covered(source, at):
        return F.exists(source, lambda h: (h["start"] <= at) & (at < h["end"]))

    def vector(category, pos):
        spans_of = [mine(c, category, pos) for c in ("_hits", "_patterns") if c in x.columns]

        def bits(own):
            def bit(i, k):
                hit = covered(own["s0"], i)
                return ((hit | covered(own["s1"], k)) if len(spans_of) > 1 else hit).cast("int")

            none = F.size(own["s0"]) == 0
            if len(spans_of) > 1:
                none = none & (F.size(own["s1"]) == 0)
            return F.when(none, F.array_repeat(F.lit(0), F.size("_kept"))).otherwise(F.transform("_kept", bit))

        # Bound by a one-element array, so that the spans of a feature are looked up once.
        bound = F.array(F.struct(*[s.alias(f"s{n}") for n, s in enumerate(spans_of)]))
        return F.get(F.transform(bound, bits), F.lit(0))

    return x.select("id", "sent_i", *[vector(c, p).alias(feature_name(c, p)) for c, p in features])


SPANS = "array<struct<start: int, end: int>>"


def standard_features() -> list[tuple[str, str]]:
    """Eight categories in three classes, and three modal kinds."""
    return [(c, p) for c, p in product(fixed.OPPOSITES, fixed.STANCE_POS)] + [
        (f"{k}_modal", "") for k in fixed.MODALS
    ]


# --- construction patterns -------------------------------------------------------------

# One step of a pattern: (field, allowed values). A pattern is a list of steps and a step
# in a nested list is optional. The constructions below.
_ARTICLES = ["a", "an", "the"]
PATTERNS = {
    ("pro", "ADJ"): [[("pos", ["ADJ"]), ("lemma", fixed.PRO_NOUNS)]],
    ("con", "ADJ"): [
        [("pos", ["ADJ"]), ("lemma", fixed.CON_NOUNS)],
        [("pos", ["ADJ"]), ("lemma", ["against"])],
    ],
    ("emphatic", "ADJ"): [[("lower", ["real", "so"]), ("pos", ["ADJ"])]],
    ("emphatic", "ADV"): [
        [("lower", ["as"]), ("lower", ["i", "we"]), [("lemma", ["have"])],
         ("lemma", ["say", "note", "announce"])],
        [("lower", ["so"]), ("pos", ["ADV"])],
    ],
    ("con", "ADV"): [
        [("pos", ["ADV"]), ("lemma", ["against"])],
        [("pos", ["ADV"]), ("lemma", fixed.CON_NOUNS)],
    ],
    ("certainty", "VERB"): [[("lemma", ["have"]), ("lemma", ["show"])]],
    ("emphatic", "VERB"): [[("lemma", ["do"]), ("pos", ["VERB"])]],
    ("pro", "VERB"): [
        [("lemma", ["make"]), [("lower", ["a"])], ("lemma", ["commitment"])],
        [("pos+lemma", ["VERB have"]), [("lower", _ARTICLES)], ("pos+lemma", ["NOUN interest"])],
        [("lemma", ["recognize"]), [("lower", ["the"])], ("pos+lemma", ["NOUN importance"])],
        [("pos+lemma", ["VERB fight"]), ("lower", ["for"])],
    ],
    ("con", "VERB"): [
        [("pos", ["VERB"]), [("lower", _ARTICLES)],
         ("pos+lemma", [f"NOUN {n}" for n in fixed.CON_NOUNS])],
        [("pos", ["VERB"]), [("pos", ["PRON"])], ("lower", ["against"])],
    ],
}
# Defined, but off unless asked for.
OPTIONAL_PATTERNS = {("emphatic", "ADJ")}


def _variants(pattern):
    """Write out the optional steps of a pattern."""
    choices = [[[], [s[0]]] if isinstance(s, list) else [[s]] for s in pattern]
    return [[s for part in pick for s in part] for pick in product(*choices)]


def _matches(tok, step) -> Column:
    field, values = step
    if field == "lower":
        value = F.lower(tok["text"])
    elif field == "pos+lemma":
        value = F.concat_ws(" ", tok["pos"], tok["lemma"])
    else:
        value = tok[field]
    return F.coalesce(value.isin(list(values)), F.lit(False))


def pattern_hits(sents: DataFrame, patterns=None) -> DataFrame:
    """Longest non-overlapping construction spans on the punctuation-free tokens.

    Overlaps are removed per category and class. Spans count kept tokens from 0. The
    patterns are tested inside the sentence row; nothing is shuffled.
    """
    if patterns is None:
        patterns = {k: v for k, v in PATTERNS.items() if k not in OPTIONAL_PATTERNS}
    x = sents.withColumn(
        "_kept", F.filter("tokens", lambda t: ~t["text"].isin(fixed.DROPPED_PUNCT))
    )

    def spans_for(variant):
        n = len(variant)

        def found(s):
            ok = F.lit(True)
            for k, step in enumerate(variant):
                ok = ok & _matches(F.get("_kept", s + k), step)
            return ok

        starts = F.when(
            F.size("_kept") >= n, F.sequence(F.lit(0), F.size("_kept") - n)
        ).otherwise(F.array().cast("array<int>"))
        return F.transform(
            F.filter(starts, found), lambda s: F.struct(s.alias("start"), (s + n).alias("end"))
        )

    out = []
    for (category, pos), rules in patterns.items():
        found = F.array_distinct(F.flatten(F.array(*[spans_for(v) for r in rules for v in _variants(r)])))
        out.append(
            F.transform(
                spans.longest_spans(found),
                lambda s: F.struct(
                    F.lit(category).alias("category"), F.lit(pos).alias("pos"),
                    s["start"].alias("start"), s["end"].alias("end"),
                ),
            )
        )
    rows = x.select("id", "sent_i", F.explode(F.flatten(F.array(*out))).alias("_h"))
    return rows.select(
        "id", "sent_i", "_h.category", "_h.pos", F.lit("pattern").alias("kind"), "_h.start", "_h.end"
    )


# --- binary features ---------------------------------------------------------------------

_BY_CLASS = {c: [feature_name(c, p) for p in fixed.STANCE_POS] for c in fixed.OPPOSITES}
EIGHT = {
    "positive_affect": _BY_CLASS["positive"],
    "negative_affect": _BY_CLASS["negative"],
    "epistemic_certainty": _BY_CLASS["certainty"],
    "epistemic_doubt": _BY_CLASS["doubt"],
    "emphatic": _BY_CLASS["emphatic"] + ["predictive_modal"],
    "hedge": _BY_CLASS["hedge"] + ["possibility_modal", "necessity_modal"],
    "pro": _BY_CLASS["pro"],
    "con": _BY_CLASS["con"],
}
# Emphatics strengthen certainty, hedges strengthen doubt.
SIX = {
    "positive_affect": EIGHT["positive_affect"],
    "negative_affect": EIGHT["negative_affect"],
    "epistemic_certainty": EIGHT["epistemic_certainty"] + EIGHT["emphatic"],
    "epistemic_doubt": EIGHT["epistemic_doubt"] + EIGHT["hedge"],
    "pro": EIGHT["pro"],
    "con": EIGHT["con"],
}


def binary_features(df: DataFrame, groups=None, keep=()) -> DataFrame:
    """1 when any member vector holds a 1, else 0."""
    groups = EIGHT if groups is None else groups

    def any_one(members):
        hit = F.lit(False)
        for m in members:
            hit = hit | F.coalesce(F.array_contains(m, 1), F.lit(False))
        return hit.cast("int")

    return df.select(*keep, *[any_one(m).alias(name) for name, m in groups.items()])


def frame_names(frames="frames") -> Column:
    """Name of the first denotation of each frame."""
    return F.filter(
        F.transform(frames, lambda f: F.get(f["denotations"], F.lit(0))["obj"]), lambda n: n.isNotNull()
    )
