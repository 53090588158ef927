"""From passages to rule-labelled sentence pairs and their agreement with people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.functions import clean
from rostrum.functions import text as T
from rostrum.operators import annotate, evaluate, topic


def label_passages(
    passages: DataFrame, vectors=None, coref=None, tokenizer=annotate.tokens
) -> tuple[DataFrame, DataFrame]:
    """Pairs with the human label, the findings and the rule label; and the agreement.

    ``passages`` is ``(passage_id, text array<struct<sentence, role>>)``. Rules whose table
    is not given (``vectors``, ``coref``) or whose columns are empty find nothing.
    """
    pairs = topic.short_pairs(topic.array_pairs(passages))
    pairs = pairs.withColumns(
        {
            "id": F.concat_ws("-", "passage_id", "i"),
            "s1": clean.expand_contractions("s1"),
            "s2": clean.expand_contractions("s2"),
        }
    )
    toks = topic.pair_tokens(pairs, tokenizer)
    found = [topic.lexical_links(toks), topic.syntactic_links(toks), topic.transition_markers(pairs)]
    if vectors is not None:
        found.append(topic.semantic_links(toks, vectors))
    if coref is not None:
        found.append(topic.coreference_links(coref, pairs.select("id", T.n_tokens("s1").alias("n1"))))
    labelled = topic.classify(pairs, found)
    return labelled, evaluate.summary_metrics(labelled, "label", "rule_label")
