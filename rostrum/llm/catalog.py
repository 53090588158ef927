"""Queries of the operators of this subpackage, and SQL for those that SQL can say."""

from __future__ import annotations

from rostrum.llm import (
    alignment,
    codes,
    decontaminate,
    kneser,
    langid,
    neardup,
    outliers,
    packing,
    pages,
    passages,
    pieces,
    quality,
    surrogates,
)

QUERIES = {
    "op1_html_extraction": pages.op1_html_extraction,
    "op2_pii_surrogates": surrogates.op2_pii_surrogates,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_packing": packing.op5_packing,
    "op6_lm_scores": kneser.op6_lm_scores,
    "op7_quality_outliers": outliers.op7_quality_outliers,
    "op8_repeated_passages": passages.op8_repeated_passages,
    "op9_language_id": langid.op9_language_id,
    "op10_near_duplicates": neardup.op10_near_duplicates,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_sentencepiece": pieces.op13_sentencepiece,
}

SQL: dict[str, str] = {
    "op4_decontamination": decontaminate.OP4_SQL,
    "op10_near_duplicates": neardup.OP10_SQL,
    "op12_vector_codes": codes.OP12_SQL,
}
