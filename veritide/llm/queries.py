"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, html_main, interpolated_lm, language_id, line_dedup, parity_join, piece_codec, quality_rules, suffix_dedup, url_filter


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_html_main": html_main.op4_html_main,
        "op5_sentencepiece": piece_codec.op5_sentencepiece,
        "op6_url_filters": url_filter.op6_url_filters,
        "op7_ngram_jaccard": parity_join.op7_ngram_jaccard,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_interpolated_lm": interpolated_lm.op10_interpolated_lm,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filters": url_filter.ORACLE}
