"""The queries of this folder and their SQL, by name."""

from __future__ import annotations

from . import op1_license_scan, op2_quality_classifier, op3_decontamination, op4_url_filters, op5_line_dedup, op6_lm_scoring, op7_suffix_dedup, op8_simhash, op9_quality_rules, op10_sentencepiece

QUERIES = {
    "op1_license_scan": op1_license_scan.op1_license_scan,
    "op2_quality_classifier": op2_quality_classifier.op2_quality_classifier,
    "op3_decontamination": op3_decontamination.op3_decontamination,
    "op4_url_filters": op4_url_filters.op4_url_filters,
    "op5_line_dedup": op5_line_dedup.op5_line_dedup,
    "op6_lm_scoring": op6_lm_scoring.op6_lm_scoring,
    "op7_suffix_dedup": op7_suffix_dedup.op7_suffix_dedup,
    "op8_simhash": op8_simhash.op8_simhash,
    "op9_quality_rules": op9_quality_rules.op9_quality_rules,
    "op10_sentencepiece": op10_sentencepiece.op10_sentencepiece,
}


def oracle_sql() -> dict[str, str]:
    """None for op2, op6 (trained models), op7 (no byte strings of all offsets), op8 and op10 (their hashing and the library); tests hold those against brute force."""
    return {"op1_license_scan": op1_license_scan.sql(), "op3_decontamination": op3_decontamination.sql(), "op4_url_filters": op4_url_filters.sql(), "op5_line_dedup": op5_line_dedup.sql(), "op9_quality_rules": op9_quality_rules.SQL}
