"""The thin queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tideline.llm import decontaminate, langid, license_scan, lm_score, ngram_join, packing, quality_gbt, quality_rules, token_counts, toxicity

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_license_scan": license_scan.op4_license_scan,
    "op5_language_id": langid.op5_language_id,
    "op6_quality_classifier": quality_gbt.op6_quality_classifier,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL = {
    "op4_license_scan": license_scan.oracle(),
    "op9_ngram_join": ngram_join.oracle(),
}
