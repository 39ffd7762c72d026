"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from sparkframe.llm import ann, classifier, licenses, mixing, ngram_join, packing, quality_rules, rlz_dedup, suffix_dedup, token_store

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_token_store": token_store.op4_token_store,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_mixing": mixing.op6_mixing,
    "op7_cross_polytope": ann.op7_cross_polytope,
    "op8_quality_classifier": classifier.op8_quality_classifier,
    "op9_rlz_dedup": rlz_dedup.op9_rlz_dedup,
    "op10_license_scan": licenses.op10_license_scan,
}
ORACLE = {
    "op3_quality_rules": quality_rules.ORACLE,
}
