"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from covarium.llm import bpe, importance, inner_products, langid, lexical, merkle, mixing, quality_model, rules, simhash, substring, toxicity, wordpiece

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_mixing": mixing.query,
    "op3_quality_classifier": quality_model.query,
    "op4_language_id": langid.query,
    "op5_substring_dedup": substring.query,
    "op6_merkle_fingerprints": merkle.query,
    "op7_quality_rules": rules.query,
    "op8_token_counts": wordpiece.query,
    "op9_simhash": simhash.query,
    "op10_toxicity": toxicity.query,
    "op11_top_k": inner_products.query,
    "op12_lexical_search": lexical.query,
    "op13_importance_resampling": importance.query,
    "rule_ablations": rules.ablation_query,
}
ORACLES = {
    "op2_mixing": mixing.SQL,
    "op5_substring_dedup": substring.SQL,
    "op7_quality_rules": rules.SQL,
    "op11_top_k": inner_products.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_importance_resampling": importance.SQL,
    "rule_ablations": rules.ABLATION_SQL,
}
