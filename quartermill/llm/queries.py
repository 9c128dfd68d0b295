"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from quartermill.llm import codec, fill_middle, fingerprint, jaccard_join, language, license_scan, mixing, near_dup, quality_model, quality_rules, repair, secret_scan, tokens

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_token_counts": tokens.op2,
    "op3_simhash_near_dup": near_dup.op3,
    "op4_document_fingerprints": fingerprint.op4,
    "op5_language_id": language.op5,
    "op5_language_id_pages": language.op5_pages,
    "op6_quality_classifier": quality_model.op6,
    "op7_license_scan": license_scan.op7,
    "op8_quality_rules": quality_rules.op8,
    "op9_bpe_codec": codec.op9,
    "op10_secret_scan": secret_scan.op10,
    "op11_fill_in_middle": fill_middle.op11,
    "op12_conversation_repair": repair.op12,
    "op13_jaccard_join": jaccard_join.op13,
}

ORACLES = {"op1_mix_sources": mixing.OP1_SQL, "op8_quality_rules": quality_rules.OP8_SQL, "op11_fill_in_middle": fill_middle.OP11_SQL}
