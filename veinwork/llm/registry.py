"""Queries of this package, by name, and their SQL."""

from __future__ import annotations

from veinwork.llm import byte_bpe, dac_store, decontaminate, exact_dedup, filter_audit, language_id, license_scan, lm_scoring, merkle_manifest, ngram_join, personal_data, source_mixing, substring_dedup

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_personal_data": personal_data.op4_personal_data,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_substring_dedup": substring_dedup.op8_substring_dedup,
    "op9_language_id": language_id.op9_language_id,
    "op10_dac_store": dac_store.op10_dac_store,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_mix_sources": source_mixing.op12_mix_sources,
    "op13_merkle_manifest": merkle_manifest.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op13_merkle_manifest": merkle_manifest.ORACLE_SQL,
}
