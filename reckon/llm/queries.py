"""The registered queries of this subpackage: one for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from reckon.llm import chat_format, decontaminate, filter_audit, html_extract, mixing, near_dedup, oracles, quality, source_audit, substring_dedup, suffix_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_suffix_array_dedup": suffix_dedup.query,
    "op3_benchmark_decontamination": decontaminate.query,
    "op4_source_mixing": mixing.query,
    "op5_quality_rules": quality.query,
    "op6_warc_bundles": warc.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_minhash_near_dedup": near_dedup.query,
    "op9_url_filters": url_filter.query,
    "op10_chat_formatting": chat_format.query,
    "op11_filter_interaction_audit": filter_audit.query,
    "op12_source_divergence_audit": source_audit.query,
    "op13_html_extraction": html_extract.query,
}
#: DuckDB SQL for the same rows, where SQL can express them on whole tables; the others are tested against brute force.
ORACLE = oracles.ORACLE
