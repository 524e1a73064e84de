"""Registered queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from sparkeval.llm import exact_dedup, filter_audit, html_text, language, mixing, near_dedup, packing, privacy, sharding, spelling, substring_dedup, topk, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_html_extraction": html_text.op2_html_extraction,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_mixing": mixing.op4_mixing,
    "op5_packing": packing.op5_packing,
    "op6_language_id": language.op6_language_id,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_topk_search": topk.op8_topk_search,
    "op9_pii": privacy.op9_pii,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_spelling_variants": spelling.op12_spelling_variants,
    "op13_url_filter": url_filter.op13_url_filter,
}

ORACLE_SQL = {
    "op4_mixing": mixing.OP4_SQL,
    "op8_topk_search": topk.OP8_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_spelling_variants": spelling.OP12_SQL,
    "op13_url_filter": url_filter.OP13_SQL,
}
