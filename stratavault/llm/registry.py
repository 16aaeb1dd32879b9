"""Queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from . import additive_quantisation, best_fit_packing, cover_tree_search, html_extraction, language_id, minhash_dedup, secret_scan, source_mixing, substring_dedup, warc_chain

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_language_id": language_id.op2_language_id,
    "op3_near_duplicates": minhash_dedup.op3_near_duplicates,
    "op4_packing": best_fit_packing.op4_packing,
    "op5_warc": warc_chain.op5_warc,
    "op6_nearest": additive_quantisation.op6_nearest,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_exact_top_k": cover_tree_search.op8_exact_top_k,
    "op9_source_mixing": source_mixing.op9_source_mixing,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op3_near_duplicates": minhash_dedup.OP3_SQL,
    "op8_exact_top_k": cover_tree_search.OP8_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op5_warc": warc_chain.OP5_SQL,
}
