"""Query name -> callable (spark, sf_dir) -> DataFrame, and the DuckDB SQL of
those that SQL can express on whole tables."""

from __future__ import annotations

from . import byte_bpe, conversation_repair, cover_dedup, embedding_forest, jaccard_join, lexical_search, license_scan, main_text, packing, suffix_array, token_files, topk, toxicity

QUERIES = {
    "op1_suffix_array_dedup": suffix_array.query,
    "op2_ngram_jaccard_join": jaccard_join.query,
    "op3_embedding_forest_dedup": embedding_forest.query,
    "op4_toxicity_chain": toxicity.query,
    "op5_elias_fano_token_files": token_files.query,
    "op6_license_scan": license_scan.query,
    "op7_histogram_top_k": topk.query,
    "op8_cover_substring_dedup": cover_dedup.query,
    "op9_distinct_word_bpe": byte_bpe.query,
    "op10_harmonic_packing": packing.query,
    "op11_composite_text_density": main_text.query,
    "op12_prefix_doubling_repair": conversation_repair.query,
    "op13_fp_tree_search": lexical_search.query,
}

ORACLES: dict[str, str] = {
    "op6_license_scan": license_scan.oracle_sql(),
    "op7_histogram_top_k": topk.ORACLE_SQL,
    "op12_prefix_doubling_repair": conversation_repair.ORACLE_SQL,
    "op13_fp_tree_search": lexical_search.ORACLE_SQL,
}
