"""Registered queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from tabwise.llm import bitplane_clusters, collision_search, lm_scoring, packing, phrase_mining, quality_rules, simhash_dedup, source_mixing, substring_dedup, token_binary, topk_search, url_filters, warc_zip

QUERIES = {
    "op1_token_binary": token_binary.op1_token_binary,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_warc_zip": warc_zip.op7_warc_zip,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_source_mixing": source_mixing.op10_source_mixing,
    "op11_collision_search": collision_search.op11_collision_search,
    "op12_bitplane_clusters": bitplane_clusters.op12_bitplane_clusters,
    "op13_phrase_mining": phrase_mining.op13_phrase_mining,
}

ORACLES = {
    "op2_substring_dedup": substring_dedup.SQL,
    "op5_topk_search": topk_search.SQL,
    "op7_warc_zip": warc_zip.SQL,
    "op8_url_filters": url_filters.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op10_source_mixing": source_mixing.SQL,
    "op12_bitplane_clusters": bitplane_clusters.SQL,
    "op13_phrase_mining": phrase_mining.SQL,
}
