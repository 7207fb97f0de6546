"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact_dedup, fill_middle, line_dedup, packing, quality_knn, quality_rules, secret_scan, sentencepiece_wfst, sharding, simhash, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_quality_knn": quality_knn.op1_quality_knn,
    "op2_sentencepiece": sentencepiece_wfst.op2_sentencepiece,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_packing": packing.op5_packing,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_simhash": simhash.op7_simhash,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sharding": sharding.op9_sharding,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_secret_scan": secret_scan.op12_secret_scan,
    "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
}
ORACLE = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_quality_rules": quality_rules.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_secret_scan": secret_scan.SQL,
    "op13_fill_in_middle": fill_middle.SQL,
}
