"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from plumbline.llm import conversations, filter_audit, html_extract, jaccard, mixing, neighbours, packing, pii, quality, sharding, suffixes, token_files, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_token_files": token_files.op4_token_files,
    "op5_mixing": mixing.op5_mixing,
    "op6_neighbours": neighbours.op6_neighbours,
    "op7_pii": pii.op7_pii,
    "op8_jaccard": jaccard.op8_jaccard,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_packing": packing.op10_packing,
    "op11_sharding": sharding.op11_sharding,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLES = {"op1_url_filter": url_filter.SQL, "op11_sharding": sharding.SQL, "op12_conversation_repair": conversations.SQL, "op13_filter_audit": filter_audit.SQL}
