"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from contrail.llm import decontamination, html_text, minhash_dedup, mixing, prefix_trie, ring, spelling, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter, winnowing


def queries() -> dict:
    return {
        "op1_winnowing": winnowing.op1,
        "op2_toxicity": toxicity.op2,
        "op3_ring_sharding": ring.op3,
        "op4_decontamination": decontamination.op4,
        "op5_source_mixing": mixing.op5,
        "op6_url_filter": url_filter.op6,
        "op7_suffix_array_dedup": suffix_dedup.op7,
        "op8_substring_dedup": substring_dedup.op8,
        "op9_html_text": html_text.op9,
        "op10_minhash_near_dedup": minhash_dedup.op10,
        "op11_token_counts": token_counts.op11,
        "op12_spelling_variants": spelling.op12,
        "op13_prefix_trie": prefix_trie.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontamination.OP4_SQL,
        "op7_suffix_array_dedup": suffix_dedup.OP7_SQL,
        "op8_substring_dedup": substring_dedup.OP8_SQL,
        "op10_minhash_near_dedup": minhash_dedup.OP10_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
