"""The registered queries of the document operators, and their SQL where SQL can say it."""

from __future__ import annotations

from importlib import import_module

#: query name -> module and function of this package
_QUERIES = {
    "op1_masked_pseudo_likelihood": "masked_lm",
    "op2_viterbi_token_counts": "unigram",
    "op3_hilbert_shards": "hilbert",
    "op4_licence_scan": "licences",
    "op5_noisy_channel_toxicity": "toxicity",
    "op6_unigram_round_trip": "unigram",
    "op7_order_minhash": "omh",
    "op8_bottom_k_near_dedup": "neardup",
    "op9_offset_preserving_pii": "pii",
    "op10_string_tiling": "tiling",
    "op11_entropy_mix": "mixing",
    "op12_block_max_search": "blockmax",
    "op13_earley_repair": "earley",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    get = lambda module: import_module(f"{__package__}.{module}")
    return {"op4_licence_scan": get("licences").sql(), "op8_bottom_k_near_dedup": get("neardup").SQL, "op12_block_max_search": get("blockmax").SQL}
