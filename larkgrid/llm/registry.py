"""The queries of this package, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from larkgrid.llm import ann, bpe, exact_search, language_id, minhash, oracles, packing, secret_scans, suffix_dedup, toxicity, url_filters

QUERIES = {
    "op1_url_filters": url_filters.op1_url_filters,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": language_id.op3_language_id,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_secret_scans": secret_scans.op5_secret_scans,
    "op6_ann": ann.op6_ann,
    "op7_minhash": minhash.op7_minhash,
    "op8_exact_top_k": exact_search.op8_exact_top_k,
    "op9_bpe": bpe.op9_bpe,
    "op10_packing": packing.op10_packing,
}

ORACLES = {
    "op1_url_filters": url_filters.OP1_SQL,
    "op4_suffix_dedup": oracles.OP4_SQL,
    "op7_minhash": oracles.OP7_SQL,
    "op8_exact_top_k": exact_search.OP8_SQL,
}
