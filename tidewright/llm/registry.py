"""The queries of this subpackage, and their SQL where SQL can express them."""

from . import ann, bpe, chat, decontamination, lm_scoring, near_dedup, secrets, sharding, toxicity, url_filter

QUERIES = {
    "op1_extendible_sharding": sharding.query,
    "op2_benchmark_decontamination": decontamination.query,
    "op3_lm_scoring": lm_scoring.query,
    "op4_toxicity_chain": toxicity.query,
    "op5_hnsw_search": ann.query,
    "op6_near_duplicates": near_dedup.query,
    "op7_url_filter": url_filter.query,
    "op8_chat_format": chat.query,
    "op9_secret_scan": secrets.query,
    "op10_bpe": bpe.query,
}

SQL = {
    "op1_extendible_sharding": sharding.SQL,
    "op2_benchmark_decontamination": decontamination.SQL,
    "op8_chat_format": chat.SQL,
}
