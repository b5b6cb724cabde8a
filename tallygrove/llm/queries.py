"""The queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from . import decontaminate, jaccard, lattice, merkle, mixing, prefix_trie, quality, repeats, secrets, token_store, toxicity, url_filter, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_toxicity": toxicity.query,
    "op3_secret_scans": secrets.query,
    "op4_embedding_near_dedup": lattice.query,
    "op5_token_output": token_store.query,
    "op6_url_filters": url_filter.query,
    "op7_ngram_jaccard_join": jaccard.query,
    "op8_benchmark_decontamination": decontaminate.query,
    "op9_quality_classifier": quality.query,
    "op10_mixing_sources": mixing.query,
    "op11_conversation_prefix_trie": prefix_trie.query,
    "op12_merkle_manifest": merkle.query,
    "op13_suffix_array_dedup": repeats.query,
}
ORACLE_SQL = {
    "op1_warc": warc.SQL,
    "op4_embedding_near_dedup": lattice.SQL,
    "op6_url_filters": url_filter.SQL,
    "op7_ngram_jaccard_join": jaccard.SQL,
    "op10_mixing_sources": mixing.SQL,
    "op11_conversation_prefix_trie": prefix_trie.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_suffix_array_dedup": repeats.SQL,
}
