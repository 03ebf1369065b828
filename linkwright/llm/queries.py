"""The training-data queries and their DuckDB SQL."""

from __future__ import annotations

from . import byte_bpe, embedding_dedup, html_extract, line_dedup, minhash, packing, pii, quality, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_minhash_dedup": minhash.query,
    "op3_html_extract": html_extract.query,
    "op4_quality_rules": quality.query,
    "op5_pii_surrogates": pii.query,
    "op6_best_fit_packing": packing.query,
    "op7_byte_bpe": byte_bpe.query,
    "op8_line_dedup": line_dedup.query,
    "op9_toxicity": toxicity.query,
    "op10_embedding_dedup": embedding_dedup.query,
}

ORACLES = {
    "op1_url_filter": url_filter.ORACLE,
    "op2_minhash_dedup": minhash.ORACLE,
    "op3_html_extract": html_extract.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
}
