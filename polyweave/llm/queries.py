"""Queries that apply each operator to its whole table, and their DuckDB counterparts."""

from __future__ import annotations

from polyweave.llm import (
    embedding_dedup,
    language_id,
    license_scan,
    line_dedup,
    media,
    ngram_jaccard,
    packing,
    quality,
    source_mixing,
    substring_dedup,
)

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_substring_dedup": substring_dedup.query,
    "op3_line_dedup": line_dedup.query,
    "op4_language_id": language_id.query,
    "op5_packing": packing.query,
    "op6_embedding_near_dedup": embedding_dedup.query,
    "op7_ngram_jaccard_join": ngram_jaccard.query,
    "op8_source_mixing": source_mixing.query,
    "op9_quality_classifier": quality.query,
    "op10_media_columns": media.query,
    "page_sequences": media.pages_query,
}

ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op6_embedding_near_dedup": embedding_dedup.ORACLE,
    "op7_ngram_jaccard_join": ngram_jaccard.ORACLE,
}
