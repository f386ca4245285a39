"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm import decontamination, fingerprints, hard_negatives, language_id, mixing, near_dedup, oracles, quality, suffix_dedup, token_counts, token_files, toxicity, url_filters, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_fingerprints": fingerprints.query,
    "op3_token_counts": token_counts.query,
    "op4_language_id": language_id.query,
    "op5_url_filters": url_filters.query,
    "op6_toxicity": toxicity.query,
    "op7_mixing": mixing.query,
    "op8_decontamination": decontamination.query,
    "op9_quality": quality.query,
    "op10_near_dedup": near_dedup.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_vector_codes": vector_codes.query,
    "op13_token_files": token_files.query,
}

SQL: dict[str, str] = {"op1_suffix_dedup": oracles.OP1, "op8_decontamination": oracles.OP8, "op10_near_dedup": oracles.OP10, "op11_hard_negatives": oracles.OP11, "op12_vector_codes": oracles.OP12}
