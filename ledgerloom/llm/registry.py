"""The queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import (
    exact_dedup,
    fill_in_middle,
    filter_audit,
    language_model,
    licenses,
    near_dedup,
    packing,
    pieces,
    quality,
    substring_dedup,
    token_counts,
    toxicity,
    vector_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pieces": pieces.op1_pieces,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_packing": packing.op6_packing,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_quality": quality.op8_quality,
    "op9_vector_dedup": vector_dedup.op9_vector_dedup,
    "op10_language_model": language_model.op10_language_model,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op7_license_scan": licenses.SQL,
    "op9_vector_dedup": vector_dedup.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_substring_dedup": substring_dedup.SQL,
}
