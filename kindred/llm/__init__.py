"""Operators for training-data pipelines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import decontaminate, exact_dedup, language_id, license_scan, line_dedup, ngram_join, packing, suffix_dedup, url_filter, window_dedup

    return {
        "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
        "op2_language_id": language_id.op2_language_id,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
        "op6_substring_dedup": window_dedup.op6_substring_dedup,
        "op7_ngram_jaccard_join": ngram_join.op7_ngram_jaccard_join,
        "op8_url_filters": url_filter.op8_url_filters,
        "op9_packing": packing.op9_packing,
        "op10_license_scan": license_scan.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    from . import exact_dedup, line_dedup

    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op4_line_dedup": line_dedup.OP4_SQL}
