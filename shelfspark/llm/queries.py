"""Registered queries of the numbered operators, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import (bpe, decontam, divergence, exact_dedup, jaccard, langid, lexical_search, line_dedup, lm_score, quality, secret_scan,
                            substring_dedup, url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontam.op1_decontamination,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_quality_resampling": quality.op3_quality_resampling,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_language_id": langid.op7_language_id,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_lm_score": lm_score.op13_lm_score,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
