"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logtide.llm import bpe, exact_dedup, line_dedup, mixing, ngram_jaccard, quality_classifier, quality_rules, secret_scan, substring_dedup, token_store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_ids": token_store.op1_token_ids,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_ngram_jaccard": ngram_jaccard.op4_ngram_jaccard,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_ngram_jaccard": ngram_jaccard.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op9_substring_dedup": substring_dedup.SQL,
    "op10_mixing": mixing.SQL,
}
