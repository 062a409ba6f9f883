"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, line_dedup, mixing, near_dup, quality_svm, secret_scan, suffix_tree, target_ratio, token_pack

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_token_pack": token_pack.op2_token_pack,
    "op3_quality_svm": quality_svm.op3_quality_svm,
    "op4_suffix_tree": suffix_tree.op4_suffix_tree,
    "op5_target_ratio": target_ratio.op5_target_ratio,
    "op6_mixing": mixing.op6_mixing,
    "op7_language_id": language_id.op7_language_id,
    "op8_secret_scan": secret_scan.op8_secret_scan,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_near_dup": near_dup.op10_near_dup,
}
ORACLES: dict[str, str] = {}
