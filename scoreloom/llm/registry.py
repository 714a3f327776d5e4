"""Queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, cotraining, decontaminate, divergence, exact_dedup, licenses, line_dedup, merkle, ngram_join, packing, quality_rules, repair, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1,
        "op2_quality_rules": quality_rules.op2,
        "op3_license_scan": licenses.op3,
        "op4_repair_token_files": repair.op4,
        "op5_line_dedup": line_dedup.op5,
        "op6_token_counts": token_counts.op6,
        "op7_chat_formatting": chat.op7,
        "op8_ngram_jaccard": ngram_join.op8,
        "op9_cotraining_quality": cotraining.op9,
        "op10_decontamination": decontaminate.op10,
        "op11_source_divergence": divergence.op11,
        "op12_merkle_manifest": merkle.op12,
        "op13_exact_dedup": exact_dedup.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_formatting": chat.ORACLE, "op11_source_divergence": divergence.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_exact_dedup": exact_dedup.ORACLE}
