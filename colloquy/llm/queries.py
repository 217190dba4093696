"""The queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, exact_dedup, merkle, mixing, near_dedup, packing, pii, quality_model, quality_rules, repeats, token_shards, url_filter, vector_codes

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_token_shards": token_shards.op2_token_shards,
        "op3_pii": pii.op3_pii,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality_model": quality_model.op7_quality_model,
        "op8_repeats": repeats.op8_repeats,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_chat_format": chat_format.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality_rules.ORACLE_SQL,
        "op10_exact_dedup": exact_dedup.ORACLE_SQL,
        "op11_merkle_manifest": merkle.ORACLE_SQL,
        "op12_vector_codes": vector_codes.ORACLE_SQL,
        "op13_chat_format": chat_format.ORACLE_SQL,
    }
