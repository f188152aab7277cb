"""The queries of this subpackage by name: one for each operator, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelflow.llm import chat, embedding_dedup, jaccard_join, merkle, quality_rules, queries, substring_dedup

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_language_id": queries.op1_language_id,
    "op2_substring_dedup": queries.op2_substring_dedup,
    "op3_mixing": queries.op3_mixing,
    "op4_quality_rules": queries.op4_quality_rules,
    "op5_quality_classifier": queries.op5_quality_classifier,
    "op6_sharding": queries.op6_sharding,
    "op7_byte_bpe": queries.op7_byte_bpe,
    "op8_jaccard_join": queries.op8_jaccard_join,
    "op9_chat_formatting": queries.op9_chat_formatting,
    "op10_embedding_dedup": queries.op10_embedding_dedup,
    "op11_periodic_runs": queries.op11_periodic_runs,
    "op12_merkle_manifest": queries.op12_merkle_manifest,
    "op13_language_model": queries.op13_language_model,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op8_jaccard_join": jaccard_join.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
