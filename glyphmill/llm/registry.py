"""The subpackage's queries, each over its whole table with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontamination, hard_negatives, language_id, lexical_search, line_dedup, lm_scoring, mixing, near_dedup, quality_rules, sharding, suffix_dedup, token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": lm_scoring.query,
    "op2_minhash_near_dedup": near_dedup.query,
    "op3_language_id": language_id.query,
    "op4_quality_rules": quality_rules.query,
    "op5_line_dedup": line_dedup.query,
    "op6_decontamination": decontamination.query,
    "op7_chat_formatting": chat_format.query,
    "op8_token_shards": token_shards.query,
    "op9_mixing": mixing.query,
    "op10_sharding": sharding.query,
    "op11_lexical_search": lexical_search.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_suffix_dedup": suffix_dedup.query,
}
ORACLES: dict[str, str] = {
    "op7_chat_formatting": chat_format.SQL,
    "op9_mixing": mixing.SQL,
    "op11_lexical_search": lexical_search.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
