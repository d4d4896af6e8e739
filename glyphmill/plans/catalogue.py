"""Every query of the engine by name, with DuckDB SQL that computes the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation_queries, record_queries, rule_queries, source_queries, structure_queries, table_queries, unit_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = structure_queries.QUERIES | curation_queries.QUERIES | record_queries.QUERIES | rule_queries.QUERIES | source_queries.QUERIES | table_queries.QUERIES | unit_queries.QUERIES
ORACLES: dict[str, str] = structure_queries.ORACLES | curation_queries.ORACLES | record_queries.ORACLES | rule_queries.ORACLES | source_queries.ORACLES | table_queries.ORACLES | unit_queries.ORACLES
