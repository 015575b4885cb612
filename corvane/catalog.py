"""All queries of the engine with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.plans import code_queries, commit_queries, search, search_queries, state_queries, target_queries, view_queries  # noqa: F401  they register their queries
from corvane.query import registry


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_documents(spark, sf_dir)


def queries() -> dict:
    return dict(registry.runs)


def oracle_sql() -> dict[str, str]:
    return dict(registry.sql)
