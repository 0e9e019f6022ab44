"""All queries of the core by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitewright.plans import interval_queries, score_queries, site_queries

_MODULES = (interval_queries, site_queries, score_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.SQL.items()}


def flagship(spark: SparkSession, directory: str) -> DataFrame:
    return site_queries.result_table(spark, directory)
