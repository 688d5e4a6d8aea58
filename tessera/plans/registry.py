"""All queries of the retrieval engine with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def entries() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    from tessera.plans import corpus_queries, pattern_queries, ranking_queries, search_queries

    return corpus_queries.QUERIES | search_queries.QUERIES | ranking_queries.QUERIES | pattern_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in entries().items() if sql}
