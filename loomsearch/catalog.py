"""All registered queries of the search engine, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows where there is one."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top documents for a batch of queries by BM25."""
    return queries()["bm25_topk"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from loomsearch.plans import behaviour_queries, page_queries, text_queries  # noqa: F401  they register themselves

    return _QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL
