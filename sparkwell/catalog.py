"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name to function) and SQL (name to DuckDB text).
MODULES: list[str] = ["operators.records", "functions.text", "operators.statistics", "operators.bootstrap", "operators.passages", "operators.intervals", "operators.retrieval", "sources.corpus", "sources.html_reader", "operators.sequences", "operators.product_search", "streaming.sessions", "streaming.utterances", "streaming.ledger", "operators.more", "operators.projections"]


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(import_module(f"sparkwell.{name}"), what)
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["ret_hybrid_search"](spark, sf_dir)
