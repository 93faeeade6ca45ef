"""All queries of the library with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.jobs import board, catalogue, code, conversations, index, keyphrases, paths, texts, vectors, workspace

MODULES = (vectors, texts, keyphrases, conversations, board, paths, code, workspace, index, catalogue)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in MODULES:
        found |= module.JOBS.queries
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in MODULES:
        found |= module.JOBS.sql
    return found
