"""Registering a query with the inventory ids that it applies and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OPERATORS: dict[str, str] = {}


def query(operators: str, sql: str | None = None):

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        OPERATORS[run.__name__] = operators
        if sql is not None:
            ORACLE_SQL[run.__name__] = sql
        return run

    return add
