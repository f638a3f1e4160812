"""Registered queries: a Spark plan and, where SQL has it, the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.plans.panels import bars_sql, shaped, shaped_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(spec: str, sql: str | None = None, base: str | None = None, recursive: bool = False):
    """Register a function as a query with the columns of ``spec``.

    ``sql`` gives the table ``out`` as common table expressions after
    ``base`` (weekly bars unless it is given).
    """

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: shaped(f(spark, sf_dir), spec)
        if sql is not None:
            first = bars_sql() if base is None else base
            ORACLE[f.__name__] = f"with {'recursive ' if recursive else ''}{first + ',' if first else ''}\n{sql}\n{shaped_sql(spec)}"
        return f

    return add
