"""Registration of queries and of the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import table, with_views
from .operators.workers import bounded

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(*tables: str, sql: str | None = None) -> Callable:
    """Registers f(table, ...) under its name; sql gives the same rows in DuckDB."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[table(bounded(spark), sf_dir, t) for t in tables])
        if sql:
            ORACLE[f.__name__] = re.sub(r"\b(\w) -> ", r"lambda \1: ", with_views(sql))
        return f

    return register
