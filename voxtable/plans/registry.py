"""Named queries with, where it exists, the same question in DuckDB SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import corpus as _corpus
from .oracle_tables import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``fn(corpus) -> DataFrame``; ``sql`` may use the named tables of ``oracle_tables``."""
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(_corpus.corpus(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn
    return wrap
