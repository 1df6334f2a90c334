"""Queries by name: a function of a corpus, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Corpus, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(corpus)`` under its name; ``sql`` names views and tables in braces."""

    def put(f: Callable[[Corpus], DataFrame]):
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: f(Corpus(spark, sf_dir))
        if sql:
            ORACLES[key] = oracle(sql)
        return f

    return put
