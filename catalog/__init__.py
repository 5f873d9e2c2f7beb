"""Registered queries: each runs a library operator over the given tables, most with an ANSI-SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def load() -> None:
    from catalog import (  # noqa: F401
        duplicates, ensembles, evaluation, feature_families, flagship, learning, mining, quality, selection, statistics, tagging, teaching, texts,
    )
