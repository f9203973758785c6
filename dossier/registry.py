"""Queries of the library over the given tables: a function and, where SQL can express it, SQL that must agree."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bindings import Archive, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of an Archive under its name; ``sql``: the same for DuckDB, with the bindings' names."""

    def add(f: Callable[[Archive], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Archive(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_bindings(sql)
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    for name in ("relational", "analytics", "decisions", "scoring", "texts", "jobs", "live"):
        importlib.import_module(f"dossier.plans.{name}")
