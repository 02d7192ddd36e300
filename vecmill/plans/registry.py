"""All queries of the core package by name, each beside the SQL that DuckDB can check it with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


for module in ("retrieval", "statistics", "evaluation", "texts", "sessions", "configs", "reviews", "evolve", "experiment", "replays"):
    importlib.import_module(f"vecmill.plans.{module}")
