"""Two small corpora whose right outcome is known: stale texts that resemble the question most, and a word of two senses.

Vectors are topics of 16 numbers with a fixed small disturbance; ids are strings.
"""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import DataFrame, SparkSession

DIM = 16


def _unit(v: list[float]) -> list[float]:
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v]


def _disturbed(v: list[float], seed: int, size: float) -> list[float]:
    return _unit([x + size * math.sin(12.9898 * (seed + 1) * (i + 1)) for i, x in enumerate(v)])


_LEFT, _RIGHT = _unit([1.0] * 8 + [0.0] * 8), _unit([0.0] * 8 + [1.0] * 8)


def _frames(spark: SparkSession, query: list[float], docs: list[tuple]) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([("q", query)], "query_id string, q array<double>"), spark.createDataFrame(docs, "doc_id string, e array<double>, time_days double")


def temporal(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(queries, corpus): six yearly versions of one rule, the older ones a little nearer to the question, and two other texts."""
    docs = []
    for n, year in enumerate((2018, 2019, 2020, 2021, 2022, 2024)):
        nearer = _unit([x * 1.08 for x in _LEFT]) if year < 2021 else _LEFT
        docs.append((f"rule_{year}", _disturbed(nearer, n, 0.01 if year < 2021 else 0.02), float(date(year, 6, 1).toordinal())))
    docs += [("other_a", _disturbed(_RIGHT, 6, 0.02), float(date(2024, 1, 1).toordinal())), ("other_b", _disturbed(_RIGHT, 7, 0.03), float(date(2023, 5, 1).toordinal()))]
    return _frames(spark, _disturbed(_LEFT, 8, 0.01), docs)


def alias(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(queries, corpus): four undated texts of each of two senses; the question lies between them, a little nearer to the first."""
    docs = [(f"{name}_{i}", _disturbed(axis, i + 4 * s, 0.03), None) for s, (name, axis) in enumerate((("first", _LEFT), ("second", _RIGHT))) for i in range(4)]
    return _frames(spark, _unit([0.52 * a + 0.48 * b for a, b in zip(_LEFT, _RIGHT, strict=True)]), docs)
