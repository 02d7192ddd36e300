"""Summaries and comparisons of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summary(rows: DataFrame, keys: list[str], by: str, values: list[str]) -> DataFrame:
    """Means per key and value of `by`, and over all of them under 'all'; nulls do not count."""
    aggs = [F.count("*").alias("n"), *[F.avg(v).alias(v) for v in values]]
    sets = rows.groupingSets([[F.col(k) for k in [*keys, by]], [F.col(k) for k in keys]], *[F.col(k) for k in [*keys, by]]).agg(*aggs)
    return sets.withColumn(by, F.coalesce(by, F.lit("all")))


def paired(a: DataFrame, b: DataFrame, key: str, by: str, value: str, tolerance: float = 1e-9, how: str = "inner") -> DataFrame:
    """How many questions of two runs got better, worse or stayed, and how their first gold hit moved.

    With how = "left" questions that the second run does not have are counted too, as absent.
    """
    d = F.col("__b") - F.col("__a")
    other = b.select(key, F.col(value).alias("__b"), F.col("gold_rank").alias("__rb"), F.lit(True).alias("__there"))
    both = a.select(key, by, F.col(value).alias("__a"), F.col("gold_rank").alias("__ra")).join(other, key, how)
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).alias
    counts = [n(d > tolerance)("better"), n(d < -tolerance)("worse"), n(F.abs(d) <= tolerance)("same"), n(F.col("__rb") < F.col("__ra"))("up"), n(F.col("__rb") > F.col("__ra"))("down")]
    return both.groupBy(by).agg(F.count("*").alias("n"), *counts, *([n(F.col("__there").isNull())("absent")] if how == "left" else []))


def adoption(log: DataFrame) -> DataFrame:
    """(slot, why, round, n) over the log of rounds."""
    return log.groupBy(F.coalesce("slot", F.lit("none")).alias("slot"), "why", "round").agg(F.count("*").alias("n"))


def remaining(instances: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return instances.join(done.select(key).distinct(), key, "left_anti")
