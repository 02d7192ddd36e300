"""Weighted statistics and kernels as column expressions and window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-8


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softmax_over(x: Column, window: WindowSpec, temperature: float = 0.15) -> Column:
    """Softmax within a window; exponents are held within 40."""
    e = F.exp(clamp((x - F.max(x).over(window)) / F.lit(max(temperature, EPS)), -40, 40))
    return e / F.sum(e).over(window)


def with_softmax(rows: DataFrame, keys: list[str], x: str, name: str = "weight", temperature: float = 0.15) -> DataFrame:
    w = Window.partitionBy(*keys)
    top = rows.withColumn("__e", F.exp(clamp((F.col(x) - F.max(x).over(w)) / F.lit(max(temperature, EPS)), -40, 40)))
    return top.withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__e")


def kish(weight: Column) -> Column:
    """Effective number of rows, an aggregate; 0 without weight."""
    return F.coalesce(F.try_divide(F.pow(F.sum(weight), 2), F.sum(weight * weight)), F.lit(0.0))


def weighted_mean(x: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(weight * x), F.sum(weight))


def weighted_spread(x: Column, weight: Column) -> Column:
    """Weighted population standard deviation, an aggregate."""
    m = F.try_divide(F.sum(weight * x), F.sum(weight))
    return F.sqrt(F.greatest(F.try_divide(F.sum(weight * x * x), F.sum(weight)) - m * m, F.lit(0.0)))


def weighted_median(rows: DataFrame, keys: list[str], x: str, weight: str, tie: str, name: str = "median") -> DataFrame:
    """The first value, in order, at which half of the weight is reached."""
    w = Window.partitionBy(*keys).orderBy(x, tie)
    reached = rows.withColumn("__c", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(Window.partitionBy(*keys)))
    return reached.where(F.col("__c") >= 0.5 - 1e-12).groupBy(*keys).agg(F.min(x).alias(name))


def recency(time_days: Column, newest: Column, scale: Column) -> Column:
    """exp(-age / scale), one-sided: nothing is lost by being newer; 0 for undated rows."""
    age = F.greatest(F.lit(0.0), newest - time_days)
    return F.when(time_days.isNull() | newest.isNull() | scale.isNull(), F.lit(0.0)).otherwise(F.exp(-age / F.greatest(scale, F.lit(EPS))))


def steady(x: Column, places: int = 6) -> Column:
    """Rounded for comparison, without negative zero."""
    return F.round(x, places) + F.lit(0.0)
