"""Vector arithmetic as column expressions over array<double>; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once per row and not once per element of a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scaled(v: Column, factor: Column) -> Column:
    return let(factor, lambda f: F.transform(v, lambda x: x * f))


def unit(v: Column) -> Column:
    """v over its length, or over EPS if it is shorter."""
    return let(F.greatest(norm(v), F.lit(EPS)), lambda n: F.transform(v, lambda x: x / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-12))


def plus(a: Column, b: Column, factor: float = 1.0) -> Column:
    """a + factor * b; a alone where b is null."""
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + F.lit(float(factor)) * y))


def without(v: Column, axis: Column) -> Column:
    """v without its part along axis; v itself where the axis is null or next to zero."""
    return F.when(axis.isNull() | (norm(axis) < EPS), v).otherwise(let(unit(axis), lambda a: let(dot(v, a), lambda c: F.zip_with(v, a, lambda x, y: x - c * y))))


def rocchio(q0: Column, pos: Column, neg: Column, alpha: float = 1.0, beta: float = 0.75, gamma: float = 0.15) -> Column:
    """unit(alpha q0 + beta pos - gamma neg); a mean that is null adds nothing."""
    return unit(plus(plus(F.transform(q0, lambda x: x * F.lit(float(alpha))), pos, beta), neg, -gamma))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str, weight: str | None = None, name: str = "mean") -> DataFrame:
    """A (weighted) mean vector per key. Components are combined before the shuffle: dim rows per key and task."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = rows.select(*keys, w.alias("__w"), F.posexplode(vector).alias("__i", "__x"))
    sums = parts.groupBy(*keys, "__i").agg((F.sum(F.col("__w") * F.col("__x")) / F.sum("__w")).alias("__m"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias(name))


def with_composed(rows: DataFrame, name: str, q0: str, slot: str, noise: str, beta: float, gamma: float, alpha: float = 1.0) -> DataFrame:
    """rows with unit(alpha q0 + beta slot - gamma noise), of unit vectors, noise without its parts along q0 and slot.

    Nulls add nothing.  Steps are columns of their own, so that no expression is nested deeply.
    """
    c = F.col
    steps = {"__q": unit(c(q0)), "__s": F.when(c(slot).isNotNull(), unit(c(slot))), "__m": F.when(c(noise).isNotNull(), unit(c(noise)))}
    rows = rows.withColumns(steps)
    rows = rows.withColumn("__o", F.when(c("__s").isNotNull(), without(c("__s"), c("__q")))).withColumn("__r", without(c("__m"), c("__q")))
    rows = rows.withColumn("__r", without(c("__r"), c("__o")))
    rows = rows.withColumn("__x", plus(plus(F.transform("__q", lambda x: x * F.lit(float(alpha))), c("__s"), beta), c("__r"), -gamma))
    return rows.withColumn(name, unit(c("__x"))).drop("__q", "__s", "__m", "__o", "__r", "__x")


def pooled(hidden: Column, mask: Column, how: str, padding: str = "right", pooler: Column | None = None) -> Column:
    """One vector of a text's token vectors (array<array<double>>) and mask (array<int>).

    cls: the first token's; cls_pooler: the model's own; mean: of the tokens with mask 1; eos: the last token's that is
    not padding, or the very last one's where padding is on the left.
    """
    if how == "cls":
        return F.get(hidden, F.lit(0))
    if how == "cls_pooler":
        if pooler is None:
            raise ValueError("cls_pooler needs the model's own pooled vector")
        return pooler
    if how == "eos":
        at = F.size(hidden) if padding == "left" else F.aggregate(mask, F.lit(0), lambda s, m: s + m.cast("int"))
        return F.get(hidden, at - 1)
    if how != "mean":
        raise ValueError(f"unknown pooling {how}")
    masked = F.zip_with(hidden, mask, lambda v, m: F.transform(v, lambda x: x * m))
    total = F.aggregate(masked, F.array().cast("array<double>"), lambda s, v: F.when(F.size(s) == 0, v).otherwise(F.zip_with(s, v, lambda x, y: x + y)))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, m: s + m), F.lit(1e-9))
    return let(n, lambda k: F.transform(total, lambda x: x / k))
