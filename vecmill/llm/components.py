"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Each step is a minimum per vertex and a join, so no neighbourhood is ever gathered in one place; a vertex with very
many neighbours is split by the adaptive skew join and its minimum is combined before the shuffle.  Lineage is cut by
reliable checkpoints, so a lost executor costs at most one step.

A step costs the driver some six shuffles' worth of tasks however few the edges are.  Up to `few` edges, a bounded number,
are therefore merged by one task; more of them go through the steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.session import prepare, shared_dir

FEW_EDGES = 200_000


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Larger (or smaller) neighbours of each vertex are linked to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        linked = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def _merged(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}  # a lesser vertex of the same component

        def root(x):
            top = x
            while (y := above[top]) != top:
                top = y
            while x != top:
                above[x], x = top, above[x]
            return top

        type_ = None
        for batch in batches:
            type_ = batch.column(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(above.setdefault(u, u)), root(above.setdefault(v, v))
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        for at in range(0, len(nodes), 1 << 14):
            some = nodes[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array(some, type_), pa.array([root(x) for x in some], type_)], names=["node", "root"])

    prepare(edges.sparkSession)
    kind = edges.schema["u"].dataType.simpleString()
    return edges.repartition(1).mapInArrow(run, f"node {kind}, root {kind}")


def connected(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """(node, root) for every vertex of the edge table (a, b) that has an edge to another; root: the least vertex reachable."""
    shared_dir(edges.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    if now.count() <= few:
        return _merged(now)
    seen = None
    for _ in range(max_rounds):
        now = _stars(_stars(now, True), False).checkpoint()
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (mark["n"], mark["h"]) == seen:
            break
        seen = (mark["n"], mark["h"])
    else:
        raise RuntimeError("components did not converge")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
