"""Approximate nearest neighbours by inner product (operator 7).

Method. Hash-prefix forest: in each of `trees` trees a vector has a string of 30 sign bits of random projections, and a
tree is the sorted array of these strings.  A query descends to the place of its own string and first looks, in each tree, at
its neighbours there, which share the longest prefixes with it; the k-th best score among them tells how near the sought
vectors are at least.  From there all its trees ascend together, bit by bit, until a vector as near as that shares the
prefix in some tree with probability `recall`; the last bit is given up tree by tree.  Whatever shares the prefix is
scored exactly.  Inner product becomes an angle by one further component that brings all vectors to the greatest norm.
So vectors with structure are met at long prefixes.  Vectors without any need short ones, and trees meet the same rows again:
where the prefixes of a query hold more rows together than the table, it looks at the whole of one tree instead, and
where even the neighbours would be more rows than the table, at nothing else.

Scale. Trees are dealt by the first bits of the strings, as many as make groups of `group_rows` (at most 14), or fewer
where a query needs a shorter prefix.  Only rows whose prefix some query asks for are shuffled, with their vector in its own
precision.  Tables of how many rows and queries a prefix has (at most 2^15 numbers a tree, 10 MB in all) cut large groups by
hash, so equal vectors, however many, never meet in one task.  A group returns its k best for each query.

Edge cases. Vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows without id.  Of rows with one vec_id that with the least hash of its vector counts.
With fewer than k candidates all are returned.  Ties go to the smaller vec_id.  An empty table has no result.  Other
columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from vecmill.llm.windows import mixed
from vecmill.session import prepare, scratch, table, written

BITS = 30
MOST_LEVELS = 14
NEAR = 12  # rows to either side of a query's place in each tree
HITS = "query_id long, vec_id long, score double, scored long"


def usable(vectors: DataFrame) -> DataFrame:
    """vectors: (vec_id, embedding, q). (vec_id, v, q) of those that take part, v an array of floats or doubles."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    known = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(F.size(v) > 0).where(fine)
    most = known.groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    found = known.where(F.size(v) == (most["d"] if most else 0)).select("vec_id", v.cast(kind).alias("v"), "q")
    if found.groupBy("vec_id").count().where("count > 1").isEmpty():
        return found
    return found.groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"), F.max("q").alias("q"))


def codes_of(x: np.ndarray, planes: np.ndarray, trees: int) -> np.ndarray:
    """Bit strings of each row in each tree, as numbers of BITS bits."""
    bits = (x @ planes > 0).reshape(len(x), trees, BITS)
    return (bits << np.arange(BITS - 1, -1, -1)).sum(2)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def best_of(scores: np.ndarray, ids: np.ndarray, exact: Callable, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and exact scores of the k best but the query's own; ties to smaller ids. exact: from places to scores."""
    allowed = np.flatnonzero(ids != own)
    if len(allowed) > k:
        bound = np.partition(scores[allowed], len(allowed) - k)[len(allowed) - k]
        allowed = allowed[scores[allowed] >= bound - 1e-9 * max(1.0, abs(bound))]
    s = exact(allowed)
    order = np.lexsort((ids[allowed], -s))[:k]
    return allowed[order], s[order]


def depths_for(cosine: np.ndarray, trees: int, recall: float) -> np.ndarray:
    """For each query the depth in each tree at which a vector of that cosine is met with probability `recall`.

    0 in the first tree and BITS + 1 (no look) in the others where all rows have to be looked at.
    """
    meets = np.clip(1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi, 1e-6, 1 - 1e-9)
    out = np.empty((len(cosine), trees), np.int32)
    for i, p in enumerate(meets):
        if not np.isfinite(p):
            depth, deeper = 0, 0
        else:
            depth = int(np.clip(np.floor(np.log(1 - (1 - recall) ** (1 / trees)) / np.log(p)), 0, BITS))
            miss, miss_deeper = np.log1p(-p**depth) if depth else -np.inf, np.log1p(-(p ** (depth + 1)))
            # so many trees may stay one bit deeper
            deeper = 0 if depth in (0, BITS) else int(np.clip((np.log(1 - recall) - trees * miss) / (miss_deeper - miss), 0, trees))
        out[i] = [0] + [BITS + 1] * (trees - 1) if depth == 0 else [depth + 1] * deeper + [depth] * (trees - deeper)
    return out


def held_by(rows: list[np.ndarray], probes: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """How many rows share each query's prefixes, over all trees; rows[x][t] has how many have each prefix of x bits in tree t.
    Prefixes longer than those are taken to share evenly what the longest of them hold."""
    out = np.zeros(len(probes))
    trees = np.arange(probes.shape[1])
    for x in np.unique(depths[depths <= BITS]).tolist():
        level = min(x, len(rows) - 1)
        at = rows[level][trees, np.maximum(probes, 0) >> (BITS - level)] / 2.0 ** (x - level)
        out += np.where(depths == x, at, 0).sum(1)
    return out


def _near(q: np.ndarray, own: np.ndarray, probe: np.ndarray, depth: np.ndarray, code: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple]:
    """Neighbours of the query's place in the sorted array."""
    at = np.searchsorted(code, probe)
    for i, p in enumerate(at.tolist()):
        begin, end = max(0, p - NEAR), min(len(code), p + NEAR)
        some = begin + np.flatnonzero(ids[begin:end] != own[i])
        yield own[i], ids[some], (x[some] * q[i]).sum(1), end - begin


def _sharing(q: np.ndarray, own: np.ndarray, probe: np.ndarray, depth: np.ndarray, code: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple]:
    """The k best of the rows that share each query's prefix."""
    prefix = probe >> (BITS - depth)
    for d, p in np.unique(np.stack([depth, prefix], 1), axis=0):
        begin, end = np.searchsorted(code, [p << (BITS - d), (p + 1) << (BITS - d)])
        if begin == end:
            continue
        some = np.flatnonzero((depth == d) & (prefix == p))
        for at in range(0, len(some), 256):
            part = some[at : at + 256]
            for i, row in zip(part, q[part] @ x[begin:end].T, strict=True):
                place, s = best_of(row, ids[begin:end], lambda c, i=i: (x[begin + c] * q[i]).sum(1), own[i], k)
                yield own[i], ids[begin:end][place], s, end - begin


class Forest:
    """The rows with their strings, and how many rows each prefix has."""

    def __init__(self, coded: DataFrame, trees: int, levels: int, group_rows: int, group_queries: int):
        self.coded, self.trees, self.levels, self.group_rows, self.group_queries = coded, trees, levels, group_rows, group_queries
        counted = coded.select(F.posexplode("codes").alias("tree", "code")).groupBy("tree", F.shiftright("code", BITS - MOST_LEVELS).alias("p")).count().toArrow()  # trees * 2^MOST_LEVELS rows at most
        rows = np.zeros((trees, 1 << MOST_LEVELS), np.int64)
        rows[counted["tree"].to_numpy(), counted["p"].to_numpy()] = counted["count"].to_numpy()
        self.rows = [rows.reshape(trees, 1 << x, -1).sum(2) for x in range(MOST_LEVELS + 1)]

    def hits(self, asked: DataFrame, look: Callable, k: int) -> DataFrame:
        """asked: (query_id, v, probes, depths). What `look` finds in each group, as HITS."""
        trees, levels, kind = self.trees, self.levels, asked.schema["v"].dataType.simpleString()
        level = F.least("depth", F.lit(levels))
        each = asked.select(F.posexplode(F.arrays_zip("probes", "depths")).alias("tree", "at")).select("tree", F.col("at.probes").alias("probe"), F.col("at.depths").alias("depth")).where(F.col("depth") <= BITS)
        asks = each.groupBy(level.alias("level"), "tree", F.expr(f"shiftright(probe, {BITS} - least(depth, {levels}))").alias("p")).count().toArrow()  # trees * 2^(levels + 1) rows at most
        cuts = [np.zeros((trees, 1 << x), np.int32) for x in range(levels + 1)]
        query_cuts = [np.zeros((trees, 1 << x), np.int32) for x in range(levels + 1)]
        for x, t, p, n in zip(*(asks[c].to_numpy().tolist() for c in ("level", "tree", "p", "count")), strict=True):
            cuts[x][t, p], query_cuts[x][t, p] = -(-self.rows[x][t, p] // self.group_rows), -(-n // self.group_queries)
        used = [x for x in range(levels + 1) if cuts[x].any()]
        shared = asked.sparkSession.sparkContext.broadcast((cuts, query_cuts))

        def dealt(ids: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Rows once for each cut of the other side: (row, own cut, other cut)."""
            row = np.repeat(np.arange(len(ids)), theirs)
            other = np.arange(len(row)) - np.repeat(np.cumsum(theirs) - theirs, theirs)
            return row, (mixed(ids.astype(np.uint64)) % np.maximum(mine, 1).astype(np.uint64)).astype(np.int32)[row], other.astype(np.int32)

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts_, query_cuts_ = shared.value
            for batch in batches:
                ids = batch.column(0).to_numpy()
                codes = _matrix(batch.column(2)).astype(np.int64) if batch.num_rows else np.empty((0, trees), np.int64)
                for x in used:
                    for t in range(trees):
                        p = codes[:, t] >> (BITS - x)
                        row, cut, qcut = dealt(ids, cuts_[x][t, p], np.where(cuts_[x][t, p] > 0, query_cuts_[x][t, p], 0))
                        if len(row):
                            ints = [pa.array(c.astype(np.int32)) for c in (np.full(len(row), x), np.full(len(row), t), p[row], cut, qcut, codes[row, t])]
                            yield pa.RecordBatch.from_arrays([*ints, *(batch.column(i).take(pa.array(row)) for i in (0, 1))], names=["level", "tree", "p", "cut", "qcut", "code", "vec_id", "v"])

        def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts_, query_cuts_ = shared.value
            for batch in batches:
                ids = batch.column(0).to_numpy()
                if not batch.num_rows:
                    continue
                probe, depth = _matrix(batch.column(2)).astype(np.int64), _matrix(batch.column(3))
                for t in range(trees):
                    for x in used:
                        some = np.flatnonzero((np.minimum(depth[:, t], levels) == x) & (depth[:, t] <= BITS))
                        p = probe[some, t] >> (BITS - x)
                        row, qcut, cut = dealt(ids[some], query_cuts_[x][t, p], cuts_[x][t, p])
                        if len(row):
                            at = some[row]
                            ints = [pa.array(c.astype(np.int32)) for c in (np.full(len(row), x), np.full(len(row), t), p[row], cut, qcut, probe[at, t], depth[at, t])]
                            yield pa.RecordBatch.from_arrays([*ints, *(batch.column(i).take(pa.array(at)) for i in (0, 1))], names=["level", "tree", "p", "cut", "qcut", "probe", "depth", "query_id", "v"])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                own, probe, depth = (left[c].to_numpy() for c in ("query_id", "probe", "depth"))
                code, ids = right["code"].to_numpy(), right["vec_id"].to_numpy()
                order = np.lexsort((ids, code))
                out = list(look(_matrix(left["v"]).astype(float), own, probe.astype(np.int64), depth, code[order].astype(np.int64), ids[order], _matrix(right["v"])[order].astype(float), k))
            sizes = [len(o[1]) for o in out]
            cat = lambda i, kind_: np.concatenate([o[i] for o in out]) if out else np.empty(0, kind_)
            scored = np.zeros(sum(sizes), np.int64)
            first = np.cumsum([0, *sizes])[:-1]
            for o, at, n in zip(out, first, sizes, strict=True):
                if n:
                    scored[at] = o[3]  # once for each look of a query
            return pa.table({"query_id": pa.array(np.repeat([o[0] for o in out], sizes).astype(np.int64)), "vec_id": pa.array(cat(1, np.int64)), "score": pa.array(cat(2, float)), "scored": pa.array(scored)})

        keys = ["level", "tree", "p", "cut", "qcut"]
        place = "level int, tree int, p int, cut int, qcut int"
        left = asked.select("query_id", "v", "probes", "depths").mapInArrow(probes, f"{place}, probe int, depth int, query_id long, v {kind}")
        right = self.coded.select("vec_id", "v", "codes").mapInArrow(index, f"{place}, code int, vec_id long, v {kind}")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, HITS)


def neighbours(vectors: DataFrame, is_query: Column, k: int = 20, trees: int = 40, recall: float = 0.95, group_rows: int = 20_000, group_queries: int = 4_000, seed: int = 7) -> DataFrame:
    """The operator: (query_id, rank, vec_id, score, n_scored) for the rows (vec_id, embedding) where is_query holds.

    n_scored: rows that were scored for the query, counted once for each tree in which it met them; about the rows of the
    table and its neighbours at most.
    """
    spark = prepare(vectors.sparkSession)
    with scratch(spark) as keep:
        found = keep(usable(vectors.select("vec_id", "embedding", F.coalesce(is_query, F.lit(False)).alias("q"))), "vectors")
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        facts = found.agg(F.max(norm).alias("top"), F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        if not facts["n"]:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, n_scored long")
        top, n, d = facts["top"], facts["n"], facts["d"]
        planes = np.random.default_rng(seed).standard_normal((d + 1, trees * BITS))
        kind = found.schema["v"].dataType.simpleString()

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    x = _matrix(batch.column(1)).astype(float) / top
                    length = np.sqrt((x * x).sum(1))[:, None]
                    asks = batch.column(2).to_numpy(zero_copy_only=False)
                    for_index = codes_of(np.hstack([x, np.sqrt(np.clip(1 - length * length, 0, None))]), planes, trees)
                    for_query = np.full((len(x), trees), -1)
                    for_query[asks] = codes_of(np.hstack([x / length, np.zeros_like(length)])[asks], planes, trees)
                    lists = [pa.array([r if r[0] >= 0 else None for r in c.astype(np.int32)], pa.list_(pa.int32())) for c in (for_index, for_query)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["vec_id", "v", "q", "codes", "probes"])

        coded = keep(found.mapInArrow(code, f"vec_id long, v {kind}, q boolean, codes array<int>, probes array<int>"), "forest")
        levels = int(np.clip(np.ceil(np.log2(2 * n / group_rows)), 1, MOST_LEVELS))
        forest = Forest(coded, trees, levels, group_rows, group_queries)
        asked = coded.where("q").select(F.col("vec_id").alias("query_id"), "v", "probes")
        everywhere = n <= trees * 2 * NEAR  # neighbours in all trees would be more rows than the table has
        deepest = F.array_repeat(F.lit(BITS + 1 if everywhere else BITS), trees)
        first = keep(forest.hits(asked.withColumn("depths", deepest), _near, k), "near")
        ranked = first.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        bound = ranked.where(F.col("r") == k).select("query_id", F.col("score").alias("bound"))
        shared = spark.sparkContext.broadcast(forest.rows)

        def ascend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    length = np.sqrt((_matrix(batch.column(1)).astype(float) ** 2).sum(1))
                    depths = depths_for(batch.column(3).to_numpy(zero_copy_only=False) / length / top, trees, recall)
                    many = held_by(shared.value, _matrix(batch.column(2)).astype(np.int64), depths) > n
                    depths[many] = [0] + [BITS + 1] * (trees - 1)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(list(depths), pa.list_(pa.int32()))], names=["query_id", "v", "probes", "depths"])

        again = keep(asked.join(bound, "query_id", "left").select("query_id", "v", "probes", "bound").mapInArrow(ascend, f"query_id long, v {kind}, probes array<int>, depths array<int>"), "asked")
        best = written(first.unionByName(forest.hits(again, _sharing, k)), "hits")
    once = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))
    w = Window.partitionBy("query_id")
    ranked = once.withColumn("n_scored", F.sum("scored").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_scored")


def op7_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 nearest found of each vec_id divisible by 20; n_scored rows were scored for it."""
    return neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
