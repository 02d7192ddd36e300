"""Exact top-k search and score fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.functions import vectors as V
from vecmill.session import prepare

BLOCK, Q_BLOCK, PAIRS = 4096, 256, 16_384
#: A query matrix up to this many numbers (32 MB) is shipped to the tasks; a larger one is dealt in blocks.
SHIPPED_NUMBERS = 4_000_000
NOISE_SIM, QUERY_SIM = 0.40, 0.50


def top_k(scored: DataFrame, keys: list[str], score: str, tie: str, k: int, rank: str = "rk") -> DataFrame:
    """The k best rows of each key, ranked from 1; ties go to the smaller value of `tie`."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_last())
    return scored.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed from the first component to the last as the column expressions do."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _scored(q_ids: pa.Array, q: np.ndarray, d_ids: pa.Array, d: np.ndarray, k: int, cosine: bool = False) -> Iterator[pa.RecordBatch]:
    """The k best of each block of rows for each query; ids may be of any type that has an order.

    Products are made for Q_BLOCK queries and BLOCK rows at a time, whatever the number of either.  Rows that rounding may
    have kept from a place are scored anew, in the order of the expressions.
    """
    order = np.empty(len(d_ids), np.int64)
    order[pa.compute.sort_indices(d_ids).to_numpy()] = np.arange(len(d_ids))
    q_long, d_long = np.sqrt(_sums(q, q)), np.sqrt(_sums(d, d))
    for at in range(0, len(d), BLOCK):
        places, x, x_long = order[at : at + BLOCK], d[at : at + BLOCK], d_long[at : at + BLOCK]
        for first in range(0, len(q), Q_BLOCK):
            asked, long = q[first : first + Q_BLOCK], q_long[first : first + Q_BLOCK]
            with np.errstate(invalid="ignore", over="ignore"):
                scores = asked @ x.T
                if cosine:
                    scores /= long[:, None] * x_long[None, :] + 1e-12
                slack = 1e-9 if cosine else 1e-9 * np.maximum(1, long * x_long.max(initial=0))[:, None]
                bound = np.partition(scores, -k, axis=1)[:, -k, None] if len(x) > k else np.full((len(asked), 1), -np.inf)
                row, place = np.nonzero(~(scores < bound - slack))  # what is not a number is the largest, as in Spark
                sims = np.empty(len(row))
                for part in range(0, len(row), PAIRS):
                    i, j = row[part : part + PAIRS], place[part : part + PAIRS]
                    sims[part : part + PAIRS] = _sums(asked[i], x[j])
                    if cosine:
                        sims[part : part + PAIRS] /= long[i] * x_long[j] + 1e-12
            best = np.lexsort((places[place], -np.where(np.isnan(sims), np.inf, sims), row))
            start = np.searchsorted(row, np.arange(len(asked)))  # row ascends, before and after the sort
            best = best[np.arange(len(best)) - start[row] < k]
            yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(first + row[best], pa.int64())), d_ids.take(pa.array(at + place[best], pa.int64())), pa.array(sims[best], pa.float64())], names=["query_id", "doc_id", "sim"])


def _rows(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1)


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def exact_search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Top k by inner product: (query_id, doc_id, sim, rk). queries: (query_id, q); corpus: (doc_id, e), array<double>."""
    return top_k(block_search(queries, corpus, k), ["query_id"], "sim", "doc_id", k)


def block_search(queries: DataFrame, corpus: DataFrame, k: int, cosine: bool = False) -> DataFrame:
    """(query_id, doc_id, sim) of at least the k best by inner product, or by cosine, of each query.

    Blocks of the corpus are multiplied with the queries where they lie and give k rows for each query; only these
    are shuffled.  If there are too many queries to ship, blocks of queries meet blocks of the corpus instead.
    """
    spark = prepare(queries.sparkSession)
    asked = queries.select("query_id", "q").where("query_id is not null and q is not null")
    held = corpus.select("doc_id", "e").where("doc_id is not null and e is not null")
    schema = f"query_id {_type(asked, 'query_id')}, doc_id {_type(held, 'doc_id')}, sim double"
    few = asked.limit(SHIPPED_NUMBERS + 1).toArrow() if _surely_few(asked) else None
    size = (few.num_rows, max((len(v) for v in few["q"][:1]), default=0)) if few else tuple(asked.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first())
    if size[0] * size[1] <= SHIPPED_NUMBERS:
        rows = (few if few is not None else asked.toArrow()).combine_chunks()
        ids = rows["query_id"].combine_chunks() if rows.num_rows else None
        matrix = spark.sparkContext.broadcast((ids, _rows(rows["q"].combine_chunks()) if rows.num_rows else None))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q = matrix.value
            for batch in batches:
                if batch.num_rows and q_ids is not None:
                    yield from _scored(q_ids, q, batch.column(0), _rows(batch.column(1)), k, cosine)

        return held.mapInArrow(run, schema)
    else:
        q_blocks = -(-size[0] // 1024)
        d_blocks = max(1, -(-held.count() // (16 * BLOCK)))
        left, right = in_blocks(asked, "query_id", "qb", q_blocks, "db", d_blocks), in_blocks(held, "doc_id", "db", d_blocks, "qb", q_blocks)

        def meet(a: pa.Table, b: pa.Table) -> pa.Table:
            a, b = a.combine_chunks(), b.combine_chunks()
            if not a.num_rows or not b.num_rows:
                return pa.table({"query_id": a["query_id"].slice(0, 0), "doc_id": b["doc_id"].slice(0, 0), "sim": pa.array([], pa.float64())})
            return pa.Table.from_batches(_scored(a["query_id"].combine_chunks(), _rows(a["q"].combine_chunks()), b["doc_id"].combine_chunks(), _rows(b["e"].combine_chunks()), k, cosine))

        return left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInArrow(meet, schema)


def fused_search(asked: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Top k by a score that fuses similarity with recency and penalties: (query_id, doc_id, sim, score, rk).

    asked: (query_id, q, lam, t_star, sigma, soft_ids, eta_soft); corpus: (doc_id, e, time_days).  Blocks are multiplied as
    in `exact_search`; each leaves the rows that may be among the k best, whose scores are then worked out as expressions.
    If there are too many queries to ship, every row of the corpus is scored by the expressions alone.
    """
    asked = asked.select("query_id", "q", "lam", "t_star", "sigma", "soft_ids", "eta_soft")
    n, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("q") + F.size("soft_ids")), F.lit(0))).first()

    def scored(rows: DataFrame) -> DataFrame:
        rec = S.recency(F.col("time_days"), F.col("t_star"), F.col("sigma"))
        penalty = negative_penalty(F.col("doc_id"), F.slice("soft_ids", 1, 0), F.col("soft_ids"), F.lit(0.0), F.col("eta_soft"))
        return rows.select("query_id", "doc_id", "sim", S.steady(fused(F.col("sim"), rec, F.col("lam"), penalty), 9).alias("score"))

    if numbers > SHIPPED_NUMBERS:
        rows = meeting(asked, corpus).withColumn("sim", V.dot(F.col("q"), F.col("e")))
        return top_k(scored(rows), ["query_id"], "score", "doc_id", k)
    held = asked.toArrow().combine_chunks()
    kind = _type(corpus, "doc_id")
    facts = {c: held[c].to_numpy() for c in ("lam", "t_star", "sigma", "eta_soft")} | {"q": _rows(held["q"].combine_chunks()) if n else None}
    soft = held["soft_ids"].combine_chunks() if n else pa.array([], pa.list_(pa.int64()))
    of = np.repeat(np.arange(n), np.diff(soft.offsets.to_numpy()) if n else [])
    known = soft.flatten().unique()
    code = pa.compute.index_in(soft.flatten(), value_set=known).to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    ids = held["query_id"].combine_chunks() if n else None
    shared = prepare(asked.sparkSession).sparkContext.broadcast((ids, facts, known, code[order], of[order].astype(int)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, f, negatives, codes, of_query = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows if q_ids is not None else 0, BLOCK):
                batch = whole.slice(at, BLOCK)
                x, days = _rows(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                place = pa.compute.fill_null(pa.compute.index_in(batch.column(0), value_set=negatives), -1).to_numpy(zero_copy_only=False)
                rows = np.flatnonzero(place >= 0)
                first, last = np.searchsorted(codes, place[rows]), np.searchsorted(codes, place[rows], "right")
                of, soft_row = of_query[np.arange((last - first).sum()) + np.repeat(first - np.cumsum(last - first) + (last - first), last - first)], np.repeat(rows, last - first)
                by_query = np.argsort(of, kind="stable")
                of, soft_row = of[by_query], soft_row[by_query]
                for start in range(0, len(q_ids), Q_BLOCK):  # whatever the number of queries, few products at a time
                    some = slice(start, start + Q_BLOCK)
                    sims, lam = f["q"][some] @ x.T, f["lam"][some, None]
                    with np.errstate(invalid="ignore"):
                        rec = np.exp(-np.maximum(0, f["t_star"][some, None] - days) / np.maximum(f["sigma"][some, None], S.EPS))
                    scores = (1 - lam) * sims + lam * np.nan_to_num(rec)
                    own = slice(*np.searchsorted(of, (start, start + Q_BLOCK)))
                    scores[of[own] - start, soft_row[own]] -= f["eta_soft"][of[own]]
                    bound = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
                    query, row = np.nonzero(scores >= bound[:, None] - 1e-8)
                    yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(start + query)), batch.column(0).take(pa.array(row)), pa.array(sims[query, row]), batch.column(2).take(pa.array(row))], names=["query_id", "doc_id", "sim", "time_days"])

    found = corpus.select("doc_id", "e", F.col("time_days").cast("double")).mapInArrow(run, f"query_id {_type(asked, 'query_id')}, doc_id {kind}, sim double, time_days double")
    return top_k(scored(found.join(F.broadcast(asked.drop("q")), "query_id")), ["query_id"], "score", "doc_id", k)


def _surely_few(rows: DataFrame, most_bytes: int = 8 << 20) -> bool:
    """Whether the optimizer's own estimate of the size says that the rows fit on one machine."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most_bytes


def in_blocks(rows: DataFrame, key: str, own: str, blocks: int, other: str, other_blocks: int) -> DataFrame:
    """rows in blocks by a hash of the key, once for each block of the other side, so that every two blocks meet once."""
    dealt = rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))))


def row_bytes(rows: DataFrame) -> Column:
    """About how many bytes a row takes: 8 for a number, those of strings, and what arrays hold of either."""
    out = F.lit(8 * len(rows.columns))
    for f in rows.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith("array<"):
            text = F.aggregate(c, F.lit(0), lambda a, x: a + F.coalesce(F.octet_length(x), F.lit(0)) + 8)
            out = out + F.coalesce(text if kind == "array<string>" else 8 * F.greatest(F.size(c), F.lit(0)), F.lit(0))
    return out


def meeting(asked: DataFrame, corpus: DataFrame, few_bytes: int = 32 << 20, block_bytes: int = 8 << 20) -> DataFrame:
    """Every query beside every row of the corpus, a stated query set against all rows.

    The query side is broadcast if its rows take no more than few_bytes; else both sides are dealt in blocks by key,
    and every two blocks meet in a group of bounded size.
    """
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(row_bytes(asked)), F.lit(0))).first()
    if n * width <= few_bytes:
        return corpus.join(F.broadcast(asked), F.lit(True))
    q_blocks = -(-n * width // block_bytes)
    rows, numbers = corpus.agg(F.count("*"), F.coalesce(F.max(F.size("e")), F.lit(0))).first()
    d_blocks = max(1, -(-rows * (8 * numbers + 64) // block_bytes))
    left = in_blocks(asked, "query_id", "__qb", q_blocks, "__db", d_blocks)
    return in_blocks(corpus, "doc_id", "__db", d_blocks, "__qb", q_blocks).join(left, ["__qb", "__db"]).drop("__qb", "__db")


def search_expression(queries: DataFrame, corpus: DataFrame, k: int, score: Callable[[Column, Column], Column] = V.dot, few_bytes: int = 32 << 20) -> DataFrame:
    """Top k by any score of (q, e), as the expression gives it, for rows that may have odd vectors.

    For `V.dot` and `V.cosine` blocks are multiplied as in `exact_search`, whose sums are those of the expression.  Rows
    without an id or a vector, with nulls in it or of another length meet all others under the expression, and so does every
    row for any other score; see `meeting` for how the sides meet.
    """
    queries, corpus = queries.select("query_id", "q"), corpus.select("doc_id", "e")
    scored = lambda pairs: pairs.select("query_id", "doc_id", score(F.col("q"), F.col("e")).alias("sim"))
    if score not in (V.dot, V.cosine):
        return top_k(scored(meeting(queries, corpus, few_bytes)), ["query_id"], "sim", "doc_id", k)
    dim = queries.agg(F.coalesce(F.max(F.size("q")), F.lit(-1))).first()[0]
    plain = lambda id_, v: F.coalesce(F.col(id_).isNotNull() & (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim), F.lit(False)) & F.lit(dim > 0)
    q_plain, d_plain = plain("query_id", "q"), plain("doc_id", "e")
    found = block_search(queries.where(q_plain), corpus.where(d_plain), k, score is V.cosine)
    odd = queries.where(~q_plain)
    if not odd.isEmpty():
        found = found.unionByName(scored(meeting(odd, corpus, few_bytes)))
    odd = corpus.where(~d_plain)
    if not odd.isEmpty():
        found = found.unionByName(scored(meeting(queries.where(q_plain), odd, few_bytes)))
    return top_k(found, ["query_id"], "sim", "doc_id", k)


def slate_similarity(s0: Column, sq: Column, sv: Column, mu: Column, omega: Column, gamma: Column) -> Column:
    """Similarity of a document under the state of a question.

    s0, sq: with the original and the present query; sv: with the slot vector (null: none); mu: with the noise mean.
    """
    base = F.when(sv.isNotNull() & (omega > 0), F.greatest(s0, omega * sv)).otherwise(sq)
    noisy = mu.isNotNull() & (gamma > 0) & (mu > NOISE_SIM) & (s0 < QUERY_SIM)
    return base - F.when(noisy, gamma * mu).otherwise(F.lit(0.0))


def fused(sim: Column, rec: Column, lam: Column, penalty: Column, bonus: Column | float = 0.0, filtered: Column | float = 0.0) -> Column:
    """(1 - lambda) sim + lambda rec - penalty + bonus - filtered."""
    as_col = lambda x: F.lit(float(x)) if isinstance(x, float) else x
    return (F.lit(1.0) - lam) * sim + lam * rec - penalty + as_col(bonus) - as_col(filtered)


def negative_penalty(doc_id: Column, hard: Column, soft: Column, eta_hard: Column, eta_soft: Column) -> Column:
    """Hard negatives outweigh soft ones."""
    in_ = lambda ids: F.coalesce(F.array_contains(ids, doc_id), F.lit(False))
    return F.when(in_(hard), F.when(eta_hard > 0, eta_hard).otherwise(F.lit(0.5))).when(in_(soft), eta_soft).otherwise(F.lit(0.0))


def filter_penalty(active: Column, eta: Column, dropped: Column, require_bind: Column, bound: Column) -> Column:
    hit = dropped | (require_bind & ~bound)
    return F.when(active & (eta > 0) & hit, eta).otherwise(F.lit(0.0))


def first_per_session(hits: DataFrame, limit: int | None = None) -> DataFrame:
    """Best hit of each session, in the order of the hits, ranked anew."""
    w = Window.partitionBy("query_id", "session_id").orderBy("rk")
    first = hits.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    again = first.withColumn("session_rk", F.row_number().over(Window.partitionBy("query_id").orderBy("rk")))
    return again if limit is None else again.where(F.col("session_rk") <= limit)


def recency_of(hits: DataFrame) -> DataFrame:
    """hits with rec: age against the newest dated hit of the query, scale the spread of dates, at least 30 days."""
    w = Window.partitionBy("query_id")
    scale = F.greatest(F.stddev_pop("time_days").over(w), F.lit(30.0))
    return hits.withColumn("rec", S.recency(F.col("time_days"), F.max("time_days").over(w), scale))
