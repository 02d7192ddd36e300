"""Searches: blocks of bounded size, whatever the number of queries, and the plan of expressions with odd vectors."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vecmill.functions import vectors as V
from vecmill.operators import search

NAN = float("nan")
ROWS = [[3.0, 4.0], [4.0, 3.0], [0.0, 0.0], None, [1.0], [1.0, None], [NAN, 1.0], [1e-9, 1e-9], [-5.0, 2.0], [4.0, 3.0], [100.0, 1.0]]


@pytest.mark.parametrize("score", [V.dot, V.cosine])
def test_plan_of_odd_vectors_multiplies_blocks(spark, score):
    corpus = spark.createDataFrame([*enumerate(ROWS), (None, [1.0, 1.0])], "doc_id long, e array<double>")
    queries = corpus.select(F.col("doc_id").alias("query_id"), F.col("e").alias("q"))
    found = search.search_expression(queries, corpus, 5, score)
    pairs = queries.crossJoin(corpus).select("query_id", "doc_id", score(F.col("q"), F.col("e")).alias("sim"))
    rows = lambda df: sorted(df.select("query_id", "doc_id", "rk", F.col("sim").cast("string")).collect(), key=str)
    assert rows(found) == rows(search.top_k(pairs, ["query_id"], "sim", "doc_id", 5))
    plain = queries.where("query_id in (0, 1, 8)"), corpus.where("doc_id in (0, 1, 2, 7, 8, 9, 10)")
    plan = search.search_expression(*plain, 5, score)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_blocks_are_bounded_for_any_number_of_queries():
    x = np.random.default_rng(1).standard_normal((6000, 8))
    ids = pa.array(range(6000))
    tracemalloc.start()
    n = sum(b.num_rows for b in search._scored(ids, x, ids, x, 3) if b.num_rows)  # 6000 by 4096 products at once are 197 MB
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
    assert n == 6000 * 3 * 2


def test_fused_search_over_several_blocks_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 4))
    corpus = spark.createDataFrame([(i, v.tolist(), float(i) if i % 3 else None) for i, v in enumerate(x)], "doc_id long, e array<double>, time_days double")
    asked = spark.createDataFrame([(i, x[i].tolist(), 0.2 * (i % 3), 20.0, 30.0, [i, (i + 7) % 40], 0.5) for i in range(9)], "query_id long, q array<double>, lam double, t_star double, sigma double, soft_ids array<long>, eta_soft double")
    rows = lambda: [(r["query_id"], r["rk"], r["doc_id"], r["score"]) for r in search.fused_search(asked, corpus, 5).orderBy("query_id", "rk").collect()]
    monkeypatch.setattr(search, "SHIPPED_NUMBERS", 0)
    plain = rows()
    monkeypatch.setattr(search, "SHIPPED_NUMBERS", 10**9)
    monkeypatch.setattr(search, "Q_BLOCK", 4)
    assert rows() == plain
