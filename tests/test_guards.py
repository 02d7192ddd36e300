"""Documents of the loops: slots by position, rules, copied passages, and what a rollback keeps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.functions import text as T
from vecmill.operators import guards, loop, memory, sessions, slots


def test_bodies_may_hold_anything(spark):
    odd = ["$1 \\\\ \\1 ${x}", "a\n\nb  \n", "", "<b> é 漢 $"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(odd)], "i int, b string").withColumn("d", slots.rendered(F.lit(slots.DOCUMENT), {"query": F.col("b"), "rank": F.lit("r"), "filter": F.col("b")}))
    got = rows.select("i", *[T.slot_body(F.col("d"), n).alias(n) for n in T.SLOTS], (T.backbone(F.col("d")) == T.backbone(F.lit(slots.DOCUMENT))).alias("same"), "d").orderBy("i").collect()
    for r, b in zip(got, odd, strict=True):
        assert (r["QUERY"], r["RANK"], r["FILTER"], r["same"]) == (b.strip(), "r", b.strip(), True)
        head, tail = slots.DOCUMENT.split("<!-- EVOLVE:QUERY:START -->\n<!-- EVOLVE:QUERY:END -->")
        assert r["d"].startswith(f"{head}<!-- EVOLVE:QUERY:START -->\n{b.rstrip()}\n<!-- EVOLVE:QUERY:END -->")
    with pytest.raises(Exception, match="marks of slot RANK are missing"):
        spark.range(1).select(slots.rendered(F.lit("<!-- EVOLVE:RANK:END --> <!-- EVOLVE:RANK:START -->"), {"rank": F.lit("x")})).collect()


def test_rules_of_documents(spark):
    base = slots.DOCUMENT
    put = lambda d, n, b: d.replace(f"<!-- EVOLVE:{n}:START -->\n", f"<!-- EVOLVE:{n}:START -->\n{b}\n")
    cases = [
        ("query", put(base, "QUERY", "x"), None), ("query", put(put(base, "QUERY", "x"), "RANK", "y"), "another slot changed"), ("rank", put(base, "QUERY", "x"), "another slot changed"),
        ("filter", base, "the slot did not change"), ("filter", put(base, "FILTER", "x") + ".", "backbone changed"), ("rank", base.replace("<!-- EVOLVE:FILTER:START -->", ""), "a slot is missing"), ("other", put(base, "QUERY", "x"), "unknown slot"),
    ]
    rows = spark.createDataFrame([(i, s, d) for i, (s, d, _) in enumerate(cases)], "i int, slot string, d string")
    got = rows.select("i", slots.document_violation(F.col("slot"), F.lit(base), F.lit(base), F.col("d")).alias("why")).orderBy("i").collect()
    assert [r["why"] for r in got] == [w for _, _, w in cases]


@pytest.mark.parametrize("keys", [["query_id"], []])
def test_copied_passages_against_every_piece(spark, keys):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abAB \n\t") for _ in range(n))
    texts = [(i % 5, word(rng.randrange(200))) for i in range(30)] + [(0, "é" * 30), (1, None), (2, "")]
    squeeze = lambda s: "".join((s or "").split()).lower()
    documents = []
    for i in range(60):
        q = i % 6
        own = squeeze(rng.choice(texts)[1])
        at = rng.randrange(max(1, len(own)))
        documents.append((i, q, word(30) + " ".join(own[at : at + rng.randrange(20, 80)].upper()) + word(30)))
    t = spark.createDataFrame(texts, "query_id int, text string")
    d = spark.createDataFrame(documents, "id int, query_id int, document string")
    found = guards.pieces(t, keys)
    got = {r["id"] for r in guards.copied(d, found, guards.filters(found, keys), keys, ["id"]).collect()}
    want = set()
    for i, q, text in documents:
        for own, passage in texts:
            s = squeeze(passage)
            if (not keys or own == q) and any(s[a : a + 24] in squeeze(text) for a in range(0, len(s) - 23, 24)):
                want.add(i)
    assert got == want and 0 < len(want) < 60


def test_filters_grow_with_pieces(spark):
    t = spark.createDataFrame([(1, "x" * 24), (2, "".join(chr(97 + i % 26) + str(i) for i in range(60_000)))], "query_id int, text string")
    sizes = {r["query_id"]: len(r["bits"]) for r in guards.filters(guards.pieces(t, ["query_id"]), ["query_id"]).collect()}
    assert sizes[1] == 16 and 1024 <= sizes[2] <= 4096
    assert guards.filters(guards.pieces(t.limit(0), []), []).count() == 0


def test_geometric_loop_rolls_back_copies_and_keeps_its_state(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, v.tolist(), float(738000 + 37 * (i % 23))) for i, v in enumerate(x)], "doc_id long, e array<double>, time_days double")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(4)], "query_id long, q array<double>")
    free = loop.run(queries, corpus, k=10)
    texts = spark.createDataFrame([("Q' = NORMALIZE(α q + β μ+ − γ μ−) and so on",)], "text string")  # what the query slot shows
    held = loop.run(queries, corpus, k=10, texts=texts)
    moved = {r["query_id"] for r in free.log.where("slot = 'query' and accepted").collect()}
    back = {r["query_id"] for r in held.log.where("slot = 'query'").collect()}
    assert moved and back >= moved and held.log.where("slot = 'query' and accepted").count() == 0
    assert {r["why"] for r in held.log.where("slot = 'query'").collect()} == {"rollback: a passage was copied"}
    by = {r["query_id"]: r["document"] for r in held.documents.collect()}
    assert len(by) == 4 and all("Rocchio" not in d for d in by.values())
    assert any("Rocchio" in r["document"] for r in free.documents.collect())
    first = loop.retrieve(loop.start(queries), corpus, 10)
    stopped = held.evidence.where(F.col("query_id").isin(*back)).select("query_id", "doc_id", "rk")
    assert stopped.exceptAll(first.where(F.col("query_id").isin(*back)).select("query_id", "doc_id", "rk")).count() == 0  # nothing moved


def test_ranking_by_task(spark):
    """One act on hits of known vectors: by time, over several hops, and by the review."""
    e = {1: [1.0, 0.0], 2: [0.98, 0.1], 3: [0.2, 0.9], 4: [0.1, 0.95], 5: [0.9, 0.3]}
    said = {1: "wall colour", 2: "wall colour", 3: "the wall", 4: "colour and wall", 5: "nothing"}
    days = {1: 738600.0, 2: 738590.0, 3: 737000.0, 4: 738580.0, 5: None}
    questions = spark.createDataFrame([(q, "Wall colour?", 738640.0, [1.0, 0.0], t) for q, t in ((1, "time"), (2, "multihop"), (3, ""))], "query_id long, question string, query_days double, q0 array<double>, task string")
    texts = spark.createDataFrame([(q, d, said[d], e[d], days[d]) for q in (1, 2, 3) for d in e], "query_id long, doc_id long, text string, e array<double>, time_days double")
    state = memory.start(questions)
    hits = memory.retrieve(state, texts, 5)
    acts = spark.createDataFrame([(q, "rank", "", [1], [2, 5], [3], q == 3, 0.5) for q in (1, 2, 3)], "query_id long, slot string, hop string, relevant_ids array<bigint>, soft_ids array<bigint>, hard_ids array<bigint>, time_mismatch boolean, proxy double")
    by = {r["query_id"]: r for r in memory.changed(state, hits, acts, sessions.hashed_vectors).collect()}
    assert by[1]["hard_ids"] == [3] and by[1]["soft_ids"] == [3] and by[1]["t_star"] == 738640 and by[1]["sigma"] > 30 and 0.4 <= by[1]["lam"] <= 0.6 and by[1]["eta_hard"] == 0.5
    assert set(by[1]["pos_ids"]) == {1, 2, 4}  # 5 has no date
    assert by[2]["lam"] == 0 and by[2]["soft_ids"] == [5] and by[2]["eta_soft"] == 0.25 and by[2]["hard_ids"] == [] and by[2]["t_star"] is None
    assert {tuple(sorted(by[2]["pos_ids"])), tuple(sorted(by[2]["div_ids"]))} == {(1, 2, 5), (3, 4)} and by[2]["delta"] == 0.12 and "multi-hop" in by[2]["document"]
    assert by[3]["hard_ids"] == [3] and set(by[3]["soft_ids"]) == {2, 3, 5} and by[3]["pos_ids"] == [1] and by[3]["sigma"] == 30 and by[3]["lam"] >= 0.4
    again = memory.retrieve(spark.createDataFrame([by[2]], state.schema), texts, 5)
    score = {r["doc_id"]: r["score"] - r["sim"] for r in again.collect()}
    bonus = set(by[2]["div_ids"])
    assert all(score[d] == pytest.approx((0.12 if d in bonus else 0) - (0.25 if d == 5 else 0)) for d in e)
