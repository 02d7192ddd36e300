"""Closed-form checks of the core operators, and loops in plain Python where SQL has no equal."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.functions import dates, statistics as S, text as T, vectors as V
from vecmill.operators import loop, metrics, policy, review, search, slots, sessions
from vecmill.sources import files

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def vec(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    r = one(spark, V.unit(vec(3, 4)), V.unit(vec(0, 0)), V.without(vec(1, 1), vec(2, 0)), V.rocchio(vec(1, 0), vec(0, 1), F.lit(None).cast("array<double>")), V.cosine(vec(1, 0), vec(1, 1)))
    assert r[0] == pytest.approx([0.6, 0.8]) and r[1] == [0, 0] and r[2] == pytest.approx([0, 1])
    assert r[3] == pytest.approx([0.8, 0.6]) and r[4] == pytest.approx(math.sqrt(0.5))


def test_metrics_by_hand(spark):
    qrels = spark.createDataFrame([("q1", "d1", 2), ("q1", "d2", 1), ("q1", "d3", 1), ("q2", "d1", 1), ("q3", "d1", 0)], "query_id string, doc_id string, rel int")
    run = spark.createDataFrame([("q1", d, i + 1) for i, d in enumerate(["d9", "d1", "d2", "d8", "d3"])] + [("q3", "d1", 1)], "query_id string, doc_id string, rk int")
    rows = metrics.per_query(run, qrels, [3, 5])
    by = {r["query_id"]: r for r in rows.collect()}
    q1 = by["q1"]
    assert q1["ndcg_3"] == pytest.approx(0.56273, abs=1e-5) and q1["map_3"] == pytest.approx(0.38889, abs=1e-5) and q1["map_5"] == pytest.approx(0.58889, abs=1e-5)
    assert q1["p_3"] == pytest.approx(2 / 3) and q1["recall_3"] == pytest.approx(2 / 3) and q1["mrr_3"] == 0.5 and q1["hit_3"] == 1 and q1["recall_5"] == 1
    assert by["q2"]["ndcg_3"] is None and by["q2"]["mrr_3"] == 0  # judged, but not in the run
    assert by["q3"]["mrr_3"] is None and by["q3"]["recall_3"] == 0  # nothing relevant
    means = {r["metric"]: r["value"] for r in metrics.macro(rows, [3, 5]).collect()}
    assert means["MRR@3"] == pytest.approx(0.25) and means["Recall@3"] == pytest.approx(1 / 3)


def test_session_metrics(spark):
    ids, gold, none = F.array(*map(F.lit, "abcd")), F.array(F.lit("b"), F.lit("d")), F.array().cast("array<string>")
    r = one(spark, metrics.session_recall(ids, gold, 2), metrics.session_hit_all(ids, gold, 4), metrics.session_hit_all(ids, gold, 3), metrics.session_recall(ids, none, 2), metrics.gold_rank(ids, gold), metrics.session_ndcg(ids, gold, 2))
    assert r[:5] == (0.5, 1.0, 0.0, None, 2)
    assert r[5] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


@pytest.mark.parametrize("shipped", [10**9, 0])
def test_exact_search_both_ways(spark, monkeypatch, shipped):
    monkeypatch.setattr(search, "SHIPPED_NUMBERS", shipped)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x[50:60] = x[50]  # ties go to smaller ids
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, e array<double>")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 50, 299)], "query_id long, q array<double>")
    got = {(r["query_id"], r["rk"]): r["doc_id"] for r in search.exact_search(queries, corpus, 7).collect()}
    for q in (0, 50, 299):
        s = (x * x[q]).sum(1)
        assert [got[q, k + 1] for k in range(7)] == np.lexsort((np.arange(300), -s))[:7].tolist()
    if shipped:
        for few in (2, 100):
            plan = {(r["query_id"], r["rk"]): r["doc_id"] for r in search.search_expression(queries, corpus, 7, few_bytes=few).collect()}
            assert plan == got


def test_empty_search(spark):
    corpus = spark.createDataFrame([], "doc_id long, e array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, q array<double>")
    assert search.exact_search(queries, corpus, 3).count() == 0
    assert search.exact_search(queries.limit(0), corpus, 3).count() == 0


def test_fusion_is_similarity_at_rest(spark):
    r = one(spark, search.fused(F.lit(0.3), F.lit(0.9), F.lit(0.0), F.lit(0.0)), search.filter_penalty(F.lit(True), F.lit(0.75), F.lit(False), F.lit(True), F.lit(False)), search.slate_similarity(F.lit(0.3), F.lit(0.5), F.lit(0.6), F.lit(0.5), F.lit(0.85), F.lit(0.15)))
    assert r[0] == 0.3 and r[1] == 0.75 and r[2] == pytest.approx(0.51 - 0.075)


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, 1), (1, 2.0, 1.0, 2), (1, 10.0, 2.0, 3)], "k int, x double, w double, t int")
    r = df.groupBy("k").agg(S.kish(F.col("w")), S.weighted_spread(F.col("x"), F.col("w"))).first()
    assert r[1] == pytest.approx(16 / 6) and r[2] == pytest.approx(np.sqrt(np.average((np.array([1, 2, 10, 10]) - 5.75) ** 2)))
    assert S.weighted_median(df, ["k"], "x", "w", "t").first()["median"] == 2.0
    assert sum(r["w2"] for r in S.with_softmax(df, ["k"], "x", "w2").collect()) == pytest.approx(1)
    assert one(spark, S.recency(F.lit(10.0), F.lit(5.0), F.lit(30.0)), S.recency(F.lit(None).cast("double"), F.lit(5.0), F.lit(30.0)))[:] == (1.0, 0.0)


def test_dates(spark):
    r = one(spark, *[dates.parse_days(F.lit(x)) for x in ("2023/05/20 (Sat) 06:00", "on 2023/05/20", "2023/13/01", "")])
    import datetime

    day = datetime.date(2023, 5, 20).toordinal()
    assert r[0] == day + 0.25 and r[1] == day and r[2] is None and r[3] is None


def test_labels_and_slots(spark):
    cases = {'{"correct": true}': True, '{"correct": true} {"correct": false}': False, "**Yes**.": True, "Label: no": False, "Yes or No": False, "": False}
    r = one(spark, *[T.judge_label(F.lit(k)) for k in cases])
    assert list(r) == list(cases.values())
    doc = "a <!-- EVOLVE:QUERY:START -->x<!-- EVOLVE:QUERY:END --> b <!-- EVOLVE:RANK:START -->y<!-- EVOLVE:RANK:END -->"
    d = F.lit(doc)
    r = one(spark, T.slot_body(T.with_slot(d, "QUERY", "new"), "QUERY"), T.backbone(T.with_slot(d, "RANK", "z")) == T.backbone(d), slots.violation(F.lit("query"), {"query": T.slot_body(d, "QUERY")}, {"query": F.lit("n")}, T.backbone(d), T.backbone(d)).isNull())
    assert r[:] == ("new", True, True)


def test_two_means_and_alias_gap(spark):
    rng = np.random.default_rng(0)
    a, b = np.eye(8)[0], np.eye(8)[1]
    x = np.stack([a + rng.standard_normal(8) * 0.03 for _ in range(4)] + [b + rng.standard_normal(8) * 0.03 for _ in range(4)])
    rows = [(1, i, i + 1, 0.7 - 0.001 * i, v.tolist()) for i, v in enumerate(x)]
    hits = policy.two_means(spark.createDataFrame(rows, "query_id long, doc_id long, rk int, sim double, e array<double>"))
    got = {r["doc_id"]: r["cluster"] for r in hits.collect()}
    assert [got[i] for i in range(8)] == [0] * 4 + [1] * 4
    g = policy.alias_gap(hits).first()
    apart = float(np.linalg.norm(x[:4].mean(0) - x[4:].mean(0)))
    assert g["separation"] == pytest.approx(apart) and g["g_alias"] > 0.9


def test_review(spark):
    hits = spark.createDataFrame(
        [(1, "What color is the bedroom wall?", 10, 1, "The color of the bedroom wall is grey.", 738000.0, 738900.0), (1, "What color is the bedroom wall?", 11, 2, "Nothing.", 738100.0, 738900.0), (1, "What color is the bedroom wall?", 12, 3, "The garden wall fell.", 738200.0, 738900.0),
         (2, "When did I visit the Modern Museum?", 10, 1, "The museum is nice.", 738000.0, 738900.0)],
        "query_id int, question string, doc_id int, rk int, text string, time_days double, query_days double",
    )
    by = {r["query_id"]: r for r in review.review(hits).collect()}
    assert by[1]["covers"] and by[1]["slot"] == "rank" and 10 in by[1]["relevant_ids"] and 11 in by[1]["soft_ids"]
    assert not by[2]["covers"] and by[2]["cause"] == "unrecalled" and by[2]["hop"].endswith("calendar date")


def test_windows(spark):
    turns = [("u" if i % 2 else "a", "word " * 60) for i in range(15)]
    for n, want in ((8, 1), (9, 2), (14, 2), (15, 3)):
        df = spark.createDataFrame([(1, "2023/01/01", turns[:n])], "sid int, date string, turns array<struct<role:string,content:string>>")
        assert sessions.turn_windows(df, "sid").count() == want
    df = spark.createDataFrame([(1, "2023/01/01", [("u", "x")] * 20)], "sid int, date string, turns array<struct<role:string,content:string>>")
    assert [r["chunk_id"] for r in sessions.turn_windows(df, "sid").collect()] == ["1"]


def test_files(spark, tmp_path):
    (tmp_path / "q.tsv").write_text("query-id corpus-id score\nq1 d1 1\n\nq1 d1 2\nq2 0 d3 1\n")
    got = {(r["query_id"], r["doc_id"]): r["rel"] for r in files.read_qrels(spark, str(tmp_path / "q.tsv")).collect()}
    assert got == {("q1", "d1"): 2, ("q2", "d3"): 1}
    (tmp_path / "bad.tsv").write_text("q1 d1\n")
    with pytest.raises(Exception, match="not a judgement"):
        files.read_qrels(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "c.jsonl").write_text('{"_id": "a", "title": "T", "text": "x"}\n{"_id": "a", "contents": "y"}\n')
    assert files.read_texts(spark, str(tmp_path / "c.jsonl")).collect()[0]["composed"] == "y"
    hits = spark.createDataFrame([("q", "d2", 0.5, 1), ("q", "d1", 0.5, 2)], "query_id string, doc_id string, sim double, rk int")
    files.write_run(hits, str(tmp_path / "run"))
    assert [(r["doc_id"], r["rk"]) for r in files.read_run(spark, str(tmp_path / "run")).orderBy("rk").collect()] == [("d1", 1), ("d2", 2)]
    (tmp_path / "i.json").write_text('[{"question_id": "1", "haystack_session_ids": ["s", "t"], "haystack_dates": ["d"], "haystack_sessions": [[{"role": "user", "content": "x"}], []]}]')
    assert files.haystack(files.read_instances(spark, str(tmp_path / "i.json"))).count() == 1


def test_loop_invariants(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((80, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    corpus = spark.createDataFrame([(i, v.tolist(), float(738000 + 37 * (i % 23))) for i, v in enumerate(x)], "doc_id long, e array<double>, time_days double")
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "query_id long, q array<double>")
    hits, log = loop.evolve(queries, corpus, k=10, max_rounds=3)
    rows = log.collect()
    assert {r["query_id"] for r in rows} == set(range(6)) and max(r["round"] for r in rows) <= 3
    for q in range(6):
        mine = sorted((r["round"], r["slot"]) for r in rows if r["query_id"] == q)
        used = [s for _, s in mine if s]
        assert [n for n, _ in mine] == list(range(1, len(mine) + 1)) and len(used) == len(set(used)) and mine[-1][1] is None
    counts = {r["query_id"]: r["count"] for r in hits.groupBy("query_id").count().collect()}
    assert counts == {q: 10 for q in range(6)}


def test_memory_loop(spark):
    from vecmill.operators import memory

    q = "What color is the bedroom wall?"
    docs = [(1, 1, "the bedroom wall was repainted"), (1, 2, "bedroom wall bedroom wall"), (1, 3, "the wall of the bedroom is now grey color"), (1, 4, "the garden"), (2, 5, "The color of the bedroom wall is grey."), (3, 6, "nothing at all")]
    texts = spark.createDataFrame([(a, b, t, 738000.0 + b) for a, b, t in docs], "query_id long, doc_id long, text string, time_days double")
    texts = texts.join(sessions.hashed_vectors(texts, "doc_id", "text"), "doc_id")
    questions = spark.createDataFrame([(1, q, 738500.0), (2, q, 738500.0), (3, q, 738500.0)], "query_id long, question string, query_days double")
    questions = questions.join(sessions.hashed_vectors(questions, "query_id", "question").withColumnRenamed("e", "q0"), "query_id")
    hits, log = memory.evolve(questions, texts, k=3)
    rows = log.collect()
    by = {}
    for r in sorted(rows, key=lambda r: r["round"]):
        by.setdefault(r["query_id"], []).append(r)
    assert by[2][0]["covers"] and by[2][0]["why"] == "enough" and len(by[2]) == 1
    for mine in by.values():
        used = [r["slot"] for r in mine if r["slot"]]
        assert mine[-1]["slot"] is None and len(used) == len(set(used)) and len(mine) <= 3
    assert {r["query_id"] for r in hits.collect()} == {1, 2, 3}
    assert hits.where("query_id = 1").count() == 3


def test_sane_phrases(spark):
    cases = [
        (["commute time", "  the daily  commute!", "Is it?", "a.b", "one two three four five", "what when", "COMMUTE TIME", "red bicycle tyre", "blue bike"], "How long is my daily commute time?", "", ["commute time", "the daily commute!", "blue bike"]),
        (["coffee creamer"], "Where is the coffee creamer?", "I bought coffee creamer today", []),
        ([], "x", "", []),
    ]
    for items, question, texts, want in cases:
        array = F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")
        assert one(spark, review.sane_phrases(array, F.lit(question), F.lit(texts)))[0] == want


def test_review_of_the_fixture(spark):
    """The whole review against a plain loop over the rules that decide it."""
    from vecmill.plans import registry, texts

    got = {r["query_id"]: r for r in registry.QUERIES["review_evidence"](spark, SF).collect()}
    asserted = {(r["qid"], r["sid"]): r["asserted"] for r in registry.QUERIES["value_asserted"](spark, SF).collect()}
    hops = {int(r["id"][1:]): r["hop"] for r in registry.QUERIES["hop_phrase"](spark, SF).where("id like 'q%'").collect()}
    for q, row in got.items():
        covers = any(asserted[q, s] for s in range(3))
        ids = [int(x) for c in ("relevant", "soft", "hard") for x in row[c].split(",") if x]
        assert sorted(ids) == list(range(len(texts.SNIPPETS)))  # every text has one verdict
        assert row["covers"] == covers and row["hop"] == hops[q]
        assert row["slot"] == ("query" if not covers and hops[q] else "rank")
        assert all(s < 7 for s in map(int, filter(None, row["hard"].split(","))))  # hard ones are over a year old


def test_search_with_string_ids(spark):
    x = {"b": [1.0, 0.0], "a": [1.0, 0.0], "c": [0.0, 1.0]}
    corpus = spark.createDataFrame(list(x.items()), "doc_id string, e array<double>")
    queries = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, 2.0])], "query_id string, q array<double>")
    rows = search.exact_search(queries, corpus, 2).orderBy("query_id", "rk").collect()
    assert [(r["query_id"], r["doc_id"], r["sim"]) for r in rows] == [("q1", "a", 1.0), ("q1", "b", 1.0), ("q2", "c", 2.0), ("q2", "a", 0.0)]


def test_fixture_of_stale_texts(spark):
    from vecmill.sources import fixtures

    hits, log = loop.evolve(*fixtures.temporal(spark), k=8)
    top = [r["doc_id"] for r in hits.orderBy("rk").limit(2).collect()]
    rounds = {r["round"]: r for r in log.collect()}
    assert "rule_2024" in top and rounds[1]["gap"] == "time" and rounds[1]["accepted"]
    first = loop.retrieve(loop.start(fixtures.temporal(spark)[0], "string"), fixtures.temporal(spark)[1], 8)
    assert first.orderBy("rk").first()["doc_id"] in ("rule_2018", "rule_2019", "rule_2020")


def test_fixture_of_two_senses(spark):
    from vecmill.sources import fixtures

    queries, corpus = fixtures.alias(spark)
    hits, log = loop.evolve(queries, corpus, k=8)
    assert {r["round"]: r["gap"] for r in log.collect()}[1] == "alias"
    assert all(r["doc_id"].startswith("first_") for r in hits.orderBy("rk").limit(3).collect())
    state = loop.start(queries, "string")
    going = queries.select("query_id", F.lit("alias").alias("gap"), F.lit("query").alias("slot"))
    after = loop.moved(state, loop.retrieve(state, corpus, 8), going)
    body = after.select(loop.bodies({n: F.col(n) for n in loop.STATE})["query"].alias("b"), "broken").first()
    assert body["broken"] is None and "Rocchio" in body["b"] and "first_" not in body["b"]


def test_rollback_keeps_the_state(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.01 * i], None) for i in range(6)], "doc_id long, e array<double>, time_days double")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    state = loop.start(queries)
    going = queries.select("query_id", F.lit("time").alias("gap"), F.lit("rank").alias("slot"))  # nothing is dated: rank cannot change
    after = loop.moved(state, loop.retrieve(state, corpus, 5), going).first()
    assert after["broken"] == "the slot did not change" and after["used"] == [] and after["lam"] == 0


def test_memory_signals_fall_back_to_time(spark):
    rows = [(1, d, 0.5, 738000.0 + 100 * d, None, d == 1, d == 2) for d in (1, 2)] + [(2, d, 0.5, 738000.0 + 400 * d, None, False, False) for d in (1, 2, 3)]
    hits = spark.createDataFrame(rows, "query_id long, doc_id long, sim double, time_days double, query_days double, relevant boolean, negative boolean")
    got = {(r["query_id"], r["doc_id"]): r["side"] for r in policy.memory_signals(hits).collect()}
    assert got[1, 1] == "pos" and got[1, 2] == "neg" and got[2, 1] == "neg" and got[2, 3] == "pos"


def test_query_moves_where_there_is_no_phrase(spark):
    from vecmill.operators import memory

    questions = spark.createDataFrame([(1, "q", 738000.0, [1.0, 0.0])], "query_id long, question string, query_days double, q0 array<double>")
    texts = spark.createDataFrame([(1, d, "t", [0.0, 1.0] if d == 1 else [1.0, 0.0], 738000.0) for d in (1, 2, 3)], "query_id long, doc_id long, text string, e array<double>, time_days double")
    state = memory.start(questions)
    acts = spark.createDataFrame([(1, "query", "", [1], [2, 3], [], False, 0.0)], "query_id long, slot string, hop string, relevant_ids array<bigint>, soft_ids array<bigint>, hard_ids array<bigint>, time_mismatch boolean, proxy double")
    hits = memory.retrieve(state, texts, 3)
    seen = []

    def encode(rows, key, text):
        seen.append((key, text))
        return rows.select(key, F.array(F.lit(0.0), F.lit(1.0)).alias("e"))

    moved = memory.changed(state, hits, acts, encode).first()
    want = np.array([1 - 0.15, 0.75])
    assert seen == [("query_id", "hop")] and moved["v"] is None and np.allclose(moved["q"], want / np.linalg.norm(want))
    phrased = memory.changed(state, hits, acts.withColumn("hop", F.lit("phrase")), encode).first()
    assert phrased["v"] == [0.0, 1.0] and phrased["q"] == [1.0, 0.0]
    vague = memory.changed(state, hits, acts.withColumn("hop", F.lit("specific place")), encode).first()
    assert vague["v"] is None and np.allclose(vague["q"], moved["q"])


def test_objects_in_free_text(spark):
    texts = ['say {"a": 1} then {"slot_decision": "RANK", "x": {"y": "}"}} end', "none", "{broken {\"missing_keys\": []}", None, '[{"query_intents": []}]', '{"missing_keys": [']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.json_object(F.col("t"), ["missing_keys", "slot_decision", "query_intents"]).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in rows] == ['{"slot_decision": "RANK", "x": {"y": "}"}}', None, '{"missing_keys": []}', None, '{"query_intents": []}', None]


def test_experiment_files(spark, tmp_path):
    from vecmill.sources import experiments as E

    (tmp_path / "s.json").write_text('{"encode": {"model": "m", "dim": 4}, "list": [1, 2]}')
    (tmp_path / "bad.json").write_text("[1, 2]")
    found = E.read_settings(spark, str(tmp_path / "s.json"))
    assert {r["key"]: r["value"] for r in E.settings_rows(spark, found).collect()} == {"encode.model": '"m"', "encode.dim": "4", "list": "[1, 2]"}
    with pytest.raises(ValueError):
        E.read_settings(spark, str(tmp_path / "bad.json"))
    (tmp_path / "c.jsonl").write_text('{"_id": "d1", "title": "T", "text": "x"}\n{"_id": "d2", "text": "y"}\n')
    (tmp_path / "q.jsonl").write_text('{"_id": "q1", "text": "ask"}\n')
    (tmp_path / "r.tsv").write_text("query-id corpus-id score\nq1 d1 1\n")
    paths = [str(tmp_path / n) for n in ("c.jsonl", "q.jsonl", "r.tsv")]
    docs, asked, qrels = E.load_dataset(spark, *paths)
    assert sorted(map(tuple, docs.collect())) == [("d1", "T x"), ("d2", "y")] and [tuple(r) for r in qrels.collect()] == [("q1", "d1", 1)] and asked.count() == 1
    with pytest.raises(FileNotFoundError):
        E.load_dataset(spark, *paths[:2], str(tmp_path / "absent"))
    E.write_vectors(docs, str(tmp_path / "v"), {"model": "m", "dim": 4})
    assert E.read_vectors(spark, str(tmp_path / "v"), {"dim": 4, "model": "m"}).count() == 2
    with pytest.raises(ValueError):
        E.read_vectors(spark, str(tmp_path / "v"), {"model": "other"})
    hits = spark.createDataFrame([("q1", "d1", 0.5, 1), ("q1", "d2", 0.25, 2)], "query_id string, doc_id string, sim double, rk int")
    E.write_results(hits, str(tmp_path / "out"))
    assert list(spark.read.schema("query_id string, hits map<string,double>").json(str(tmp_path / "out")).first()["hits"].items()) == [("d1", 0.5), ("d2", 0.25)]
    answers = spark.createDataFrame([("q1", "h", 1)], "question_id string, hypothesis string, n int")
    for _ in range(2):
        E.append_answers(answers, str(tmp_path / "res"), str(tmp_path / "hyp"))
    assert E.read_results(spark, str(tmp_path / "res"), "question_id string, n int").count() == 2
    assert spark.read.json(str(tmp_path / "hyp")).columns == ["hypothesis", "question_id"]
    computed = spark.createDataFrame([("nDCG@10", 0.5)], "metric string, value double")
    record = E.metrics_record("d", "NDCG@10", computed, None, 1)
    E.write_metrics(record, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["ok"] is True and record.first()["primary_value"] == 0.5
    with pytest.raises(Exception, match="was not computed"):
        E.metrics_record("d", "MAP@10", computed, None, 1).collect()


def test_pooling_needs_the_pooler():
    with pytest.raises(ValueError):
        V.pooled(F, F, "cls_pooler")


def test_small_tables_stay_in_their_splits(spark):
    from vecmill.session import spread

    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert spread(df) is df
