"""Objects in free text, replayed answers, the cache of computed values, and questions of a stream answered once."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vecmill.functions import text as T
from vecmill.operators import replay, review
from vecmill.sources import cache
from vecmill.streaming import answers

KEYS = ["missing_keys", "slot_decision", "query_intents"]


def first_object(text):
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        try:
            found, end = decoder.raw_decode(text, at)
            if any(k in found for k in KEYS):
                return text[at:end]
        except json.JSONDecodeError:
            pass
        at = text.find("{", at + 1)
    return None


def test_objects_as_a_decoder_finds_them(spark):
    import random

    r = random.Random(3)
    parts = ['{"missing_keys": ', '{"a": ', '"x}"', '"{', "{", "}", "[", "]", ", ", '"slot_decision": 1', '\\"', "é", ' {"query_intents":["b\\"}"]}', "1", '"', "\n"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(1500)] + ['{"a": "' + "x\\n" * 60000 + '", "missing_keys": 1} z']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.json_object(F.col("t"), KEYS).alias("o"))
    assert "Python" not in rows._jdf.queryExecution().toString()
    found = {x["i"]: x["o"] for x in rows.collect()}
    assert [found[i] for i in range(len(texts))] == [first_object(t) for t in texts]
    assert sum(v is not None for v in found.values()) > 100


def test_answers_are_replayed(spark):
    calls = spark.createDataFrame([(1, "k1", "p1"), (2, "k1", "p1"), (3, "k2", "p2"), (4, None, None)], "i int, call_key string, prompt string")
    said = spark.createDataFrame([("k1", "b"), ("k1", "a"), ("k3", "z"), ("k2", None), (None, "n")], "call_key string, answer string")
    got = replay.answered(calls, said)
    assert {x["i"]: x["answer"] for x in got.collect()} == {1: "a", 2: "a", 3: None, 4: None}
    assert [tuple(x) for x in replay.unanswered(got).collect()] == [("k2", "p2")]
    assert replay.answered(calls.limit(0), said).count() == 0 and replay.unanswered(replay.answered(calls, said.limit(0))).count() == 2


def test_a_model_refines_the_review(spark):
    asked = "How long was it last year?"  # nothing to bind, so that the model's phrase counts
    rows = [(i, asked, 1, 1, "Nothing of the kind here", None, 738000.0) for i in range(6)] + [(6, "  ", 1, 1, "x", None, 738000.0), (7, asked, 1, 1, "It took 45 minutes", None, 738000.0)]
    hits = spark.createDataFrame(rows, "query_id int, question string, doc_id int, rk int, text string, time_days double, query_days double")
    calls = review.asked(review.review(hits), hits, "m")
    keys = {x["query_id"]: x["call_key"] for x in calls.select("query_id", "call_key").collect()}
    assert keys[6] is None and keys[0] == keys[1] != keys[7]
    said = {0: None, 1: "no JSON {", 2: '{"missing_keys": ["specific place", "Train  Ride"]}', 3: '{"slot_decision": "RANK"}', 4: '{"query_intents": ["last year", "a b c d e"], "missing_keys": "none"}', 5: '{"missing_keys": ["of the kind here"]}', 6: None, 7: '{"missing_keys": ["train ride"]}'}
    answered = calls.join(spark.createDataFrame(list(said.items()), "query_id int, answer string"), "query_id")
    got = {x["query_id"]: (x["answered"], x["covers"], x["cause"], x["slot"], x["phrase"], x["focus"]) for x in review.refined(answered).collect()}
    none = (False, False, "rank_refine", "rank", "", "")
    assert got[0] == none and got[1] == none
    assert got[2] == (True, False, "unrecalled", "query", "train ride", "train ride")
    assert got[3] == got[4] == got[5] == (True, *none[1:])
    assert got[7] == (True, True, "rank_refine", "rank", "", "train ride")


def test_cache_computes_once(spark, tmp_path):
    path, seen = str(tmp_path / "cache"), []
    rows = spark.createDataFrame([("aa1", 1), ("aa1", 1), ("ab2", 2), ("b03", 3), (None, 4)], "key string, n int")

    def compute(missing):
        seen.append(sorted(x["key"] for x in missing.collect()))
        return missing.where("n < 3").select("key", F.array(F.col("n").cast("double")).alias("value"))

    some = cache.get_or_compute(rows.where("n = 2"), path, compute)
    assert [tuple(x) for x in some.collect()] == [("ab2", [2.0])]
    for _ in range(2):
        got = {x["key"]: x["value"] for x in cache.get_or_compute(rows, path, compute).collect()}
        assert got == {"aa1": [1.0], "ab2": [2.0]}  # b03 could not be computed, and is tried again
    assert seen == [["ab2"], ["aa1", "b03"], ["b03"]]
    assert cache.get_or_compute(rows.limit(0), str(tmp_path / "new"), lambda m: m.select("key", F.array(F.lit(0.0)).alias("value"))).count() == 0


@pytest.mark.parametrize("kill", range(1, 5))
def test_questions_are_answered_once(spark, tmp_path, kill):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([(f"q{i}", "" if i % 3 == 0 else f"h{i}") for i in range(8)], "question_id string, hypothesis string").coalesce(1)
    for _ in range(2):
        rows.write.mode("append").parquet(source)
    seen = []

    def once(name, number):
        seen.append(name)
        if len(seen) == kill:
            raise RuntimeError("killed")

    def run(after=None):
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        answers.answer_stream(stream, lambda b: b, out, state, after=after).awaitTermination()

    with pytest.raises(Exception, match="killed"):
        run(once)
    run()
    read = lambda name: sorted(tuple(x)[:2] for x in answers.read_answers(spark, out, name, "question_id string, hypothesis string").collect())
    assert read("results") == sorted(tuple(x) for x in rows.collect())
    assert read("hypotheses") == sorted(tuple(x) for x in rows.collect() if x[1])
    assert os.path.isdir(f"{out}/results/batch=0")


def test_traces_tell_rounds_in_order(spark):
    from vecmill.operators import trace

    kind = "query_id int, round int, covers boolean, cause string, slot string, accepted boolean, why string, hop string, proxy double, top array<int>"
    log = spark.createDataFrame([(1, 2, True, "rank_refine", None, True, "enough", "h p", 1.0625, [9, 8, 7, 5]), (1, 1, False, "unrecalled", "query", False, "missing", "h p", 0.5, [5, 6]), (2, 1, False, "rank_refine", None, True, "dead_end_stop", "", 0.0, [1])], kind)
    gold = spark.createDataFrame([(1, 5), (1, 7)], "query_id int, doc_id int")
    got = {x["query_id"]: x["trace"].split("\n") for x in trace.traces(log, gold, spark.createDataFrame([(1, "a  b"), (2, None)], "query_id int, question string")).collect()}
    assert got[1] == ["question 1: a b", "round 1: gold 1, top 5,6; covered no, cause unrecalled, proxy 0.500; query (missing) rolled back", "  searched for: h p", "  flags: gold in top 3, still query", "round 2: gold 3, top 9,8,7,5; covered yes, cause rank_refine, proxy 1.063; stop (enough) kept", "end: gold 3"]
    assert got[2] == ["question 2: ", "round 1: gold absent, top 1; covered no, cause rank_refine, proxy 0.000; stop (dead_end_stop) kept", "  flags: dead end", "end: gold absent"]
    assert trace.traces(log.limit(0), gold, spark.createDataFrame([], "query_id int, question string")).count() == 0
    seen = trace.rounds(log.withColumn("lacking", log["covers"]), gold).where("round = 2").first()
    assert seen["flags"] == ["missing cleared by rule"]


def test_done_questions_are_read_from_broken_files(spark, tmp_path):
    from vecmill.operators.analytics import remaining
    from vecmill.sources.files import read_done

    (tmp_path / "r.jsonl").write_text('{"question_id": "a", "n": 1}\n\n{"question_id": "b"\n{"n": 2}\n{"question_id": "a"}\n{"question_id": null}\n{"question_id": "c"}\n')
    done = read_done(spark, str(tmp_path / "r.jsonl"))
    assert sorted(x["question_id"] for x in done.collect()) == ["a", "c"]
    rows = spark.createDataFrame([("a",), ("b",), ("d",)], "question_id string")
    assert sorted(x["question_id"] for x in remaining(rows, done, "question_id").collect()) == ["b", "d"]
