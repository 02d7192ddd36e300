"""Files of several splits against reading them whole."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vecmill import session
from vecmill.sources import files


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_last_judgement_of_a_split_file(small_splits, tmp_path):
    rng = random.Random(1)
    want, lines = {}, ["query-id\tcorpus-id\tscore"]
    for _ in range(3000):
        q, d, r = f"q{rng.randrange(30)}", f"d{rng.randrange(30)}", rng.randrange(5)
        want[q, d] = r
        lines.append(rng.choice([f"{q}\t{d}\t{r}.7", f" {q} 0 {d} {r} more", f"{q}  Q0  {d}   {r}"]))
        if rng.random() < 0.1:
            lines.append("  ")
    (tmp_path / "q.tsv").write_text("\n".join(lines))
    read = files.ordered_lines(small_splits, str(tmp_path / "q.tsv"))
    assert read.select("at.block").distinct().count() > 10 and read.where("first").count() == 1
    assert {(r["query_id"], r["doc_id"]): r["rel"] for r in files.read_qrels(small_splits, str(tmp_path / "q.tsv")).collect()} == want
    (tmp_path / "late.tsv").write_text("a b 1\nqid d 2\n")  # no header there: a judgement
    assert {r["query_id"] for r in files.read_qrels(small_splits, str(tmp_path / "late.tsv")).collect()} == {"a", "qid"}


def test_places_of_lines_are_numbers_in_order(small_splits, tmp_path):
    rng = random.Random(4)
    folder = tmp_path / "odd names"
    folder.mkdir()
    want, written = {}, []
    for name in ("a b.tsv", "a%20c.tsv", "aé+.tsv", "b.tsv"):
        lines = ["qid d r"]
        for _ in range(800):
            q, d, r = f"q{rng.randrange(9)}", f"d{rng.randrange(30)}", rng.randrange(1000)
            want[q, d] = r
            lines += [f"{q} {d} {r}", *[""] * rng.choice([0, 0, 0, 1, 9])]
        (folder / name).write_text("\n".join(lines) + "\n")
        written += lines
    read = files.numbered_lines(small_splits, str(folder))
    assert dict(read.dtypes)["at"] == "bigint" and read.where("first").count() == 4
    assert [r["value"] for r in read.orderBy("at").collect()] == written and read.select("at").distinct().count() == len(written)
    judged = files.read_qrels(small_splits, str(folder))
    assert {(r["query_id"], r["doc_id"]): r["rel"] for r in judged.collect()} == want


def test_parts_of_judgements_follow_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "PART_BYTES", 1000)
    (tmp_path / "q.tsv").write_text("".join(f"q{i} d{i} 1\n" for i in range(2000)))
    size = (tmp_path / "q.tsv").stat().st_size
    read = files.read_qrels(spark, str(tmp_path / "q.tsv"))
    assert read.rdd.getNumPartitions() == -(-size // 1000) > 4 and read.count() == 2000
    assert "ObjectHashAggregate" not in (plan := read._jdf.queryExecution().executedPlan().toString()) and "SortAggregate" not in plan and "HashAggregate" in plan


def test_last_text_of_a_split_file(small_splits, tmp_path):
    rng = random.Random(2)
    want, lines = {}, []
    for i in range(2000):
        k = str(rng.randrange(40))
        want[k] = f"text {i}"
        lines.append(json.dumps({"_id": k, "title": "t", "text": want[k]}))
    (tmp_path / "c.jsonl").write_text("\n\n".join(lines))
    assert {r["id"]: r["text"] for r in files.read_texts(small_splits, str(tmp_path / "c.jsonl")).collect()} == want


@pytest.mark.parametrize("indent", [None, 1])
def test_array_of_a_split_file(small_splits, tmp_path, indent):
    rng = random.Random(3)
    odd = ['"', '\\', '\\"', "}", "{", "[", "]", ",", "x", "é", "\n", " ", '"}],[{"']
    word = lambda: "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    instances = []
    for i in range(60):
        n = rng.choice([0, 1, 3, 40 if i % 20 == 7 else 2])
        turns = lambda: [{"role": "user", "content": word()} for _ in range(rng.randrange(4))]
        instances.append({"question_id": f"{i}", "question": word(), "haystack_session_ids": [word() for _ in range(n)], "haystack_dates": ["d"] * n, "haystack_sessions": [turns() for _ in range(n)]})
    path = tmp_path / "i.json"
    path.write_text(json.dumps(instances, indent=indent, ensure_ascii=False))
    assert path.stat().st_size > 6000
    got = {r["question_id"]: r for r in files.read_instances(small_splits, str(path)).collect()}
    assert len(got) == 60
    for x in instances:
        r = got[x["question_id"]]
        assert r["question"] == x["question"] and r["haystack_session_ids"] == x["haystack_session_ids"]
        assert [[t.asDict() for t in s] for s in r["haystack_sessions"]] == x["haystack_sessions"]


def test_arrays_of_several_files_and_what_is_none(small_splits, tmp_path):
    (tmp_path / "many").mkdir()
    for i in range(3):
        (tmp_path / "many" / f"{i}.json").write_text(" [\n" + ",".join(json.dumps({"question_id": f"{i}-{j}", "question": "x" * 900}) for j in range(5 * i)) + "]\n")
    assert {r["question_id"] for r in files.read_instances(small_splits, str(tmp_path / "many")).collect()} == {f"{i}-{j}" for i in range(3) for j in range(5 * i)}
    (tmp_path / "none.json").write_text('{"question_id": "1"}')
    with pytest.raises(Exception, match="not a list"):
        files.read_instances(small_splits, str(tmp_path / "none.json")).collect()


def test_array_sink(spark, tmp_path):
    rows = spark.range(50).select(F.col("id"), F.lit('a "b" } \\').alias("t")).repartition(3)
    files.write_json_array(rows, str(tmp_path / "a"))
    assert sorted(x["id"] for f in (tmp_path / "a").glob("part-*") for x in json.loads(f.read_text())) == list(range(50))
    assert files.json_array(spark, str(tmp_path / "a")).count() == 50
