"""Streams give what batches give, and a resumed stream repeats nothing."""

import numpy as np

from vecmill.operators import search
from vecmill.streaming import resume


def test_search_stream_resumes(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, 4))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, e array<double>")
    schema = "query_id long, q array<double>"
    asked, out, mark = str(tmp_path / "asked"), str(tmp_path / "out"), str(tmp_path / "mark")
    first = spark.createDataFrame([(i, x[i].tolist()) for i in (1, 2, 2)], schema)
    first.write.parquet(asked)
    stream = lambda: spark.readStream.schema(schema).parquet(asked)
    resume.search_stream(stream(), corpus, out, mark, k=3).awaitTermination()
    again = spark.createDataFrame([(i, x[i].tolist()) for i in (2, 3)], schema)
    again.write.mode("append").parquet(asked)
    resume.search_stream(stream(), corpus, out, mark, k=3).awaitTermination()
    got = sorted((r["query_id"], r["rk"], r["doc_id"]) for r in spark.read.parquet(out).collect())
    want = search.exact_search(spark.createDataFrame([(i, x[i].tolist()) for i in (1, 2, 3)], schema), corpus, 3)
    assert got == sorted((r["query_id"], r["rk"], r["doc_id"]) for r in want.collect())


def test_event_windows_stream(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,0,i*7) as ts, 't' || i % 2 as event_type, cast(i as double) as value from (select explode(sequence(0, 40)) as i)")
    events.write.parquet(str(tmp_path / "e"))
    stream = resume.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["start"], r["event_type"], r["n"], r["mean"])
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, resume.event_windows(events).collect()))
