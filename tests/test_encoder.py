"""The hashing encoder counts terms within their row."""

from vecmill.operators import sessions


def test_one_row_a_text_is_shuffled(spark):
    rows = spark.createDataFrame([(1, "walls painted grey"), (1, "walls again"), (None, "words"), (2, None), (3, "")], "k int, text string")
    out = sessions.hashed_vectors(rows, "k", "text")
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()  # a row a term before
    got = {r["k"]: r["e"] for r in out.collect()}
    assert set(got) == {1, 2, 3, None} and got[2] == got[3] == [0.0] * 64
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-9 and sum(x != 0 for x in got[None]) == 1
