"""Texts are read once a row, whatever the number of words that are looked up in them."""

from pyspark.sql import functions as F

from vecmill.functions import text as T


def test_patterns_are_tried_only_where_the_word_occurs(spark):
    rows = spark.createDataFrame([(0, "A SHIRT, blue", ["shirts"]), (1, "nothing", ["(("]), (2, None, ["wall"]), (3, "shirtsleeves", ["shirts"]), (4, "x", [])], "i int, text string, binds array<string>")
    got = {r["i"]: r["b"] for r in rows.select("i", T.bound(F.col("text"), T.words([]), F.col("binds")).alias("b")).collect()}  # raised at the brackets before
    assert got == {0: True, 1: False, 2: False, 3: False, 4: True}


def test_a_bag_is_sorted_once(spark):
    x = T.aliases(F.col("missing"), F.col("bag"))
    rows = spark.createDataFrame([(["pack", "walk"], ["walked", "packing", "walk", "packers", "wal"])], "missing array<string>, bag array<string>")
    plan = rows.select(x.alias("a"))
    assert plan._jdf.queryExecution().analyzed().toString().count("array_sort(") == 1
    assert plan.first()["a"] == ["packers", "packing", "wal", "walked"]
