"""What a loop did for a question, in words: a line a round with the place of its gold text, and what looks wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmill.functions import text as T
from vecmill.operators import slots

HEAD_CHARS = 60
ROUND = "round %d: gold %s, top %s; covered %s, cause %s, proxy %.3f; %s (%s) %s"


def rounds(log: DataFrame, gold: DataFrame) -> DataFrame:
    """log of the memory loop with gold_rank, the best place of any gold text (null: not found), and flags.

    gold: (query_id, doc_id). If the log has a column lacking, it says that a reviewer found something missing before the rule of
    sufficiency was applied.
    """
    wanted = gold.groupBy("query_id").agg(F.collect_set("doc_id").alias("gold"))
    rows = log.join(wanted, "query_id", "left")
    places = F.filter(F.transform("top", lambda d, i: F.when(F.array_contains("gold", d), i + 1)), lambda x: x.isNotNull())
    action = F.when(F.startswith("why", F.lit("dead_end")), "query-dead-end").otherwise(F.coalesce("slot", F.lit("stop")))
    lacking = F.col("lacking") if "lacking" in log.columns else F.lit(False)
    rows = rows.withColumn("gold_rank", F.array_min(places)).drop("gold")
    return rows.withColumn("flags", slots.flags(F.col("gold_rank"), lacking, ~F.col("covers") & (F.col("hop") != ""), action))


def _line() -> Column:
    yes = lambda c, a, b: F.when(c, a).otherwise(b)
    place = F.coalesce(F.col("gold_rank").cast("string"), F.lit("absent"))
    shown = F.array_join(F.col("top").cast("array<string>"), ",")
    proxy = F.floor(F.col("proxy") * 1000 + 0.500001) / 1000.0
    text = F.format_string(ROUND, "round", place, shown, yes(F.col("covers"), "yes", "no"), "cause", proxy, F.coalesce("slot", F.lit("stop")), "why", yes(F.col("accepted"), "kept", "rolled back"))
    searched = F.when(F.col("slot").eqNullSafe("query") & (F.col("hop") != ""), F.concat(F.lit("\n  searched for: "), F.col("hop"))).otherwise("")
    return F.concat(text, searched, F.when(F.size("flags") > 0, F.concat(F.lit("\n  flags: "), F.array_join("flags", ", "))).otherwise(""))


def traces(log: DataFrame, gold: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, trace): a text per question (query_id, question) of the log; a run has few rounds a question, so its lines are few."""
    each = rounds(log, gold).withColumn("line", _line())
    texts = each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("round", "line"))), lambda x: x["line"]), "\n").alias("lines"), F.max_by("gold_rank", "round").alias("last"))
    head = F.format_string("question %s: %s\n", F.col("query_id").cast("string"), T.snippet(F.col("question"), HEAD_CHARS))
    end = F.concat(F.lit("\nend: gold "), F.coalesce(F.col("last").cast("string"), F.lit("absent")))
    return texts.join(questions.select("query_id", "question"), "query_id").select("query_id", F.concat(head, "lines", end).alias("trace"))
