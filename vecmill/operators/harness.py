"""Selecting questions of a benchmark, scoring answers and retrieval over them, and reading runs after the fact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmill.functions import text as T

# The six kinds of questions, the mark of questions without an answer, what a reader says who has none.
QUESTION_TYPES = ["single-session-user", "single-session-assistant", "single-session-preference", "multi-session", "temporal-reasoning", "knowledge-update"]
ABSTENTION_MARK = "_abs"
NO_ANSWER = "i do not know"
GOLD_CHARS = 40


def of_types(questions: DataFrame, keep: list[str] | None) -> DataFrame:
    """Questions of the given types; all of them without a list."""
    return questions.where(F.col("question_type").isin(*keep)) if keep else questions


def is_abstention(question_id: Column) -> Column:
    return F.contains(question_id.cast("string"), F.lit(ABSTENTION_MARK))


def picked(questions: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted: (question_id). The questions with these ids, and the ids that no question has."""
    ids = wanted.select("question_id").distinct()
    return questions.join(ids, "question_id", "left_semi"), ids.join(questions.select("question_id"), "question_id", "left_anti")


def report(results: DataFrame, types: list[str], places: int = 4) -> DataFrame:
    """results (question_id, question_type, qa_correct, abstention, recall_5, recall_10, ndcg_5, ndcg_10, hit_all_5,
    hit_all_10) to rows (metric, question_type, value, n).

    Accuracies count answers with a label; the task average is the mean over the types that have any; retrieval leaves
    questions without an answer out, and values that are not numbers.
    """
    c = F.col
    label = F.when(c("qa_correct").isNotNull(), c("qa_correct").cast("double"))
    kept = ~F.coalesce(c("abstention"), F.lit(False))
    number = lambda m: F.when(kept & ~F.isnan(c(m)), c(m))
    values = {f"{m}_{k}": number(f"{m}_{k}") for k in (5, 10) for m in ("recall", "ndcg", "hit_all")}
    rows = results.select("question_type", label.alias("accuracy"), F.when(~kept | is_abstention(c("question_id")), label).alias("abstention_accuracy"), *[v.alias(n) for n, v in values.items()])
    names = ["accuracy", "abstention_accuracy", *values]
    mean = lambda n: F.struct(F.lit(n).alias("metric"), F.avg(n).alias("value"), F.count(n).alias("n"))
    by_type = rows.groupBy("question_type").agg(*[mean(n).alias(n) for n in ("accuracy", "recall_5", "hit_all_10")])
    by_type = by_type.select("question_type", F.explode(F.array("accuracy", "recall_5", "hit_all_10")).alias("m")).select("m.metric", "question_type", "m.value", "m.n").where("n > 0")
    by_type = by_type.where((c("metric") != "accuracy") | c("question_type").isin(*types))
    whole = rows.agg(*[mean(n).alias(n) for n in names]).select(F.explode(F.array(*names)).alias("m")).select("m.metric", F.lit("all").alias("question_type"), "m.value", "m.n")
    tasks = by_type.where("metric = 'accuracy'").agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(F.lit("task_averaged_accuracy").alias("metric"), F.lit("all").alias("question_type"), "value", "n")
    return by_type.unionByName(whole).unionByName(tasks).withColumn("value", F.round("value", places))


def relabelled(results: DataFrame) -> DataFrame:
    """results (.., judge_verdict, qa_correct) with labels read anew from the verdicts, the old ones, and whether they differ."""
    new = T.judge_label(F.col("judge_verdict"))
    rows = results.withColumn("qa_correct_old", F.col("qa_correct")).withColumn("qa_correct", new)
    return rows.withColumn("flipped", F.coalesce("qa_correct_old", F.lit(False)) != F.col("qa_correct"))


def unsure(hypothesis: Column) -> Column:
    """The reader says that it has no answer."""
    return F.startswith(F.lower(T.strip(F.coalesce(hypothesis, F.lit("")))), F.lit(NO_ANSWER))


def failure_mode(abstention: Column, recall: Column, correct: Column, abstained: Column, hypothesis: Column) -> Column:
    """Why a wrong answer is wrong although all evidence was retrieved; null if it is right or evidence is missing."""
    failed = ~F.coalesce(abstention, F.lit(False)) & (F.coalesce(recall, F.lit(0.0)) >= 0.999) & ~F.coalesce(correct, F.lit(False))
    why = F.when(F.coalesce(abstained, F.lit(False)), "gate_abstain").when(unsure(hypothesis), "reader_idk").otherwise("answered_wrong")
    return F.when(failed, why)


def sufficiency(results: DataFrame) -> DataFrame:
    """(sufficient, answer, n) of the results that have a verdict of sufficiency: answers that are idk, or else correct."""
    idk = unsure(F.col("hypothesis")) | F.coalesce("reader_abstained", F.lit(False))
    answer = F.when(idk, "idk").when(F.col("qa_correct"), "correct")
    return results.where("sufficient is not null").select("sufficient", answer.alias("answer")).where("answer is not null").groupBy("sufficient", "answer").agg(F.count("*").alias("n"))


def movement(first: Column, final: Column) -> Column:
    """How the rank of the gold text moved between the first and the last round; null if the last one does not have it."""
    return F.when(first.isNotNull() & final.isNotNull(), F.when(final < first, "up").when(final > first, "down").otherwise("same")).when(first.isNull() & final.isNotNull(), "late_in")


def most_common(rows: DataFrame, columns: list[str], most: int | None = None) -> DataFrame:
    """(feature, value, n): how often each value of each column occurs, arrays value by value; at most `most` of a column."""
    parts = []
    for c in columns:
        value = F.explode_outer(c) if rows.schema[c].dataType.typeName() == "array" else F.col(c)
        parts.append(rows.select(F.lit(c).alias("feature"), value.alias("value")).select("feature", F.coalesce(F.col("value").cast("string"), F.lit("none")).alias("value")))
    counts = parts[0]
    for p in parts[1:]:
        counts = counts.unionByName(p)
    counts = counts.groupBy("feature", "value").agg(F.count("*").alias("n"))
    if most is None:
        return counts
    from vecmill.operators.search import top_k

    return top_k(counts, ["feature"], "n", "value", most).drop("rk")


def holds_gold(hypothesis: Column, gold: Column) -> Column:
    """The beginning of the gold answer stands in the hypothesis."""
    front = F.substring(F.lower(T.strip(F.coalesce(gold, F.lit("")))), 1, GOLD_CHARS)
    return (front != "") & F.contains(F.lower(F.coalesce(hypothesis, F.lit(""))), front)


def rank_probe(before: DataFrame, after: DataFrame, gold: DataFrame) -> DataFrame:
    """Runs (query_id, doc_id, rk) before and after a change, gold (query_id, doc_id): (query_id, rank_before, rank_after,
    delta), delta positive where gold moved up; null where a run does not have it."""
    best = lambda run, name: run.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rk").alias(name))
    rows = gold.select("query_id").distinct().join(best(before, "rank_before"), "query_id", "left").join(best(after, "rank_after"), "query_id", "left")
    return rows.withColumn("delta", F.col("rank_before") - F.col("rank_after"))


def audit_probe(ranks: DataFrame, reviews: DataFrame, least: int = 5) -> DataFrame:
    """ranks (query_id, gold_rank), reviews (query_id, missing): whether something is said to be missing where gold is
    not among the first `least`: (query_id, gold_rank, expected, missing, aligned)."""
    expected = F.col("gold_rank").isNull() | (F.col("gold_rank") > least)
    return ranks.join(reviews.select("query_id", "missing"), "query_id").withColumn("expected", expected).withColumn("aligned", F.col("expected") == F.col("missing"))
