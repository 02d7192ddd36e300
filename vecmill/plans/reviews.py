"""The evidence review over questions with their hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.operators import review
from vecmill.plans import texts
from vecmill.plans.base import r
from vecmill.plans.registry import query
from vecmill.plans.review_sql import sql_review
from vecmill.session import table

_FIXTURE = f"{texts.SQL_Q}, {texts.SQL_S}, hits AS (SELECT qid AS query_id, question, sid AS doc_id, sid + 1 AS rk, text, (738000 + sid * 40)::DOUBLE AS time_days, 738640::DOUBLE AS query_days FROM q CROSS JOIN s WHERE question <> '')"
_TALKS = "talks AS (SELECT a.conv_id AS query_id, a.text AS question, a.conv_id * 100 + b.turn AS doc_id, row_number() OVER (PARTITION BY a.conv_id ORDER BY b.turn) AS rk, b.text, (738000 + b.turn * 40)::DOUBLE AS time_days, 738640::DOUBLE AS query_days FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0)"
_OUT = ["cause", "first_cause", "slot", "covers", "time_mismatch", "hop"]
_LISTS = {"relevant": "relevant_ids", "soft": "soft_ids", "hard": "hard_ids", "missing": "missing_terms"}
_SELECT = f"query_id, {', '.join(_OUT)}, {r('proxy')} AS proxy, " + ", ".join(f"array_to_string({c}, ',') AS {n}" for n, c in _LISTS.items())


def _shown(reviewed):
    return reviewed.select("query_id", *_OUT, S.steady(F.col("proxy")).alias("proxy"), *[F.array_join(F.col(c).cast("array<string>"), ",").alias(n) for n, c in _LISTS.items()])


@query("review_evidence", f"WITH {_FIXTURE}, {sql_review('hits', 'rv')} SELECT {_SELECT} FROM rv")
def review_evidence(spark, sf_dir):
    """The whole review of each question of the fixture over all its texts."""
    q = texts.rows(spark, texts.QUESTIONS, "query_id", "question").where("question <> ''")
    s = texts.rows(spark, texts.SNIPPETS, "sid", "text").withColumn("time_days", F.lit(738000.0) + F.col("sid") * 40)
    hits = q.join(F.broadcast(s), F.lit(True)).select("query_id", "question", F.col("sid").alias("doc_id"), (F.col("sid") + 1).alias("rk"), "text", "time_days")
    return _shown(review.review(hits.withColumn("query_days", F.lit(738640.0))))


@query("review_conversations", f"WITH {_TALKS}, {sql_review('talks', 'rv')} SELECT {_SELECT} FROM rv")
def review_conversations(spark, sf_dir):
    """The review of each conversation's first turn over its later ones."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    first = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("question"))
    later = c.where("turn > 0").select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "turn", "text", (F.lit(738000.0) + F.col("turn") * 40).alias("time_days"))
    hits = later.join(first, "query_id").withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("turn"))).withColumn("query_days", F.lit(738640.0))
    return _shown(review.review(hits))
