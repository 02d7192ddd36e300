"""Relations that many queries share, in Spark and in SQL.

Corpus: embeddings, as unit vectors, dated by the event of the same id.  Queries: the rows whose id is divisible by
50.  Judgements: rows of the query's label are relevant, of grade 2 if the id is also alike modulo 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.functions import dates, vectors as V
from vecmill.operators import search
from vecmill.session import table

EVERY = 50

SQL_UNIT = """unit AS (
  SELECT vec_id, label, list_transform(x, lambda v: v / greatest(sqrt(list_inner_product(x, x)), 1e-8)) AS u
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings))"""
SQL_DATED = """dated AS (
  SELECT event_id AS doc_id, (date_diff('day', DATE '1970-01-01', ts::DATE) + 719163)::DOUBLE + hour(ts) / 24.0::DOUBLE + minute(ts) / 1440.0::DOUBLE AS time_days FROM events)"""


def sql_hits(k: int, name: str = "hits") -> str:
    """WITH-parts unit, dated, and hits: query_id, doc_id, sim, rk, time_days, label."""
    return f"""{SQL_UNIT}, {SQL_DATED}, {name} AS (
  SELECT h.*, t.time_days FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rk FROM (
      SELECT q.vec_id AS query_id, d.vec_id AS doc_id, d.label AS label, q.label AS query_label, d.u AS e, list_inner_product(q.u, d.u) AS sim
      FROM unit q CROSS JOIN unit d WHERE q.vec_id % {EVERY} = 0)) h
  LEFT JOIN dated t ON t.doc_id = h.doc_id WHERE rk <= {k})"""


SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"  # what strip() takes off, in SQL


def r(x: str, places: int = 6) -> str:
    """Rounded for comparison, in SQL, without negative zero."""
    return f"(round(({x})::DOUBLE, {places}) + 0.0::DOUBLE)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", V.unit(V.doubles(F.col("embedding"))).alias("u"))


def dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), dates.ordinal_days(F.col("ts")).alias("time_days"))


def queries_of(u: DataFrame) -> DataFrame:
    return u.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("u").alias("q"))


def hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """query_id, doc_id, sim, rk, e, label, query_label, time_days: the k best of each query."""
    u = units(spark, sf_dir)
    corpus = u.select(F.col("vec_id").alias("doc_id"), F.col("u").alias("e"), "label")
    found = search.exact_search(queries_of(u), corpus, k)
    labels = u.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"))
    return found.join(corpus, "doc_id").join(labels, "query_id").join(dated(spark, sf_dir), "doc_id", "left")


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, rel): an equality join on the label."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    q = e.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    d = e.select(F.col("vec_id").alias("doc_id"), "label")
    same = q.join(d, "label").where("query_id <> doc_id")
    return same.select("query_id", "doc_id", F.when(F.col("query_id") % 2 == F.col("doc_id") % 2, 2).otherwise(1).alias("rel"))


SQL_QRELS = f"""qrels AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id, CASE WHEN q.vec_id % 2 = d.vec_id % 2 THEN 2 ELSE 1 END AS rel
  FROM embeddings q JOIN embeddings d ON q.label = d.label AND q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0)"""
