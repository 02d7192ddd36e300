"""Ranking metrics over a run (query_id, doc_id, rk) and judgements (query_id, doc_id, rel).

Two populations, as usual in evaluation tools: nDCG, MAP, recall and precision are averaged over queries that are in
both the run and the judgements; reciprocal rank and hit over all judged queries that have a relevant document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """The run with rel (0 if not judged)."""
    return run.join(qrels, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def ideal_gain(qrels: DataFrame, ks: list[int]) -> DataFrame:
    """Per query: the number of relevant documents and the best reachable discounted gain at each k."""
    w = Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")
    ranked = qrels.withColumn("ik", F.row_number().over(w))
    gain = lambda k: F.sum(F.when((F.col("ik") <= k) & (F.col("rel") > 0), F.col("rel") / F.log2(F.col("ik") + 1.0)).otherwise(0.0)).alias(f"idcg_{k}")
    return ranked.groupBy("query_id").agg(F.sum((F.col("rel") > 0).cast("long")).alias("n_rel"), *map(gain, ks))


def per_query(run: DataFrame, qrels: DataFrame, ks: list[int]) -> DataFrame:
    """One row per judged query: in_run, n_rel and each metric at each k, as columns like ndcg_10."""
    w = Window.partitionBy("query_id").orderBy("rk").rowsBetween(Window.unboundedPreceding, 0)
    hit = (F.col("rel") > 0).cast("long")
    rows = judged(run, qrels).withColumn("good", hit).withColumn("precise", F.sum(hit).over(w) / F.col("rk"))
    aggs: list[Column] = []
    for k in ks:
        top = F.col("rk") <= k
        aggs += [
            F.sum(F.when(top & (F.col("rel") > 0), F.col("rel") / F.log2(F.col("rk") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.sum(F.when(top & (F.col("good") == 1), F.col("precise")).otherwise(0.0)).alias(f"ap_{k}"),
            F.sum(F.when(top, F.col("good")).otherwise(0)).alias(f"found_{k}"),
            F.min(F.when(top & (F.col("good") == 1), F.col("rk"))).alias(f"first_{k}"),
        ]
    seen = rows.groupBy("query_id").agg(F.lit(True).alias("in_run"), *aggs)
    both = ideal_gain(qrels, ks).join(seen, "query_id", "left")
    out = [F.col("query_id"), F.coalesce("in_run", F.lit(False)).alias("in_run"), F.col("n_rel")]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    for k in ks:
        out += [
            F.when(F.col("in_run"), zero(F.try_divide(F.col(f"dcg_{k}"), F.col(f"idcg_{k}")))).alias(f"ndcg_{k}"),
            F.when(F.col("in_run"), zero(F.try_divide(F.col(f"ap_{k}"), F.col("n_rel")))).alias(f"map_{k}"),
            F.when(F.col("in_run"), zero(F.try_divide(F.col(f"found_{k}"), F.col("n_rel")))).alias(f"recall_{k}"),
            F.when(F.col("in_run"), F.col(f"found_{k}") / F.lit(k)).alias(f"p_{k}"),
            F.when(F.col("n_rel") > 0, zero(1.0 / F.col(f"first_{k}"))).alias(f"mrr_{k}"),
            F.when(F.col("n_rel") > 0, F.col(f"first_{k}").isNotNull().cast("double")).alias(f"hit_{k}"),
        ]
    return both.select(*out)


NAMES = {"ndcg": "nDCG", "map": "MAP", "recall": "Recall", "p": "P", "mrr": "MRR", "hit": "Hit"}


def macro(per_query_rows: DataFrame, ks: list[int]) -> DataFrame:
    """(metric like nDCG@10, value): means over the population of each metric."""
    columns = [f"{m}_{k}" for m in NAMES for k in ks]
    means = per_query_rows.agg(*[F.avg(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(f"{NAMES[m]}@{k}").alias("metric"), F.col(f"{m}_{k}").alias("value")) for m in NAMES for k in ks])
    return means.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def metric_name(name: Column) -> Column:
    """The usual spelling of a metric's name; null if it names no metric."""
    family = F.regexp_extract(name, r"^(nDCG|NDCG|MAP|MRR|Recall|Hit|Accuracy|P)@(\d+)$", 1)
    known = F.when(family == "NDCG", "nDCG").when(family == "Accuracy", "Hit").otherwise(family)
    return F.when(family != "", F.concat(known, F.lit("@"), F.regexp_extract(name, r"@(\d+)$", 1)))


def compared(claimed: DataFrame, computed: DataFrame, tolerance: float = 0.01, set_tolerance: float = 0.02) -> DataFrame:
    """claimed (metric, target) against computed (metric, value): status PASS, FAIL or MISSING."""
    names = claimed.withColumn("metric", F.coalesce(metric_name(F.col("metric")), F.col("metric")))
    tol = F.when(F.col("metric").rlike("^(Recall|Hit)@"), F.lit(set_tolerance)).otherwise(F.lit(tolerance))
    status = F.when(F.col("value").isNull(), "MISSING").when(F.abs(F.col("value") - F.col("target")) <= tol, "PASS").otherwise("FAIL")
    return names.join(computed, "metric", "left").withColumn("tolerance", tol).withColumn("status", status)


def primary(computed: DataFrame, name: str) -> DataFrame:
    """(primary_value): the value of the named metric, in any spelling; an error if it was not computed."""
    wanted = computed.where(F.col("metric") == F.coalesce(metric_name(F.lit(name)), F.lit(name))).agg(F.max("value").alias("v"))
    return wanted.select(F.coalesce("v", F.raise_error(F.lit(f"{name} was not computed")).cast("double")).alias("primary_value"))


def verdict(judged: DataFrame) -> DataFrame:
    """(ok, n_pass, n_fail, n_missing) of compared metrics: ok if none failed or is missing."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1))
    return judged.agg((n("PASS") == F.count("*")).alias("ok"), n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("MISSING").alias("n_missing"))


# Sessions: ids in retrieved order against a set of gold ids.


def session_recall(ids: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(ids, 1, k), gold)) / F.size(F.array_distinct(gold)))


def session_hit_all(ids: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) > 0, (F.size(F.array_except(gold, F.slice(ids, 1, k))) == 0).cast("double"))


def session_ndcg(ids: Column, gold: Column, k: int) -> Column:
    """Binary gain; the ideal has min(gold, k) hits in front."""
    top = F.slice(ids, 1, k)
    gains = F.transform(top, lambda x, i: F.when(F.array_contains(gold, x), 1.0 / F.log2(i + 2.0)).otherwise(F.lit(0.0)))
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.size(gold), F.lit(k))), lambda i: 1.0 / F.log2(i + 1.0))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(gold) > 0, F.coalesce(F.try_divide(add(gains), add(ideal)), F.lit(0.0)))


def gold_rank(ids: Column, gold: Column) -> Column:
    """First place, from 1, of any gold id; null if there is none."""
    places = F.filter(F.transform(ids, lambda x, i: F.when(F.array_contains(gold, x), i + 1)), lambda p: p.isNotNull())
    return F.array_min(places)
