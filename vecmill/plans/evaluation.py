"""Ranking metrics, session metrics and the comparison of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.operators import analytics, harness, metrics, search
from vecmill.plans import base
from vecmill.plans.base import r, sql_hits
from vecmill.plans.registry import query

KS = [1, 3, 5, 10]

_JUDGED = f"""{sql_hits(11)}, {base.SQL_QRELS},
run AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rk FROM hits WHERE query_id <> doc_id),
jr AS (SELECT query_id, doc_id, rk, coalesce(rel, 0) AS rel, sum((coalesce(rel, 0) > 0)::INT) OVER (PARTITION BY query_id ORDER BY rk) / rk::DOUBLE AS prec FROM run LEFT JOIN qrels USING (query_id, doc_id)),
ideal AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS ik FROM qrels)"""


def _per_query_sql() -> str:
    ideal = ", ".join(f"sum(CASE WHEN ik <= {k} THEN rel / log2(ik + 1) ELSE 0 END) AS i{k}" for k in KS)
    seen = ", ".join(f"sum(CASE WHEN rk <= {k} THEN rel / log2(rk + 1) ELSE 0 END) AS d{k}, sum(CASE WHEN rk <= {k} AND rel > 0 THEN prec ELSE 0 END) AS a{k}, sum((rk <= {k} AND rel > 0)::INT) AS f{k}, min(CASE WHEN rk <= {k} AND rel > 0 THEN rk END) AS m{k}" for k in KS)
    out = ", ".join(f"d{k} / i{k} AS ndcg_{k}, a{k} / n_rel AS map_{k}, f{k} / n_rel::DOUBLE AS recall_{k}, f{k} / {k}::DOUBLE AS p_{k}, coalesce(1.0::DOUBLE / m{k}, 0) AS mrr_{k}, (m{k} IS NOT NULL)::INT::DOUBLE AS hit_{k}" for k in KS)
    return f"""{_JUDGED}, idl AS (SELECT query_id, count(*) AS n_rel, {ideal} FROM ideal GROUP BY query_id), seen AS (SELECT query_id, {seen} FROM jr GROUP BY query_id),
pq AS (SELECT query_id, n_rel, {out} FROM idl JOIN seen USING (query_id))"""


_PQ = _per_query_sql()
_FAMILY = {"ndcg": "ir_ndcg", "map": "ir_map", "recall": "ir_recall", "p": "ir_precision", "mrr": "ir_mrr", "hit": "ir_hit"}


def run_of(spark, sf_dir, k=10):
    from pyspark.sql import Window

    hits = base.hits(spark, sf_dir, k + 1).where("query_id <> doc_id").drop("rk")
    w = Window.partitionBy("query_id").orderBy(F.desc("sim"), "doc_id")
    return hits.withColumn("rk", F.row_number().over(w))


def _per_query(spark, sf_dir):
    return metrics.per_query(run_of(spark, sf_dir).select("query_id", "doc_id", "rk"), base.qrels(spark, sf_dir), KS)


def _metric_query(family: str, name: str) -> None:
    columns = [f"{family}_{k}" for k in KS]

    @query(name, f"WITH {_PQ} SELECT query_id, {', '.join(f'{r(c)} AS {c}' for c in columns)} FROM pq")
    def each(spark, sf_dir):
        return _per_query(spark, sf_dir).select("query_id", *[S.steady(F.col(c)).alias(c) for c in columns])


for _family, _name in _FAMILY.items():
    _metric_query(_family, _name)

_MACRO = "macro AS (" + " UNION ALL ".join(f"SELECT '{metrics.NAMES[m]}@{k}' AS metric, avg({m}_{k}) AS value FROM pq" for m in metrics.NAMES for k in KS) + ")"


@query("ir_macro_summary", f"WITH {_PQ}, {_MACRO} SELECT metric, {r('value', 4)} AS value FROM macro")
def ir_macro_summary(spark, sf_dir):
    return metrics.macro(_per_query(spark, sf_dir), KS).select("metric", S.steady(F.col("value"), 4).alias("value"))


CLAIMED = [("nDCG@10", 0.15), ("NDCG@5", 0.1), ("MAP@10", 0.5), ("Recall@10", 0.03), ("Accuracy@10", 1.0), ("MRR@10", 0.2), ("P@7", 0.3)]


@query("claimed_vs_computed", f"""WITH {_PQ}, {_MACRO}, c(metric, target) AS (VALUES {', '.join(f"('{m}', {t}::DOUBLE)" for m, t in CLAIMED)}),
n AS (SELECT replace(replace(metric, 'NDCG', 'nDCG'), 'Accuracy', 'Hit') AS metric, target FROM c)
SELECT n.metric, target, {r('value', 4)} AS value, CASE WHEN value IS NULL THEN 'MISSING' WHEN abs(value - target) <= CASE WHEN n.metric LIKE 'Recall%' OR n.metric LIKE 'Hit%' THEN 0.02 ELSE 0.01 END THEN 'PASS' ELSE 'FAIL' END AS status
FROM n LEFT JOIN macro USING (metric)""")
def claimed_vs_computed(spark, sf_dir):
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("target")) for m, t in CLAIMED])
    claimed = spark.range(1).select(F.explode(rows).alias("c")).select("c.*")
    out = metrics.compared(claimed, metrics.macro(_per_query(spark, sf_dir), KS))
    return out.select("metric", "target", S.steady(F.col("value"), 4).alias("value"), "status")


# Two runs over the same questions: plain, and one that prefers hits of the query's label (a ranking policy).
# A hit's session is its id modulo 40; gold sessions are the two with the most judged documents of grade 2.

_RUNS = f"""{sql_hits(30)}, base_run AS (SELECT query_id, doc_id, doc_id % 40 AS session_id, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS rk, label = query_label AS alike, sim FROM hits WHERE query_id <> doc_id),
evo_run AS (SELECT query_id, doc_id, session_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sim + CASE WHEN alike THEN 0.05::DOUBLE ELSE 0 END, 9) DESC, doc_id) AS rk FROM base_run),
both_runs AS (SELECT 'dense' AS run, query_id, session_id, rk FROM base_run UNION ALL SELECT 'evolved', query_id, session_id, rk FROM evo_run),
firsts AS (SELECT run, query_id, session_id, min(rk) AS rk FROM both_runs GROUP BY ALL),
lists AS (SELECT run, query_id, list(session_id ORDER BY rk) AS ids FROM firsts GROUP BY run, query_id),
{base.SQL_QRELS}, gc AS (SELECT query_id, doc_id % 40 AS session_id, count(*) AS n FROM qrels WHERE rel = 2 GROUP BY ALL),
gr AS (SELECT query_id, session_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, session_id) AS p FROM gc),
golds AS (SELECT query_id, list_sort(list(session_id)) AS gold FROM gr WHERE p <= 2 GROUP BY query_id),
sess AS (SELECT l.run, l.query_id, 'type' || (l.query_id // {base.EVERY}) % 3 AS question_type, ids, coalesce(gold, []) AS gold FROM lists l LEFT JOIN golds USING (query_id)),
sm AS (SELECT run, query_id, question_type, {', '.join(f"CASE WHEN len(gold) > 0 THEN len(list_intersect(ids[1:{k}], gold)) / len(gold)::DOUBLE END AS recall_{k}, CASE WHEN len(gold) > 0 THEN (len(list_intersect(ids[1:{k}], gold)) = len(gold))::INT::DOUBLE END AS hit_all_{k}, CASE WHEN len(gold) > 0 THEN coalesce(list_sum([CASE WHEN list_contains(gold, ids[i]) THEN 1 / log2(i + 1) ELSE 0 END FOR i IN range(1, least({k}, len(ids)) + 1)]), 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least({k}, len(gold)) + 1)]) END AS ndcg_{k}" for k in (5, 10))},
  list_min([i FOR i IN range(1, len(ids) + 1) IF list_contains(gold, ids[i])]) AS gold_rank FROM sess)"""


def _session_rows(spark, sf_dir):
    """run, query_id, question_type, ids, gold."""
    hits = base.hits(spark, sf_dir, 30).where("query_id <> doc_id").drop("rk").withColumn("session_id", F.col("doc_id") % 40)
    dense = search.top_k(hits, ["query_id"], "sim", "doc_id", 30)
    liked = hits.withColumn("score", F.round(F.col("sim") + F.when(F.col("label") == F.col("query_label"), 0.05).otherwise(0.0), 9))
    evolved = search.top_k(liked, ["query_id"], "score", "doc_id", 30)
    both = dense.select(F.lit("dense").alias("run"), "query_id", "session_id", "rk").unionByName(evolved.select(F.lit("evolved").alias("run"), "query_id", "session_id", "rk"))
    firsts = both.groupBy("run", "query_id", "session_id").agg(F.min("rk").alias("rk"))
    lists = firsts.groupBy("run", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "session_id"))), lambda x: x["session_id"]).alias("ids"))
    counts = base.qrels(spark, sf_dir).where("rel = 2").groupBy("query_id", (F.col("doc_id") % 40).alias("session_id")).agg(F.count("*").alias("n"))
    gold = search.top_k(counts, ["query_id"], "n", "session_id", 2).groupBy("query_id").agg(F.array_sort(F.collect_list("session_id")).alias("gold"))
    kind = F.concat(F.lit("type"), (F.floor(F.col("query_id") / base.EVERY) % 3).cast("string"))
    return lists.join(gold, "query_id", "left").withColumn("gold", F.coalesce("gold", F.array().cast("array<bigint>"))).withColumn("question_type", kind)


def _session_metrics(spark, sf_dir):
    ids, gold = F.col("ids"), F.col("gold")
    columns = {f"{name}_{k}": f(ids, gold, k) for k in (5, 10) for name, f in (("recall", metrics.session_recall), ("hit_all", metrics.session_hit_all), ("ndcg", metrics.session_ndcg))}
    return _session_rows(spark, sf_dir).withColumns(columns).withColumn("gold_rank", metrics.gold_rank(ids, gold).cast("long")).drop("ids", "gold")


_SM = [f"{m}_{k}" for k in (5, 10) for m in ("recall", "ndcg", "hit_all")]


@query("session_metrics", f"WITH {_RUNS} SELECT run, query_id, question_type, coalesce(gold_rank, 0)::BIGINT AS gold_rank, {', '.join(f'{r(c)} AS {c}' for c in _SM)} FROM sm")
def session_metrics(spark, sf_dir):
    return _session_metrics(spark, sf_dir).select("run", "query_id", "question_type", F.coalesce("gold_rank", F.lit(0)).alias("gold_rank"), *[S.steady(F.col(c)).alias(c) for c in _SM])


@query("type_summary", f"""WITH {_RUNS} SELECT run, coalesce(question_type, 'all') AS question_type, count(*) AS n, {', '.join(f'{r(f"avg({c})", 4)} AS {c}' for c in _SM)} FROM sm GROUP BY GROUPING SETS ((run, question_type), (run))""")
def type_summary(spark, sf_dir):
    return analytics.summary(_session_metrics(spark, sf_dir), ["run"], "question_type", _SM).select("run", "question_type", "n", *[S.steady(F.col(c), 4).alias(c) for c in _SM])


@query("paired_runs", f"""WITH {_RUNS}, p AS (SELECT a.query_id, a.question_type, b.recall_10 - a.recall_10 AS d, a.gold_rank AS ra, b.gold_rank AS rb FROM sm a JOIN sm b USING (query_id) WHERE a.run = 'dense' AND b.run = 'evolved')
SELECT question_type, count(*) AS n, sum((d > 1e-9)::INT)::BIGINT AS better, sum((d < -1e-9)::INT)::BIGINT AS worse, sum((abs(d) <= 1e-9)::INT)::BIGINT AS same, sum((rb < ra)::INT)::BIGINT AS up, sum((rb > ra)::INT)::BIGINT AS down FROM p GROUP BY question_type""")
def paired_runs(spark, sf_dir):
    m = _session_metrics(spark, sf_dir)
    return analytics.paired(m.where("run = 'dense'"), m.where("run = 'evolved'"), "query_id", "question_type", "recall_10")


# Answers to the questions of the evolved run: a question is answered right where gold is among the first three, or where
# it is divisible by 150; every second one whose id is divisible by 100 has none.

_TYPES = ["type0", "type1", "type2"]
_ANSWERS = f"""{_RUNS}, answers AS (SELECT query_id, 'q' || query_id || CASE WHEN query_id % 100 = 0 THEN '_abs' ELSE '' END AS question_id, question_type, query_id % 200 = 0 AS abstention, {', '.join(_SM)}, gold_rank, CASE WHEN query_id % 350 <> 0 THEN coalesce(gold_rank <= 3, false) OR query_id % 150 = 0 END AS qa_correct,
  query_id % 250 = 0 AS reader_abstained, CASE WHEN query_id % 3 = 0 THEN ' I do not know that.' ELSE 'It was session ' || coalesce(gold_rank::VARCHAR, '?') END AS hypothesis, CASE WHEN query_id % 4 <> 1 THEN coalesce(gold_rank <= 5, false) END AS sufficient FROM sm WHERE run = 'evolved')"""


def _answers(spark, sf_dir):
    m, c = _session_metrics(spark, sf_dir).where("run = 'evolved'"), F.col
    near = lambda k: F.coalesce(c("gold_rank") <= k, F.lit(False))
    return m.select(
        "query_id", F.concat(F.lit("q"), c("query_id").cast("string"), F.when(c("query_id") % 100 == 0, "_abs").otherwise("")).alias("question_id"), "question_type", (c("query_id") % 200 == 0).alias("abstention"), *_SM, "gold_rank",
        F.when(c("query_id") % 350 != 0, near(3) | (c("query_id") % 150 == 0)).alias("qa_correct"), (c("query_id") % 250 == 0).alias("reader_abstained"),
        F.when(c("query_id") % 3 == 0, " I do not know that.").otherwise(F.concat(F.lit("It was session "), F.coalesce(c("gold_rank").cast("string"), F.lit("?")))).alias("hypothesis"), F.when(c("query_id") % 4 != 1, near(5)).alias("sufficient"),
    )


_VALUES = ["accuracy", "abstention_accuracy", *_SM]
_REPORT = " UNION ALL ".join(f"SELECT '{m}' AS metric, 'all' AS question_type, avg({m}) AS value, count({m}) AS n FROM v" for m in _VALUES)
_BY_TYPE = " UNION ALL ".join(f"SELECT '{m}' AS metric, question_type, avg({m}) AS value, count({m}) AS n FROM v WHERE {m} IS NOT NULL{keep} GROUP BY question_type" for m, keep in (("accuracy", " AND question_type IN ('type0', 'type1', 'type2')"), ("recall_5", ""), ("hit_all_10", "")))


@query("qa_report", f"""WITH {_ANSWERS}, v AS (SELECT question_type, qa_correct::INT AS accuracy, CASE WHEN abstention OR contains(question_id, '_abs') THEN qa_correct::INT END AS abstention_accuracy, {', '.join(f'CASE WHEN NOT abstention THEN {c} END AS {c}' for c in _SM)} FROM answers),
t AS ({_BY_TYPE}) SELECT metric, question_type, {r('value', 4)} AS value, n FROM t UNION ALL SELECT metric, question_type, {r('value', 4)}, n FROM ({_REPORT}) UNION ALL SELECT 'task_averaged_accuracy', 'all', {r('avg(value)', 4)}, count(*) FROM t WHERE metric = 'accuracy'""")
def qa_report(spark, sf_dir):
    """Accuracy over all questions, by type, averaged over types and of those without an answer; retrieval over the others."""
    return harness.report(_answers(spark, sf_dir), _TYPES).withColumn("value", S.steady(F.col("value"), 4))


@query("failure_modes", f"""WITH {_ANSWERS} SELECT CASE WHEN reader_abstained THEN 'gate_abstain' WHEN starts_with(lower(trim(hypothesis)), 'i do not know') THEN 'reader_idk' ELSE 'answered_wrong' END AS mode, question_type, count(*) AS n
FROM answers WHERE NOT abstention AND coalesce(gold_rank <= 10, false) AND NOT coalesce(qa_correct, false) GROUP BY ALL""")
def failure_modes(spark, sf_dir):
    """Wrong answers to questions whose evidence was retrieved: here, a gold session among the first ten."""
    c = F.col
    mode = harness.failure_mode(c("abstention"), (c("gold_rank") <= 10).cast("double"), c("qa_correct"), c("reader_abstained"), c("hypothesis"))
    return _answers(spark, sf_dir).select(mode.alias("mode"), "question_type").where("mode is not null").groupBy("mode", "question_type").agg(F.count("*").alias("n"))


@query("sufficiency_table", f"""WITH {_ANSWERS}, a AS (SELECT sufficient, CASE WHEN starts_with(lower(trim(hypothesis)), 'i do not know') OR reader_abstained THEN 'idk' WHEN qa_correct THEN 'correct' END AS answer FROM answers WHERE sufficient IS NOT NULL)
SELECT sufficient, answer, count(*) AS n FROM a WHERE answer IS NOT NULL GROUP BY ALL""")
def sufficiency_table(spark, sf_dir):
    return harness.sufficiency(_answers(spark, sf_dir))


@query("gold_movement", f"""WITH {_RUNS}, p AS (SELECT a.question_type, a.gold_rank AS ra, b.gold_rank AS rb FROM sm a JOIN sm b USING (query_id) WHERE a.run = 'dense' AND b.run = 'evolved')
SELECT question_type, CASE WHEN ra IS NULL AND rb IS NOT NULL THEN 'late_in' WHEN rb < ra THEN 'up' WHEN rb > ra THEN 'down' WHEN rb = ra THEN 'same' ELSE 'absent' END AS movement, count(*) AS n FROM p GROUP BY ALL""")
def gold_movement(spark, sf_dir):
    """How the first gold session moved between the plain and the evolved run."""
    m = _session_metrics(spark, sf_dir)
    both = m.where("run = 'dense'").select("query_id", "question_type", F.col("gold_rank").alias("a")).join(m.where("run = 'evolved'").select("query_id", F.col("gold_rank").alias("b")), "query_id")
    return both.groupBy("question_type", F.coalesce(harness.movement(F.col("a"), F.col("b")), F.lit("absent")).alias("movement")).agg(F.count("*").alias("n"))


@query("paired_runs_left", f"""WITH {_RUNS}, p AS (SELECT a.question_type, b.recall_10 - a.recall_10 AS d, a.gold_rank AS ra, b.gold_rank AS rb, b.query_id IS NULL AS gone FROM sm a LEFT JOIN (SELECT * FROM sm WHERE run = 'evolved' AND query_id % 150 <> 0) b USING (query_id) WHERE a.run = 'dense')
SELECT question_type, count(*) AS n, sum(coalesce(d > 1e-9, false)::INT)::BIGINT AS better, sum(coalesce(d < -1e-9, false)::INT)::BIGINT AS worse, sum(coalesce(abs(d) <= 1e-9, false)::INT)::BIGINT AS same, sum(coalesce(rb < ra, false)::INT)::BIGINT AS up, sum(coalesce(rb > ra, false)::INT)::BIGINT AS down, sum(gone::INT)::BIGINT AS absent FROM p GROUP BY question_type""")
def paired_runs_left(spark, sf_dir):
    """As paired_runs, with a second run that lacks every third question."""
    m = _session_metrics(spark, sf_dir)
    return analytics.paired(m.where("run = 'dense'"), m.where("run = 'evolved' and query_id % 150 <> 0"), "query_id", "question_type", "recall_10", how="left")


@query("picked_questions", f"""WITH {_ANSWERS}, w AS (SELECT unnest(['q50', 'q100_abs', 'q150', 'q7', 'none']) AS question_id)
SELECT w.question_id, a.question_type, CASE WHEN a.question_id IS NULL THEN 'missing' WHEN contains(w.question_id, '_abs') THEN 'abstention' ELSE 'found' END AS status FROM w LEFT JOIN answers a USING (question_id) WHERE a.question_type IS NULL OR a.question_type <> 'type2'""")
def picked_questions(spark, sf_dir):
    """Wanted ids among the questions of two types, and those that no question has."""
    wanted = spark.createDataFrame([(x,) for x in ("q50", "q100_abs", "q150", "q7", "none")], "question_id string")
    found, missing = harness.picked(_answers(spark, sf_dir), wanted)
    status = F.when(harness.is_abstention(F.col("question_id")), "abstention").otherwise("found")
    found = harness.of_types(found, ["type0", "type1"]).select("question_id", "question_type", status.alias("status"))
    return found.unionByName(missing.select("question_id", F.lit(None).cast("string").alias("question_type"), F.lit("missing").alias("status")))


@query("feature_counts", f"""WITH {_ANSWERS}, f AS (SELECT 'question_type' AS feature, question_type AS value FROM answers UNION ALL SELECT 'qa_correct', coalesce(qa_correct::VARCHAR, 'none') FROM answers UNION ALL SELECT 'gold_rank', coalesce(gold_rank::VARCHAR, 'none') FROM answers),
n AS (SELECT feature, value, count(*) AS n FROM f GROUP BY ALL) SELECT feature, value, n FROM n QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) <= 5""")
def feature_counts(spark, sf_dir):
    """The five most common values of each of three columns of the answers."""
    return harness.most_common(_answers(spark, sf_dir), ["question_type", "qa_correct", "gold_rank"], 5)


@query("gold_in_answer", f"""WITH {_ANSWERS} SELECT question_id, contains(lower(hypothesis), substr(lower('session ' || coalesce(gold_rank::VARCHAR, '?')), 1, 40)) AS has_gold FROM answers""")
def gold_in_answer(spark, sf_dir):
    gold = F.concat(F.lit(" Session "), F.coalesce(F.col("gold_rank").cast("string"), F.lit("?")), F.lit(" "))
    return _answers(spark, sf_dir).select("question_id", harness.holds_gold(F.col("hypothesis"), gold).alias("has_gold"))


@query("claims_verdict", f"""WITH {_PQ}, {_MACRO}, c(metric, target) AS (VALUES {', '.join(f"('{m}', {t}::DOUBLE)" for m, t in CLAIMED)}),
n AS (SELECT replace(replace(metric, 'NDCG', 'nDCG'), 'Accuracy', 'Hit') AS metric, target FROM c),
s AS (SELECT CASE WHEN value IS NULL THEN 'MISSING' WHEN abs(value - target) <= CASE WHEN n.metric LIKE 'Recall%' OR n.metric LIKE 'Hit%' THEN 0.02 ELSE 0.01 END THEN 'PASS' ELSE 'FAIL' END AS status FROM n LEFT JOIN macro USING (metric))
SELECT (SELECT {r('value', 4)} FROM macro WHERE metric = 'nDCG@10') AS primary_value, count(*) = count(*) FILTER (status = 'PASS') AS ok, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'MISSING') AS n_missing FROM s""")
def claims_verdict(spark, sf_dir):
    """The primary metric, and whether all claims about the run hold."""
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("target")) for m, t in CLAIMED])
    computed = metrics.macro(_per_query(spark, sf_dir), KS)
    judged = metrics.verdict(metrics.compared(spark.range(1).select(F.explode(rows).alias("c")).select("c.*"), computed))
    return judged.join(F.broadcast(metrics.primary(computed, "NDCG@10").select(S.steady(F.col("primary_value"), 4).alias("primary_value"))), F.lit(True))
