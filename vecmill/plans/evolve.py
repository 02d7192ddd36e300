"""The bounded retrieve-diagnose-adjust loop over all questions at once, and analytics of its log."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.functions import text as T
from vecmill.operators import analytics, guards, loop, memory, sessions, trace
from vecmill.plans import base
from vecmill.plans.base import r
from vecmill.plans.evolve_sql import ROUNDS, K, sql_evolve
from vecmill.plans.memory_sql import CUED, GAPS, SAID, TASKS, sql_memory
from vecmill.plans.registry import query
from vecmill.plans.texts import sql_list
from vecmill.session import table


def _run(spark, sf_dir):
    u = base.units(spark, sf_dir)
    corpus = u.select(F.col("vec_id").alias("doc_id"), F.col("u").alias("e")).join(base.dated(spark, sf_dir), "doc_id", "left")
    # dates are stretched by 40, so that thresholds of months apply to the month that the events span
    corpus = corpus.withColumn("time_days", (F.col("time_days") - 738886) * 40)
    return loop.run(base.queries_of(u), corpus, k=K, max_rounds=ROUNDS)


_LOOP = sql_evolve()


@query("evolve_loop", f"WITH {_LOOP} SELECT query_id, doc_id, rk, {r('score')} AS score FROM evidence")
def evolve_loop(spark, sf_dir):
    """Final evidence of each question."""
    hits = _run(spark, sf_dir).evidence
    return hits.select("query_id", "doc_id", F.col("rk").cast("long").alias("rk"), S.steady(F.col("score")).alias("score"))


@query("evolve_log", f"WITH {_LOOP} SELECT query_id, round, gap, slot, accepted, why, array_to_string(top, ',') AS top FROM log")
def evolve_log(spark, sf_dir):
    """One row per question and round: gap, slot, whether the change was kept, reason, and the ids on top."""
    log = _run(spark, sf_dir).log
    return log.select("query_id", "round", "gap", "slot", "accepted", "why", F.array_join(F.col("top").cast("array<string>"), ",").alias("top"))


@query("slot_adoption", f"WITH {_LOOP} SELECT coalesce(slot, 'none') AS slot, why, round, count(*) AS n FROM log GROUP BY ALL")
def slot_adoption(spark, sf_dir):
    """How often each slot was changed, for which reason, in which round."""
    log = _run(spark, sf_dir).log
    return analytics.adoption(log)


@query("evolve_documents", f"WITH {_LOOP} SELECT query_id, document FROM papers")
def evolve_documents(spark, sf_dir):
    """The policy document that each question ends with."""
    return _run(spark, sf_dir).documents


def talks(spark, sf_dir, cued=False):
    """Questions: the first turn of each conversation. Texts: its later turns, forty days apart.

    cued: every second conversation is asked a question without words to bind, of which all of its texts but one speak;
    questions have tasks in turn, and texts are 120 days apart.
    """
    c = table(spark, sf_dir, "conversations")
    first = c.where("turn = 0").select(F.col("conv_id").alias("query_id"), "text")
    vectors = sessions.hashed_vectors(first, "query_id", "text").withColumnRenamed("e", "q0")
    odd = F.lit(cued) & (F.col("query_id") % 2 == 1)
    task = F.get(F.array(*map(F.lit, TASKS)), (F.floor(F.col("query_id") / 2) % 3).cast("int") if cued else F.lit(0))
    questions = first.select("query_id", F.when(odd, CUED).otherwise(F.col("text")).alias("question"), task.alias("task")).join(vectors, "query_id").withColumn("query_days", F.lit(738640.0))
    said = F.when((F.col("turn") > 1) & (F.col("conv_id") % 2 == 1) & F.lit(cued), F.concat("text", F.lit(SAID))).otherwise(F.col("text"))
    later = c.where("turn > 0").select(F.col("conv_id").alias("query_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), said.alias("text"), (F.lit(738000.0) + F.col("turn") * GAPS[cued]).alias("time_days"))
    texts = later.join(sessions.hashed_vectors(later, "doc_id", "text"), "doc_id")
    return questions, texts


_MEMORY, _CUED = sql_memory(), sql_memory(cued=True)


@query("memory_loop", f"WITH {_MEMORY} SELECT query_id, doc_id, rk, {r('score')} AS score FROM evidence")
def memory_loop(spark, sf_dir):
    """Final evidence of each question among its own texts."""
    hits, _ = memory.evolve(*talks(spark, sf_dir), k=5)
    return hits.select("query_id", "doc_id", F.col("rk").cast("long").alias("rk"), S.steady(F.col("score")).alias("score"))


@query("memory_log", f"WITH {_MEMORY} SELECT query_id, round, covers, cause, slot, accepted, why, hop, {r('proxy')} AS proxy FROM log")
def memory_log(spark, sf_dir):
    """What each round found and changed, and whether the change was kept."""
    _, log = memory.evolve(*talks(spark, sf_dir), k=5)
    return log.drop("top").withColumn("proxy", S.steady(F.col("proxy")))


@query("memory_tasks", f"WITH {_CUED} SELECT e.query_id, doc_id, rk, {r('score')} AS score, task FROM evidence e JOIN asked USING (query_id)")
def memory_tasks(spark, sf_dir):
    """Final evidence where the way of ranking depends on the question's task: the review's, by time, or several hops."""
    questions, texts = talks(spark, sf_dir, True)
    hits = memory.run(questions, texts, k=5).evidence.join(questions.select("query_id", "task"), "query_id")
    return hits.select("query_id", "doc_id", F.col("rk").cast("long").alias("rk"), S.steady(F.col("score")).alias("score"), "task")


@query("memory_documents", f"WITH {_CUED} SELECT query_id, document FROM papers")
def memory_documents(spark, sf_dir):
    """The policy document that each question ends with."""
    return memory.run(*talks(spark, sf_dir, True), k=5).documents


FORCED = ["none", "backbone", "slots", "passage", "lost"]
_FORCED = f"({sql_list(FORCED)})[1 + a.query_id % 5]"


def forced(texts):
    """An editor that breaks one rule, by the number of the question, in every round: it changes text beside the slots, two slots,
    puts the middle of one of the question's texts into the chosen slot, or takes a slot's mark away."""
    piece = guards.pieces(texts, ["query_id"]).groupBy("query_id").agg(F.min("piece").alias("piece"))

    def edit(rows):
        d, slot = F.col("document"), F.upper("slot")
        in_slot = lambda name, body: F.when(slot == name, T.with_slot(d, name, body))
        other = F.when(slot == "RANK", T.with_slot(d, "FILTER", "changed too")).otherwise(T.with_slot(d, "RANK", "changed too, for $1 \\ 2"))
        copy = F.concat(F.lit("as said: "), F.upper(F.col("piece")))
        broken = F.when(F.col("query_id") % 5 == 1, F.concat(d, F.lit("more"))).when(F.col("query_id") % 5 == 2, other)
        broken = broken.when(F.col("query_id") % 5 == 3, F.coalesce(*[in_slot(n, copy) for n in T.SLOTS], d)).when(F.col("query_id") % 5 == 4, F.replace(d, F.lit("<!-- EVOLVE:RANK:END -->"), F.lit("")))
        return rows.join(piece, "query_id", "left").withColumn("document", F.coalesce(broken, d)).drop("piece")

    return edit


_BROKEN = sql_memory(cued=True, forced=f"CASE WHEN {_FORCED} <> 'passage' OR a.query_id IN (SELECT query_id FROM pieces) THEN {_FORCED} ELSE 'none' END")


@query("guarded_log", f"WITH {_BROKEN} SELECT query_id, round, slot, accepted, why FROM log")
def guarded_log(spark, sf_dir):
    """The log of a loop whose documents an editor breaks, in a way for each question: such changes are rolled back."""
    questions, texts = talks(spark, sf_dir, True)
    return memory.run(questions, texts, k=5, edit=forced(texts)).log.select("query_id", "round", "slot", "accepted", "why")


_TRACED = f"""{_CUED}, tops AS ({' UNION ALL '.join(f'SELECT query_id, {n} AS round, list(doc_id ORDER BY rk) AS top FROM hits{n} GROUP BY query_id' for n in (1, 2, 3))}),
t0 AS (SELECT l.*, top, nullif(list_position(top, query_id * 100 + 1), 0) AS gold_rank, CASE WHEN starts_with(why, 'dead_end') THEN 'query-dead-end' ELSE coalesce(slot, 'stop') END AS action FROM log l JOIN tops USING (query_id, round)),
t1 AS (SELECT *, list_filter([CASE WHEN gold_rank <= 3 AND action = 'query' THEN 'gold in top 3, still query' END, CASE WHEN gold_rank > 5 AND action = 'stop' THEN 'gold beyond 5, stopped' END, CASE WHEN gold_rank > 3 AND gold_rank <= 10 AND action = 'stop' THEN 'gold in 4 to 10, stopped' END, CASE WHEN action = 'query-dead-end' THEN 'dead end' END], lambda x: x IS NOT NULL) AS flags FROM t0),
t2 AS (SELECT *, 'round ' || round || ': gold ' || coalesce(gold_rank::VARCHAR, 'absent') || ', top ' || array_to_string(top, ',') || '; covered ' || CASE WHEN covers THEN 'yes' ELSE 'no' END || ', cause ' || cause || ', proxy ' || printf('%.3f', floor(proxy * 1000 + 0.500001) / 1000) || '; ' || coalesce(slot, 'stop') || ' (' || why || ') ' || CASE WHEN accepted THEN 'kept' ELSE 'rolled back' END
  || CASE WHEN slot = 'query' AND hop <> '' THEN chr(10) || '  searched for: ' || hop ELSE '' END || CASE WHEN len(flags) > 0 THEN chr(10) || '  flags: ' || array_to_string(flags, ', ') ELSE '' END AS line FROM t1)"""


@query("memory_traces", f"WITH {_TRACED} SELECT query_id, 'question ' || query_id || ': ' || trim(regexp_replace(any_value(question), '\\s+', ' ', 'g'))[1:60] || chr(10) || string_agg(line, chr(10) ORDER BY round) || chr(10) || 'end: gold ' || coalesce(arg_max(coalesce(gold_rank::VARCHAR, 'absent'), round), 'absent') AS trace FROM t2 JOIN asked USING (query_id) GROUP BY query_id")
def memory_traces(spark, sf_dir):
    """What the loop did for each question, in words; gold is the conversation's second turn."""
    questions, texts = talks(spark, sf_dir, True)
    gold = questions.select("query_id", (F.col("query_id") * 100 + 1).alias("doc_id"))
    return trace.traces(memory.run(questions, texts, k=5).log, gold, questions)
