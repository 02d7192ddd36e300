"""Retrieve, diagnose, change one policy, retrieve again: at most `max_rounds` times, for all questions in one plan.

The state is a table with a row per question.  A question leaves the active table when it stops.  Each round is cut
off with a written table, so plans do not grow with the rounds and a lost executor repeats one round at most.  Ids may
be of any type.

A round's change is rendered into the slots of the question's policy document and checked there: nothing but the chosen
slot may change, it has to, and no piece of the given texts may stand in the document (`guards`).  A change that
breaks a rule is rolled back, and the question goes on with its old state.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.functions import vectors as V
from vecmill.operators import guards, policy, search, slots
from vecmill.session import written

STATE = ["query_id", "q0", "q", "beta", "gamma", "lam", "t_star", "sigma", "pos_ids", "soft_ids", "eta_soft", "used", "document"]
# Weights of the moved query.
BETA, GAMMA = 0.75, 0.15


class Evolved(NamedTuple):
    evidence: DataFrame  # (query_id, doc_id, sim, score, rk)
    log: DataFrame  # (query_id, round, gap, slot, accepted, why, top)
    documents: DataFrame  # (query_id, document)


def start(queries: DataFrame, id_type: str = "bigint", document: str = slots.DOCUMENT) -> DataFrame:
    """queries: (query_id, q). The state before the first round; id_type is that of the corpus' ids."""
    ids = F.array().cast(f"array<{id_type}>")
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    first = queries.select(
        "query_id", F.col("q").alias("q0"), "q", zero.alias("beta"), zero.alias("gamma"), zero.alias("lam"), none.alias("t_star"), none.alias("sigma"),
        ids.alias("pos_ids"), ids.alias("soft_ids"), zero.alias("eta_soft"), F.array().cast("array<string>").alias("used"),
    )
    return first.withColumn("document", slots.rendered(F.lit(document), bodies({n: F.col(n) for n in first.columns})))


def retrieve(state: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """Top k of each question under its state: (query_id, doc_id, sim, score, rk, e, time_days).

    While recency is off and nothing is penalised, a plain block search is enough.
    """
    plain = state.where("lam = 0 and eta_soft = 0")
    fused = state.where("lam > 0 or eta_soft > 0").select("query_id", "q", "lam", "t_star", "sigma", "soft_ids", "eta_soft")
    found = search.exact_search(plain.select("query_id", "q"), corpus.select("doc_id", "e"), k).withColumn("score", F.col("sim"))
    found = found.select("query_id", "doc_id", "sim", "score", "rk")
    if not fused.isEmpty():
        found = found.unionByName(search.fused_search(fused, corpus, k))
    return found.join(corpus, "doc_id")


def diagnosed(hits: DataFrame, state: DataFrame) -> DataFrame:
    """(query_id, gap, n_eff_time, n_eff_alias, top): the kind of gap of each question and its ids in order."""
    g_time = policy.time_gap(hits.join(state.select("query_id", "lam"), "query_id"), F.col("lam")).select("query_id", "g_time", F.col("n_eff").alias("n_eff_time"))
    g_alias = policy.alias_gap(hits if "cluster" in hits.columns else policy.two_means(hits)).select("query_id", "g_alias", F.col("n_eff").alias("n_eff_alias"))
    first = hits.groupBy("query_id").agg(
        F.min_by("sim", "rk").alias("top_sim"), F.min_by("time_days", "rk").alias("top_days"),
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "doc_id"))), lambda x: x["doc_id"]).alias("top"),
    )
    rows = first.join(g_time, "query_id", "left").join(g_alias, "query_id", "left").join(state.select("query_id", "t_star", "sigma", "pos_ids", "used"), "query_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    kind = policy.gap_kind(zero("g_time"), zero("g_alias"), policy.unanswerable_gap(F.col("top_sim")), F.col("top_sim"), policy.rank_closes(F.col("used"), F.col("top_days"), F.col("t_star"), F.col("sigma")), policy.query_closes(F.col("used"), F.col("top"), F.col("pos_ids")))
    return rows.select("query_id", kind.alias("gap"), zero("n_eff_time").alias("n_eff_time"), zero("n_eff_alias").alias("n_eff_alias"), "top")


def bodies(c: dict[str, Column]) -> dict[str, Column]:
    """The slots as they show the columns of a state."""
    used = lambda s: F.array_contains(c["used"], s)
    zero, one = F.lit(0.0), F.lit(1.0)
    return {
        "query": slots.query_body(used("query"), F.lit(""), zero, one, c["beta"], c["gamma"], F.size(c["pos_ids"]), F.size(c["soft_ids"])),
        "rank": slots.rank_body(used("rank"), c["lam"], c["eta_soft"], zero, c["t_star"], c["sigma"], F.size(c["soft_ids"]), F.lit(0)),
        "filter": F.lit(slots.FILTER_SAME),
    }


def moved(state: DataFrame, hits: DataFrame, actions: DataFrame, pieces: DataFrame | None = None, marks: DataFrame | None = None, edit: guards.Editor | None = None) -> DataFrame:
    """The state after the chosen slot of each question changed, with slot and broken (why it was rolled back, or null).

    actions: (query_id, gap, slot). Rocchio for query, recency and penalties for rank; the sides come from clusters for
    an alias gap, else from time.  A query slot without any side becomes a rank slot.  pieces, marks: of texts that must
    not be copied; edit: see `guards.settled`.
    """
    sided = policy.signals(hits.join(actions.select("query_id", "gap"), "query_id"))
    ids = lambda side: F.array_sort(F.array_compact(F.collect_list(F.when(F.col("side") == side, F.col("doc_id")))))
    sides = sided.groupBy("query_id").agg(F.max("t_star").alias("new_t"), F.max("sigma").alias("new_sigma"), ids("neg").alias("neg"), ids("pos").alias("pos"))
    weighted = S.with_softmax(sided.where("side is not null"), ["query_id", "side"], "sim", "w")
    means = V.mean_vectors(weighted, ["query_id", "side"], "e", "w", "m").groupBy("query_id").agg(*[F.max(F.when(F.col("side") == s, F.struct("m"))).alias(s[0]) for s in ("pos", "neg")])
    estimate = policy.recency_weight(sided.where("t_star is not null"))
    rows = state.join(actions.select("query_id", "slot"), "query_id").join(sides, "query_id", "left").join(means, "query_id", "left").join(estimate, "query_id", "left")
    c = F.col
    rows = rows.withColumn("slot", F.when((c("slot") == "query") & c("p").isNull() & c("n").isNull(), "rank").otherwise(c("slot")))
    is_rank = c("slot") == "rank"
    other = lambda new, old: F.when(F.coalesce(F.size(new), F.lit(0)) > 0, new).otherwise(old)
    empty = F.slice("soft_ids", 1, 0)
    rows = rows.withColumn("neg1", F.when(is_rank, other(c("neg"), c("soft_ids"))).otherwise(F.coalesce("neg", empty))).withColumn("pos1", F.when(is_rank, other(c("pos"), c("pos_ids"))).otherwise(F.coalesce("pos", empty)))
    rows = rows.withColumn("u", policy.rank_update(c("lam"), F.coalesce("lambda_hat", F.lit(0.0)), F.lit(False), F.lit(None).cast("boolean"), F.size("neg1") > 0))
    after = {
        "query_id": c("query_id"), "q0": c("q0"), "q": F.when(is_rank, c("q")).otherwise(V.rocchio(c("q0"), c("p.m"), c("n.m"), 1.0, BETA, GAMMA)),
        "beta": F.when(is_rank, c("beta")).otherwise(F.when(c("p").isNotNull(), BETA).otherwise(0.0)), "gamma": F.when(is_rank, c("gamma")).otherwise(F.when(c("n").isNotNull(), GAMMA).otherwise(0.0)),
        "lam": F.when(is_rank, c("u.lam")).otherwise(c("lam")), "t_star": F.coalesce("new_t", "t_star"), "sigma": F.coalesce("new_sigma", "sigma"),
        "pos_ids": c("pos1"), "soft_ids": c("neg1"), "eta_soft": F.when(is_rank, c("u.eta_soft")).otherwise(c("eta_soft")), "used": F.array_union("used", F.array("slot")),
    }
    after["document"] = slots.rendered(c("document"), bodies(after))
    rows = written(rows.select(*[v.alias(n) for n, v in after.items()], "slot"), "changed")
    chosen = rows.select("query_id", "slot").join(actions.select("query_id", actions["round"] if "round" in actions.columns else F.lit(None).cast("int").alias("round")), "query_id")
    return guards.settled(state, rows.select(*STATE), chosen, pieces, marks, [], edit)


def run(queries: DataFrame, corpus: DataFrame, k: int = 10, max_rounds: int = 3, document: str = slots.DOCUMENT, texts: DataFrame | None = None, edit: guards.Editor | None = None) -> Evolved:
    """Evidence, log and final documents. corpus: (doc_id, e, time_days); queries: (query_id, q); texts: (text), none of whose
    passages may be copied."""
    pieces = None if texts is None else written(guards.pieces(texts, []), "pieces")
    marks = None if texts is None else written(guards.filters(pieces, []), "marks")
    corpus = written(corpus.select("doc_id", "e", F.col("time_days").cast("double").alias("time_days")), "corpus")
    state = written(start(queries, corpus.schema["doc_id"].dataType.simpleString(), document), "state")
    evidence, logs, documents = [], [], []
    for n in range(1, max_rounds + 1):
        hits = written(policy.two_means(retrieve(state, corpus, k)), "hits")  # clustered once for diagnosis and signals
        seen = diagnosed(hits, state).join(state.select("query_id", "used"), "query_id")
        slot = F.when(F.lit(n == max_rounds), F.lit(None).cast("string")).otherwise(policy.geometric_slot(F.col("gap"), F.col("n_eff_time"), F.col("n_eff_alias"), F.col("used")))
        why = F.when(F.col("slot").isNotNull(), F.concat(F.lit("compiled "), "slot")).when(F.col("gap").isin("sufficient", "unanswerable", "unknown"), F.col("gap")).when(F.lit(n == max_rounds), "max_rounds").otherwise("no eligible slot")
        actions = written(seen.withColumn("slot", slot).withColumn("why", why).select("query_id", F.lit(n).alias("round"), "gap", "slot", "why", "top"), "actions")
        stopped = actions.where("slot is null")
        logs.append(stopped.withColumn("accepted", F.lit(True)))
        evidence.append(hits.join(stopped.select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", "sim", "score", "rk"))
        documents.append(state.join(stopped.select("query_id"), "query_id", "left_semi").select("query_id", "document"))
        going = actions.where("slot is not null")
        if n == max_rounds or going.isEmpty():
            break
        after = written(moved(state, hits, going, pieces, marks, edit), "state")
        logs.append(going.drop("slot").join(after.select("query_id", "slot", "broken"), "query_id").withColumn("accepted", F.col("broken").isNull()).withColumn("why", F.coalesce(F.concat(F.lit("rollback: "), "broken"), "why")).drop("broken"))
        state = after.select(*STATE)
    log = reduce(DataFrame.unionByName, logs).select("query_id", "round", "gap", "slot", "accepted", "why", "top")
    return Evolved(reduce(DataFrame.unionByName, evidence), log, reduce(DataFrame.unionByName, documents))


def evolve(queries: DataFrame, corpus: DataFrame, k: int = 10, max_rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(evidence, log) of `run`."""
    return run(queries, corpus, k, max_rounds)[:2]
