"""The loop with evidence review: questions with their own texts, one change of query, filter or ranking a round.

Each question is joined with its own texts by key, so nothing is compared across questions.  The review decides
whether the first texts answer the question; if not, the next change is the first of these that has a reason: a search
phrase bound to the question (query), penalties for texts without the question's terms (filter), recency and penalties
for texts found irrelevant (rank).  How rank changes depends on the question's task: `time` boosts recency and takes texts
older than the rest for hard negatives, `multihop` gives texts of a second cluster a bonus, any other follows the review.

A change is rendered into the slots of the question's policy document and checked there: nothing but the chosen slot
may change, it has to, and no piece of the question's texts may stand in the document (`guards`).  A change that breaks a
rule is rolled back, and the question goes on with its old state.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.functions import text as T
from vecmill.functions import vectors as V
from vecmill.operators import guards, policy, review, search, sessions, slots
from vecmill.session import written

# Weights of the phrase, of the noise and of a moved query.
PHRASE_WEIGHT, NOISE_WEIGHT, BETA = 0.85, 0.15, 0.75
Encoder = Callable[[DataFrame, str, str], DataFrame]  # texts, key, text to (key, e)


class Evolved(NamedTuple):
    evidence: DataFrame  # (query_id, doc_id, rk, sim, score)
    log: DataFrame  # (query_id, round, covers, cause, slot, accepted, why, hop, proxy, top)
    documents: DataFrame  # (query_id, document)


def start(questions: DataFrame, id_type: str = "bigint") -> DataFrame:
    """questions: (query_id, question, query_days, q0) and, if they differ, task and document; id_type is that of the texts' ids."""
    ids, vector, terms = F.array().cast(f"array<{id_type}>"), F.lit(None).cast("array<double>"), F.array().cast("array<string>")
    zero, none, no = F.lit(0.0), F.lit(None).cast("double"), F.lit(False)
    given = lambda name, other: F.coalesce(name, F.lit(other)) if name in questions.columns else F.lit(other)
    first = {
        "query_id": F.col("query_id"), "question": F.col("question"), "query_days": F.col("query_days").cast("double"), "task": given("task", ""), "q0": F.col("q0"),
        "q": F.col("q0"), "v": vector, "mu": vector, "omega": zero, "beta": zero, "gamma": zero, "focus": F.lit(""), "pos_ids": ids, "soft_ids": ids, "hard_ids": ids, "eta_soft": zero, "eta_hard": zero,
        "lam": zero, "t_star": none, "sigma": none, "div_ids": ids, "delta": zero, "binds": terms, "drop_ids": ids, "require_bind": no, "filter_eta": zero, "used": terms, "proxy": F.lit(-1.0), "last": F.lit(""),
    }
    return questions.select(*[c.alias(n) for n, c in first.items()], given("document", slots.DOCUMENT).alias("empty")).withColumn("document", slots.rendered(F.col("empty"), bodies(F.col))).drop("empty")


def bodies(c: Callable[[str], Column]) -> dict[str, Column]:
    """The slots as they show the columns of a state."""
    used = lambda s: F.array_contains(c("used"), s)
    size = lambda name: F.size(c(name))
    return {
        "query": slots.query_body(used("query"), c("focus"), c("omega"), F.lit(1.0), c("beta"), c("gamma"), size("pos_ids"), size("soft_ids")),
        "rank": slots.rank_body(used("rank"), c("lam"), c("eta_soft"), c("eta_hard"), c("t_star"), c("sigma"), size("soft_ids"), size("hard_ids"), size("div_ids"), c("delta")),
        "filter": slots.filter_body(used("filter"), c("require_bind"), c("filter_eta"), c("drop_ids"), c("binds")),
    }


def retrieve(state: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Top k of each question among its own texts (query_id, doc_id, text, e, time_days), under its state."""
    rows = texts.join(state.drop("document"), "query_id")
    c = F.col
    mu = F.when(c("mu").isNotNull(), V.dot(V.unit(c("mu")), c("e")))
    sv = F.when(c("v").isNotNull(), V.dot(V.unit(c("v")), c("e")))
    sim = search.slate_similarity(V.dot(c("q0"), c("e")), V.dot(c("q"), c("e")), sv, mu, c("omega"), c("gamma"))
    rec = S.recency(c("time_days"), c("t_star"), c("sigma"))
    penalty = search.negative_penalty(c("doc_id"), c("hard_ids"), c("soft_ids"), c("eta_hard"), c("eta_soft"))
    bonus = F.when(F.array_contains("div_ids", c("doc_id")), c("delta")).otherwise(0.0)
    distinctive = T.distinctive_binds(c("question"))
    bound = T.bound(c("text"), T.ordered_terms(c("text")), distinctive)
    filtered = search.filter_penalty(F.array_contains("used", "filter"), c("filter_eta"), F.array_contains("drop_ids", c("doc_id")), c("require_bind"), bound)
    rows = rows.withColumn("sim", sim).withColumn("score", S.steady(search.fused(c("sim"), rec, c("lam"), penalty, bonus, filtered), 9))
    rows = rows.withColumn("bound", bound).withColumn("n_binds", F.size(distinctive))
    return search.top_k(rows, ["query_id"], "score", "doc_id", k).select("query_id", "question", "query_days", "doc_id", "rk", "text", "e", "time_days", "sim", "score", "bound", "n_binds")


def _ranked(condition: Column) -> Column:
    """The doc_ids that hold a condition, in order of rank."""
    return F.transform(F.array_sort(F.collect_list(F.when(condition, F.struct("rk", "doc_id")))), lambda x: x["doc_id"])


def _hops(hits: DataFrame) -> DataFrame:
    """What a question that needs several texts makes of its hits: (query_id, noise, main, others, n_hits)."""
    asked = review.attribute_terms(F.col("question"))
    rows = policy.multihop(policy.two_means(hits).withColumn("ov", T.overlap(asked, T.ordered_terms(F.col("text")))))
    return rows.groupBy("query_id").agg(_ranked(F.col("penalty") > 0).alias("noise"), _ranked(F.col("main")).alias("main"), _ranked(F.col("bonus") > 0).alias("others"), F.count("*").alias("n_hits"))


def changed(state: DataFrame, hits: DataFrame, acts: DataFrame, encode: Encoder = sessions.hashed_vectors) -> DataFrame:
    """State after each question's chosen slot, its document included.

    acts: (query_id, slot, hop, relevant_ids, soft_ids, hard_ids, time_mismatch, proxy).  query searches for the phrase
    and away from the noise; without a phrase it moves the query vector towards relevant hits and away from the others,
    where there are both.  filter and rank penalise.
    """
    telling = acts.where("slot = 'query' and hop <> ''").where(~T.is_abstract(F.col("hop")))  # labels like "specific place" find nothing
    phrase = encode(telling.select("query_id", "hop"), "query_id", "hop").withColumnRenamed("e", "v1")
    taken = acts.select("query_id", "slot", "hop", F.col("relevant_ids").alias("pos1"), F.col("soft_ids").alias("soft1"), F.col("hard_ids").alias("hard1"), "time_mismatch", F.col("proxy").alias("proxy1"))
    rows = state.join(taken, "query_id")
    kinds = rows.select("query_id", "pos1", F.concat("soft1", "hard1").alias("neg1"), F.when(F.col("slot") == "rank", F.col("task")).otherwise("").alias("way"))
    judged = hits.join(kinds, "query_id").withColumn("relevant", F.array_contains("pos1", F.col("doc_id"))).withColumn("negative", F.array_contains("neg1", F.col("doc_id"))).drop("pos1", "neg1")
    drops = policy.filter_update(judged).select("query_id", "polluted", F.array_compact("drop_ids").alias("drops"))
    timed = policy.time_signals(judged.where("way = 'time'"))
    sided = policy.memory_signals(judged.where("way <> 'time'"))
    sided = sided.unionByName(timed.select(*sided.columns))
    on = lambda side: _ranked(F.col("side") == side)
    sides = sided.groupBy("query_id").agg(F.max("t_star").alias("new_t"), F.max("sigma").alias("new_sigma"), on("pos").alias("sig_pos"), on("neg").alias("sig_neg"))
    mean = lambda some, name: V.mean_vectors(some, ["query_id"], "e", name=name)
    for more in (phrase, mean(hits, "m"), mean(judged.where("relevant"), "mp"), mean(judged.where("negative"), "mn"), drops, sides, policy.recency_weight(sided), _hops(judged.where("way = 'multihop'"))):
        rows = rows.join(more, "query_id", "left")
    c = F.col
    empty = F.slice("pos_ids", 1, 0)
    some = lambda name: F.coalesce(F.array_compact(c(name)), empty)
    either = lambda new, old: F.when(F.size(new) > 0, new).otherwise(old)
    rows = rows.withColumns({n: some(n) for n in ("sig_pos", "sig_neg", "noise", "main", "others", "drops")})
    away = V.without(V.without(c("m"), c("q0")), F.when(c("v1").isNotNull(), V.without(c("v1"), c("q0"))))
    found, both = c("v1").isNotNull(), F.array_union("soft1", "hard1")
    towards = ~found & (F.size("pos1") > 0) & (F.size(both) > 0)
    time, hops = c("task") == "time", c("task") == "multihop"
    clustered = F.coalesce(c("n_hits") >= policy.MULTIHOP_LEAST, F.lit(False))
    boost = time | c("time_mismatch")
    negatives = either(c("sig_neg"), c("soft_ids"))
    rows = rows.withColumn("soft_rank", F.when(hops, c("noise")).when(time, negatives).otherwise(F.array_union(negatives, c("soft1"))))
    rows = rows.withColumn("hard_rank", F.when(hops, F.when(clustered, empty).otherwise(c("hard_ids"))).when(time, F.array_union(F.array_union("sig_neg", "hard1"), c("hard_ids"))).otherwise(F.array_union("hard1", "hard_ids")))
    lam = policy.rank_update(c("lam"), F.coalesce("lambda_hat", F.lit(0.0)), boost, boost, F.size("soft_rank") > 0)
    rows = rows.withColumn("u", lam)
    known = c("query_days").isNotNull()

    def by_slot(name: str, **new: Column) -> Column:
        out = c(name)
        for slot, value in new.items():
            out = F.when(c("slot") == slot, value).otherwise(out)
        return out

    after = {
        "q": by_slot("q", query=F.when(towards, V.rocchio(c("q0"), c("mp"), c("mn"))).otherwise(c("q0"))), "v": by_slot("v", query=c("v1")), "mu": by_slot("mu", query=F.when(~towards, away)),
        "omega": by_slot("omega", query=F.when(found, PHRASE_WEIGHT).otherwise(0.0)), "beta": by_slot("beta", query=F.when(found, PHRASE_WEIGHT).when(towards, BETA).otherwise(0.0)), "gamma": by_slot("gamma", query=F.when(found | towards, NOISE_WEIGHT).otherwise(0.0)),
        "focus": by_slot("focus", query=F.when(F.trim("hop") != "", F.trim("hop")).otherwise(c("focus"))),
        "pos_ids": by_slot("pos_ids", query=either(c("pos1"), c("pos_ids")), rank=either(F.when(hops, F.when(clustered, c("main")).otherwise(empty)).otherwise(c("sig_pos")), c("pos_ids"))),
        "soft_ids": by_slot("soft_ids", query=either(c("soft1"), F.when(towards, both).otherwise(c("soft_ids"))), rank=c("soft_rank")), "hard_ids": by_slot("hard_ids", query=either(c("hard1"), c("hard_ids")), rank=c("hard_rank")),
        "eta_soft": by_slot("eta_soft", rank=F.when(F.size("soft_rank") == 0, 0.0).when(hops, policy.ETA_MULTIHOP).otherwise(policy.ETA)),
        "eta_hard": by_slot("eta_hard", rank=F.when(hops, F.when(clustered, 0.0).otherwise(c("eta_hard"))).when(F.size("hard_rank") > 0, policy.ETA_HARD).otherwise(c("eta_hard"))),
        "lam": by_slot("lam", rank=F.when(hops, 0.0).otherwise(c("u.lam"))),
        "t_star": by_slot("t_star", query=F.when(towards & known, c("query_days")).otherwise(c("t_star")), rank=F.when(hops, c("t_star")).otherwise(F.coalesce("new_t", "t_star"))),
        "sigma": by_slot("sigma", query=F.when(towards & known, policy.SIGMA_FLOOR).otherwise(c("sigma")), rank=F.when(hops, c("sigma")).otherwise(F.coalesce("new_sigma", "sigma"))),
        "div_ids": by_slot("div_ids", rank=F.when(hops, c("others")).otherwise(c("div_ids"))), "delta": by_slot("delta", rank=F.when(hops, F.when(F.size("others") > 0, policy.DELTA_DIV).otherwise(0.0)).otherwise(c("delta"))),
        "binds": by_slot("binds", filter=T.distinctive_binds(c("question"))), "drop_ids": by_slot("drop_ids", filter=c("drops")), "require_bind": by_slot("require_bind", filter=F.coalesce("polluted", F.lit(False))),
        "filter_eta": by_slot("filter_eta", filter=F.when((F.size("drops") > 0) | F.coalesce("polluted", F.lit(False)), policy.FILTER_ETA).otherwise(0.0)),
        "used": F.array_union("used", F.array("slot")), "proxy": c("proxy1"), "last": c("slot"),
    }
    moved = rows.select("query_id", "question", "query_days", "task", "q0", *[v.alias(n) for n, v in after.items()], "document")
    return moved.withColumn("document", slots.rendered(F.col("document"), bodies(F.col))).select(*state.columns)


def run(questions: DataFrame, texts: DataFrame, k: int = 10, max_rounds: int = 3, encode: Encoder = sessions.hashed_vectors, edit: guards.Editor | None = None) -> Evolved:
    """Evidence, log and final documents of all questions. encode makes vectors of phrases; edit may rewrite a changed
    document before it is checked."""
    texts = written(texts.select("query_id", "doc_id", "text", "e", F.col("time_days").cast("double").alias("time_days")), "texts")
    pieces = written(guards.pieces(texts, ["query_id"]), "pieces")
    marks = written(guards.filters(pieces, ["query_id"]), "marks")
    state = written(start(questions, texts.schema["doc_id"].dataType.simpleString()), "state")
    evidence, logs, documents = [], [], []
    for n in range(1, max_rounds + 1):
        hits = written(retrieve(state, texts, k), "hits")
        seen = review.review(hits).drop("question").join(state.select("query_id", "used", F.col("proxy").alias("before"), "last"), "query_id")
        top = F.transform(F.array_sort(F.collect_list(F.struct("rk", "doc_id"))), lambda x: x["doc_id"])
        facts = hits.groupBy("query_id").agg(top.alias("top"), F.max("sim").alias("top_sim"), F.sum((~F.col("bound") & (F.col("rk") <= policy.POLLUTED_TOP)).cast("int")).alias("unbound"), F.max("n_binds").alias("n_binds"))
        seen = seen.join(facts, "query_id")
        c = F.col
        dead = (c("last") == "query") & (c("proxy") <= c("before") + 1e-6)
        filter_ok = (c("n_binds") > 0) & (c("unbound") >= policy.POLLUTED_LEAST)
        unanswerable = policy.unanswerable_gap(c("top_sim")) >= policy.UNANSWERABLE
        act = policy.next_action(c("covers"), unanswerable, F.lit(n), F.lit(max_rounds), dead, c("hop") != "", c("hop") != "", filter_ok, c("time_mismatch"), c("used"))
        acts = written(seen.withColumn("a", act).select("query_id", F.lit(n).alias("round"), "covers", "cause", c("a.slot").alias("slot"), c("a.why").alias("why"), "hop", "proxy", "top", "relevant_ids", "soft_ids", "hard_ids", "time_mismatch"), "acts")
        stopped, going = acts.where("slot is null"), acts.where("slot is not null")
        shown = ["query_id", "round", "covers", "cause", "slot", "accepted", "why", "hop", "proxy", "top"]
        logs.append(stopped.withColumn("accepted", F.lit(True)).select(*shown))
        evidence.append(hits.join(stopped.select("query_id"), "query_id", "left_semi").select("query_id", "doc_id", "rk", "sim", "score"))
        documents.append(state.join(stopped.select("query_id"), "query_id", "left_semi").select("query_id", "document"))
        if n == max_rounds or going.isEmpty():
            break
        after = written(changed(state, hits, going, encode), "changed")
        kept = written(guards.settled(state, after, going.select("query_id", "round", "slot"), pieces, marks, ["query_id"], edit).drop("slot"), "state")
        why = F.coalesce(F.concat(F.lit("rollback: "), "broken"), "why")
        logs.append(going.join(kept.select("query_id", "broken"), "query_id").withColumn("accepted", F.col("broken").isNull()).withColumn("why", why).select(*shown))
        state = kept.drop("broken")
    return Evolved(*(reduce(DataFrame.unionByName, x) for x in (evidence, logs, documents)))


def evolve(questions: DataFrame, texts: DataFrame, k: int = 10, max_rounds: int = 3, encode: Encoder = sessions.hashed_vectors) -> tuple[DataFrame, DataFrame]:
    """(evidence, log) of `run`."""
    return run(questions, texts, k, max_rounds, encode)[:2]
