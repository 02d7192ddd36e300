"""Diagnosis, signals and policy updates, as expressions over rows of (query_id, doc_id, rk, sim, time_days, ...)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.functions import vectors as V
from vecmill.functions.text import let

# Thresholds and step sizes.
MIN_NEFF, SIM_FLOOR, SPREAD_REF, SEPARATION_REF = 5.0, 0.12, 0.35, 0.25
OPEN_GAP, UNANSWERABLE = 0.2, 0.8
SIGMA_FLOOR = 30.0
LAMBDA_MAX, LAMBDA_FLOOR, LAMBDA_BOOST, TRUST = 0.60, 0.35, 0.40, 0.35
ETA, ETA_HARD, DELTA_DIV = 0.35, 0.50, 0.12
FILTER_ETA, POLLUTED_TOP, POLLUTED_LEAST, DROP_CAP = 0.75, 5, 2, 24
ETA_MULTIHOP, MULTIHOP_LEAST = 0.25, 4
LLOYD_STEPS = 12


def time_gap(hits: DataFrame, lam: Column | float = 0.0) -> DataFrame:
    """(query_id, n_dated, n_eff, spread_years, g_time): how far apart in time the dated hits lie, by similarity.

    lam: the share of recency in the score that found them; what is used already is no gap.
    """
    dated = S.with_softmax(hits.where("time_days is not null").withColumn("__lam", lam if isinstance(lam, Column) else F.lit(lam)), ["query_id"], "sim", "w", 1.0)
    m = S.weighted_mean(F.col("time_days"), F.col("w"))
    each = dated.groupBy("query_id").agg(m.alias("mu"), F.count("*").alias("n_dated"), S.kish(F.col("w")).alias("n_eff"))
    again = dated.join(each, "query_id").withColumn("dev", F.col("w") * F.pow(F.col("time_days") - F.col("mu"), 2))
    spread = again.groupBy("query_id", "n_dated", "n_eff").agg((F.sqrt(F.greatest(F.sum("dev") / F.sum("w"), F.lit(0.0))) / 365.25).alias("spread_years"), F.max("__lam").alias("__lam"))
    raw = S.clamp((1.0 - F.col("__lam")) * S.logistic(4.0 * (F.col("spread_years") / SPREAD_REF - 1.0)), 0, 1)
    none = (F.col("n_dated") < 2) | (F.col("n_eff") < MIN_NEFF)
    return spread.withColumn("g_time", F.when(none, F.lit(0.0)).otherwise(raw)).withColumn("n_eff", F.when(F.col("n_dated") < 2, F.lit(0.0)).otherwise(F.col("n_eff"))).drop("__lam")


def time_signals(hits: DataFrame) -> DataFrame:
    """Each hit of at least two dated ones with t_star, sigma, kappa and side: neg (older than t_star - sigma), pos (kappa
    of 1/e or more), else null.  t_star is query_days where hits have that column and it is known, else the 0.9 quantile."""
    w = Window.partitionBy("query_id")
    dated = hits.where("time_days is not null").withColumn("__n", F.count("*").over(w)).where("__n >= 2").drop("__n")
    weighted = S.with_softmax(dated, ["query_id"], "sim", "w")
    mean = F.sum(F.col("w") * F.col("time_days")).over(w) / F.sum("w").over(w)
    quantile = F.expr("percentile(time_days, 0.9) over (partition by query_id)")
    one = weighted.withColumn("mu", mean).withColumn("t_star", F.coalesce("query_days", quantile) if "query_days" in hits.columns else quantile)
    two = one.withColumn("sigma", F.greatest(F.sqrt(F.greatest(F.sum(F.col("w") * F.pow(F.col("time_days") - F.col("mu"), 2)).over(w) / F.sum("w").over(w), F.lit(0.0))), F.lit(SIGMA_FLOOR)))
    three = two.withColumn("kappa", S.recency(F.col("time_days"), F.col("t_star"), F.col("sigma")))
    side = F.when((F.col("time_days") < F.col("t_star") - F.col("sigma")) & (F.col("sim") > 1e-12), "neg").when(F.col("kappa") >= float(np.exp(-1.0)), "pos")
    return three.withColumn("side", side)


def alias_signals(clustered: DataFrame, vector: str = "e") -> DataFrame:
    """Each hit with side: pos for the cluster nearer to the mean of the hits weighted by similarity (ties: cluster 0), else neg."""
    weighted = clustered.select("query_id", "cluster", "sim", F.posexplode(vector).alias("i", "x"))
    centre = weighted.groupBy("query_id", "cluster", "i").agg(F.avg("x").alias("c"), F.sum(F.col("sim") * F.col("x")).alias("sx"))
    sims = clustered.groupBy("query_id").agg(F.greatest(F.sum("sim"), F.lit(S.EPS)).alias("total"))
    w = Window.partitionBy("query_id", "i")
    apart = centre.join(sims, "query_id").withColumn("q", F.sum("sx").over(w) / F.col("total"))
    far = apart.groupBy("query_id", "cluster").agg(F.sqrt(F.sum(F.pow(F.col("c") - F.col("q"), 2))).alias("d"))
    best = far.groupBy("query_id").agg(F.min(F.struct("d", "cluster"))["cluster"].alias("__pos"))
    return clustered.join(best, "query_id").withColumn("side", F.when(F.col("cluster") == F.col("__pos"), "pos").otherwise("neg")).drop("__pos")


def signals(hits: DataFrame, gap: str = "gap") -> DataFrame:
    """Sides of the hits by the kind of gap that a column names: clusters for alias, else time; with t_star, sigma and
    kappa, which are null for alias, and n_eff, the effective number of the hits that were looked at.  Hits that have a
    cluster already keep it."""
    alias = F.coalesce(F.col(gap) == "alias", F.lit(False))
    timed = time_signals(hits.where(~alias)).drop("mu", "w")
    none = {"t_star": F.lit(None).cast("double"), "sigma": F.lit(None).cast("double"), "kappa": F.lit(None).cast("double")}
    split = hits.where(alias) if "cluster" in hits.columns else two_means(hits.where(alias))
    sided = alias_signals(split).withColumns(none).select(*timed.columns)
    both = timed.unionByName(sided)
    flat = S.with_softmax(both, ["query_id"], "sim", "__w", 1.0)
    n_eff = F.pow(F.sum("__w").over(Window.partitionBy("query_id")), 2) / F.sum(F.col("__w") * F.col("__w")).over(Window.partitionBy("query_id"))
    return flat.withColumn("n_eff", n_eff).drop("__w")


def memory_signals(hits: DataFrame) -> DataFrame:
    """hits (query_id, doc_id, sim, time_days, query_days, relevant, negative) with side, t_star, sigma and kappa: what a
    review found relevant against its negatives; questions where it found neither get time_signals."""
    judged = F.max((F.col("relevant") | F.col("negative")).cast("int")).over(Window.partitionBy("query_id")) == 1
    rows = hits.withColumn("__judged", judged)
    fixed = F.when(F.col("query_days").isNotNull(), F.lit(SIGMA_FLOOR))
    known = rows.where("__judged").withColumn("t_star", F.col("query_days")).withColumn("sigma", fixed)
    known = known.withColumn("kappa", F.when(F.col("time_days").isNotNull(), S.recency(F.col("time_days"), F.col("t_star"), F.col("sigma")))).withColumn("side", F.when(F.col("relevant"), "pos").when(F.col("negative"), "neg"))
    timed = time_signals(rows.where("not __judged"))
    return known.unionByName(timed.select(*known.columns)).drop("__judged")


def recency_weight(signals: DataFrame) -> DataFrame:
    """(query_id, lambda_hat): share of the distance in recency between both sides in that of recency and similarity.

    A side without hits counts as mean 0; without positive hits the estimate is 0.
    """
    mean = lambda c, s: F.avg(F.when(F.col("side") == s, F.col(c)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    each = signals.groupBy("query_id").agg(mean("kappa", "pos").alias("kp"), mean("kappa", "neg").alias("kn"), mean("sim", "pos").alias("sp"), mean("sim", "neg").alias("sn"))
    dk, ds = F.abs(zero("kp") - zero("kn")), F.abs(zero("sp") - zero("sn"))
    return each.select("query_id", F.when(F.col("kp").isNull(), F.lit(0.0)).otherwise(S.clamp(dk / (dk + ds + 1e-8), 0, LAMBDA_MAX)).alias("lambda_hat"))


def rank_update(before: Column, estimate: Column, boost: Column, allowed: Column, any_negative: Column) -> Column:
    """struct(lam, eta_soft) of the next round.

    allowed: true raises the estimate to a floor, false turns recency off, null leaves the estimate; boost raises it
    to a higher floor.  The result stays within the trust region around the last value, but a boost keeps its floor.
    """
    raised = F.when(boost, F.greatest(estimate, F.lit(LAMBDA_BOOST))).when(allowed, F.greatest(estimate, F.lit(LAMBDA_FLOOR))).otherwise(estimate)
    held = F.greatest(F.least(raised, before + TRUST), before - TRUST)
    kept = F.when(boost, S.clamp(F.greatest(held, F.lit(LAMBDA_BOOST)), 0, LAMBDA_MAX)).otherwise(held)
    lam = F.when(allowed.isNotNull() & ~allowed, F.lit(0.0)).otherwise(kept)
    return F.struct(lam.alias("lam"), F.when(any_negative, F.lit(ETA)).otherwise(F.lit(0.0)).alias("eta_soft"))


def filter_update(hits: DataFrame) -> DataFrame:
    """hits (query_id, doc_id, rk, bound, relevant, negative): (query_id, polluted, n_unbound, drop_ids), drops in order of rank.

    Hits without the question's terms are dropped, unless relevant, where the first hits are polluted by such, and
    else where the review found them negative.
    """
    unbound_top = F.sum((~F.col("bound") & (F.col("rk") <= POLLUTED_TOP)).cast("int"))
    stray = ~F.col("bound") & ~F.col("relevant")
    listed = F.array_sort(F.array_compact(F.collect_list(F.when(stray, F.struct("rk", "doc_id", "negative")))))
    each = hits.groupBy("query_id").agg(unbound_top.alias("n_unbound"), listed.alias("out"))
    polluted = F.col("n_unbound") >= POLLUTED_LEAST
    dropped = F.transform(F.filter("out", lambda x: polluted | x["negative"]), lambda x: x["doc_id"])
    return each.select("query_id", polluted.alias("polluted"), "n_unbound", F.slice(dropped, 1, DROP_CAP).alias("drop_ids"))


def _split(gram: Column) -> Column:
    """Clusters, 0 or 1, of rows whose inner products are given (array of arrays), by Lloyd steps.

    A centre is the mean of some rows, so it is held as their weights; its inner products are sums of rows of the table.
    """
    n, one = F.size(gram), F.lit(1.0)
    places = F.sequence(F.lit(1), n)
    only = lambda i: F.transform(places, lambda j: F.when(j == i, one).otherwise(0.0))
    least = F.array_position(F.get(gram, 0), F.array_min(F.get(gram, 0)))

    def weights(far: Column, side: bool, before: Column) -> Column:
        return let(F.size(F.filter(far, lambda x: x == side)), lambda m: F.when(m == 0, before).otherwise(F.transform(far, lambda x: F.when(x == side, one / m).otherwise(0.0))))

    def step(s: Column, _: Column) -> Column:
        near = lambda w: F.transform(gram, lambda row: V.dot(row, w))
        far = let(F.struct(near(s["a"]).alias("a"), near(s["b"]).alias("b")), lambda p: let(V.dot(p["b"], s["b"]) - V.dot(p["a"], s["a"]), lambda d: F.zip_with(p["a"], p["b"], lambda x, y: d - 2.0 * y < -2.0 * x - 1e-12)))
        return let(far, lambda f: F.struct(weights(f, False, s["a"]).alias("a"), weights(f, True, s["b"]).alias("b"), f.alias("far")))

    begin = F.struct(only(F.lit(1)).alias("a"), only(least).alias("b"), F.transform(places, lambda j: F.lit(False)).alias("far"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LLOYD_STEPS)), begin, step, lambda s: F.transform(s["far"], lambda x: x.cast("int")))


def two_means(hits: DataFrame, vector: str = "e") -> DataFrame:
    """hits with cluster 0 or 1, by twelve Lloyd steps from the first hit and the one least like it.

    A question has k hits, so its rows and the table of their inner products are small by definition; ties go to cluster 0,
    an empty cluster keeps its centre.
    """
    rows = F.array_sort(F.collect_list(F.struct("rk", "doc_id", F.struct(*hits.columns).alias("row"))))
    each = hits.groupBy("query_id").agg(F.transform(rows, lambda r: r["row"]).alias("rows"))
    vectors = F.transform("rows", lambda r: r[vector].cast("array<double>"))
    each = each.select("rows", F.transform(vectors, lambda x: F.transform(vectors, lambda y: V.dot(x, y))).alias("gram"))
    return each.select(F.explode(F.arrays_zip("rows", _split(F.col("gram")).alias("cluster"))).alias("r")).select("r.rows.*", "r.cluster")


def multihop(clustered: DataFrame) -> DataFrame:
    """hits (query_id, doc_id, sim, ov, cluster) with main, bonus and penalty, for questions that need several texts.

    The first cluster is that of the greatest mean overlap, then similarity (ties: cluster 0); hits of the other get a
    bonus if it has any overlap.  Hits without overlap get a penalty.  Fewer than four hits are no clusters.
    """
    means = clustered.groupBy("query_id", "cluster").agg(F.avg("ov").alias("__ov"), F.avg("sim").alias("__s"), F.count("*").alias("__n"))
    first = means.groupBy("query_id").agg(F.max(F.struct("__ov", "__s", (-F.col("cluster")).alias("neg")))["neg"].alias("__first"), F.sum("__n").alias("__hits"))
    rows = clustered.join(means.drop("__s", "__n"), ["query_id", "cluster"]).join(first, "query_id")
    other = (F.col("cluster") != -F.col("__first")) & (F.col("__hits") >= MULTIHOP_LEAST) & (F.col("__ov") > 1e-6)
    rows = rows.withColumn("main", (F.col("cluster") == -F.col("__first")) & (F.col("__hits") >= MULTIHOP_LEAST))
    rows = rows.withColumn("bonus", F.when(other, DELTA_DIV).otherwise(0.0)).withColumn("penalty", F.when(F.col("ov") < 1e-6, ETA_MULTIHOP).otherwise(0.0))
    return rows.drop("__ov", "__first", "__hits")


def alias_gap(clustered: DataFrame) -> DataFrame:
    """(query_id, n_hits, n_eff, balance, separation, g_alias): two groups of hits that are alike to the question but not to each other."""
    weights = S.with_softmax(clustered, ["query_id"], "sim", "w", 1.0)
    each = weights.groupBy("query_id").agg(
        F.count("*").alias("n_hits"), S.kish(F.col("w")).alias("n_eff"),
        F.avg(F.when(F.col("cluster") == 0, F.col("sim"))).alias("s0"), F.avg(F.when(F.col("cluster") == 1, F.col("sim"))).alias("s1"),
    )
    centre = clustered.select("query_id", "cluster", F.posexplode("e").alias("i", "x")).groupBy("query_id", "cluster", "i").agg(F.avg("x").alias("c"))
    two = centre.groupBy("query_id", "i").agg(F.max(F.when(F.col("cluster") == 0, F.col("c"))).alias("a"), F.max(F.when(F.col("cluster") == 1, F.col("c"))).alias("b"))
    apart = two.groupBy("query_id").agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2))).alias("separation"))
    balance = F.least("s0", "s1") / F.greatest(F.col("s0"), F.col("s1"), F.lit(1e-8))
    g = S.clamp(balance * S.logistic(4.0 * (F.col("separation") / SEPARATION_REF - 1.0)), 0, 1)
    none = (F.col("n_hits") < 5) | (F.col("n_eff") < MIN_NEFF) | F.col("s0").isNull() | F.col("s1").isNull()
    return each.join(apart, "query_id").select("query_id", "n_hits", "n_eff", F.when(~none, balance).alias("balance"), "separation", F.when(none, F.lit(0.0)).otherwise(g).alias("g_alias"))


def unanswerable_gap(top_sim: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(SIM_FLOOR) - top_sim) / SIM_FLOOR)


def gap_kind(g_time: Column, g_alias: Column, g_unans: Column, top_sim: Column, rank_done: Column, query_done: Column) -> Column:
    """time, alias, unanswerable, sufficient or unknown. rank_done: a rank update is active and the top hit is recent;
    query_done: a query update is active and the top hits lie on its positive side. Ties: time, alias, unanswerable."""
    top = F.greatest(g_time, g_alias, g_unans)
    kind = F.when(g_time == top, "time").when(g_alias == top, "alias").otherwise("unanswerable")
    closed = F.when(top_sim >= SIM_FLOOR, "sufficient").otherwise("unknown")
    return F.when(g_unans >= UNANSWERABLE, "unanswerable").when(rank_done | query_done, "sufficient").when(top < OPEN_GAP, closed).otherwise(kind)


def rank_closes(used: Column, top_days: Column, t_star: Column, sigma: Column) -> Column:
    """A rank update is active and the top hit lies on the recent side."""
    return F.array_contains(used, "rank") & F.coalesce(top_days >= t_star - F.coalesce(sigma, F.lit(1.0)), F.lit(False))


def query_closes(used: Column, top: Column, pos_ids: Column) -> Column:
    """A query update is active and the first three hits lie on its positive side."""
    return F.array_contains(used, "query") & (F.size(pos_ids) > 0) & (F.size(F.array_except(F.slice(top, 1, 3), pos_ids)) == 0)


def next_action(covers: Column, unanswerable: Column, round_: Column, max_rounds: Column, dead_end: Column, missing: Column, hop_ok: Column, filter_ok: Column, time_mismatch: Column, used: Column) -> Column:
    """struct(kind, slot, why). used: array of slots already used. The first rule that applies wins."""
    free = lambda slot: ~F.array_contains(used, slot)
    act = lambda kind, slot, why: F.struct(F.lit(kind).alias("kind"), F.lit(slot).cast("string").alias("slot"), F.lit(why).alias("why"))
    return (
        F.when(unanswerable, act("stop", None, "unanswerable")).when(covers, act("stop", None, "enough"))
        .when(round_ == max_rounds, act("stop", None, "max_rounds"))
        .when(dead_end & filter_ok & free("filter"), act("inject", "filter", "dead_end_filter")).when(dead_end, act("stop", None, "dead_end_stop"))
        .when(missing & free("query") & hop_ok, act("inject", "query", "missing_query_once"))
        .when(free("filter") & filter_ok, act("inject", "filter", "memory_filter"))
        .when(free("rank") & time_mismatch, act("inject", "rank", "time_mismatch_rank"))
        .otherwise(act("stop", None, "no_operator"))
    )


def geometric_slot(kind: Column, n_eff_time: Column, n_eff_alias: Column, used: Column) -> Column:
    """Slot for a gap without evidence review: query, then rank, as far as unused and backed by enough hits."""
    free = lambda slot: ~F.array_contains(used, slot)
    thin = ((kind == "alias") & (n_eff_alias < MIN_NEFF)) | ((kind == "time") & (n_eff_time < MIN_NEFF))
    rank_thin = (kind == "time") & (n_eff_time < MIN_NEFF)
    return F.when(kind.isin("sufficient", "unanswerable", "unknown"), F.lit(None).cast("string")).when(free("query") & ~thin, "query").when(free("rank") & ~rank_thin, "rank")
