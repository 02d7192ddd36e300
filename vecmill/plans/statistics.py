"""Weighted statistics, gaps, signals and decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.operators import policy
from vecmill.plans import base
from vecmill.plans.base import r, sql_hits
from vecmill.plans.registry import query
from vecmill.session import table

_W = f"""{sql_hits(20)}, x AS (
  SELECT *, exp(greatest(-40, least(40, (sim - max(sim) OVER (PARTITION BY query_id)) / 0.15::DOUBLE))) AS e15, exp(greatest(-40, least(40, sim - max(sim) OVER (PARTITION BY query_id)))) AS e1 FROM hits),
w AS (SELECT *, e15 / sum(e15) OVER (PARTITION BY query_id) AS w, e1 / sum(e1) OVER (PARTITION BY query_id) AS w1 FROM x)"""


@query("softmax_weights", f"WITH {_W} SELECT query_id, doc_id, {r('w')} AS w FROM w")
def softmax_weights(spark, sf_dir):
    return S.with_softmax(base.hits(spark, sf_dir, 20), ["query_id"], "sim", "w").select("query_id", "doc_id", S.steady(F.col("w")).alias("w"))


@query("kish_neff", f"WITH {_W} SELECT query_id, {r('pow(sum(w), 2) / sum(w * w)')} AS n_eff, {r('pow(sum(w1), 2) / sum(w1 * w1)')} AS n_eff_flat FROM w GROUP BY query_id")
def kish_neff(spark, sf_dir):
    rows = S.with_softmax(S.with_softmax(base.hits(spark, sf_dir, 20), ["query_id"], "sim", "w"), ["query_id"], "sim", "w1", 1.0)
    return rows.groupBy("query_id").agg(S.steady(S.kish(F.col("w"))).alias("n_eff"), S.steady(S.kish(F.col("w1"))).alias("n_eff_flat"))


_BY_TYPE = "SELECT event_type, event_id, value, 1 + user_id % 5 AS w FROM events"


@query("weighted_std", f"""WITH e AS ({_BY_TYPE}), m AS (SELECT event_type, sum(w * value) / sum(w) AS mu FROM e GROUP BY 1)
SELECT event_type, {r('sqrt(sum(w * pow(value - mu, 2)) / sum(w))', 4)} AS spread FROM e JOIN m USING (event_type) GROUP BY event_type""")
def weighted_std(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", 1 + F.col("user_id") % 5)
    return e.groupBy("event_type").agg(S.steady(S.weighted_spread(F.col("value"), F.col("w")), 4).alias("spread"))


@query("weighted_median", f"""WITH e AS ({_BY_TYPE}), c AS (
  SELECT *, sum(w) OVER (PARTITION BY event_type ORDER BY value, event_id ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY event_type)::DOUBLE AS c FROM e)
SELECT event_type, min(value) AS median FROM c WHERE c >= 0.5 - 1e-12 GROUP BY event_type""")
def weighted_median(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("w", 1 + F.col("user_id") % 5)
    return S.weighted_median(e, ["event_type"], "value", "w", "event_id")


@query("time_quantile", f"WITH {base.SQL_DATED} SELECT event_type, {r('quantile_cont(time_days, 0.9)')} AS q90 FROM events JOIN dated ON doc_id = event_id GROUP BY event_type")
def time_quantile(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.col("event_id").alias("doc_id")).join(base.dated(spark, sf_dir), "doc_id")
    return e.groupBy("event_type").agg(S.steady(F.percentile("time_days", 0.9)).alias("q90"))


_TIME = f"""{_W}, tw AS (SELECT *, w1 / sum(w1) OVER (PARTITION BY query_id) AS tw FROM w WHERE time_days IS NOT NULL),
mu AS (SELECT *, sum(tw * time_days) OVER (PARTITION BY query_id) / sum(tw) OVER (PARTITION BY query_id) AS mu FROM tw),
g AS (SELECT query_id, count(*) AS n_dated, pow(sum(tw), 2) / sum(tw * tw) AS n_eff, sqrt(sum(tw * pow(time_days - mu, 2)) / sum(tw)) / 365.25::DOUBLE AS years FROM mu GROUP BY query_id),
gt AS (SELECT *, CASE WHEN n_dated < 2 OR n_eff < 5 THEN 0 ELSE 1 / (1 + exp(-4 * (years / 0.35::DOUBLE - 1))) END AS g_time FROM g)"""


@query("time_gap", f"WITH {_TIME} SELECT query_id, n_dated, {r('n_eff')} AS n_eff, {r('years')} AS spread_years, {r('g_time')} AS g_time FROM gt")
def time_gap(spark, sf_dir):
    g = policy.time_gap(base.hits(spark, sf_dir, 20))
    return g.select("query_id", "n_dated", *[S.steady(F.col(c)).alias(c) for c in ("n_eff", "spread_years", "g_time")])


# Dates are stretched by 40, so that thresholds of months apply to the month that the events span.
_SIGNALS = f"""{_W}, st AS (SELECT query_id, doc_id, sim, w, (time_days - 738886) * 40 AS t FROM w WHERE time_days IS NOT NULL),
s1 AS (SELECT *, sum(w * t) OVER (PARTITION BY query_id) / sum(w) OVER (PARTITION BY query_id) AS mu FROM st),
s2 AS (SELECT *, quantile_cont(t, 0.9) OVER (PARTITION BY query_id) AS t_star, greatest(30, sqrt(sum(w * pow(t - mu, 2)) OVER (PARTITION BY query_id) / sum(w) OVER (PARTITION BY query_id))) AS sigma
  FROM (SELECT * FROM s1)),
s3 AS (SELECT *, exp(-greatest(0, t_star - t) / sigma) AS kappa FROM s2),
sig AS (SELECT *, CASE WHEN t < t_star - sigma AND sim > 0 THEN 'neg' WHEN kappa >= exp(-1::DOUBLE) THEN 'pos' END AS side FROM s3),
lam AS (SELECT query_id, avg(kappa) FILTER (side = 'pos') AS kp, coalesce(avg(kappa) FILTER (side = 'neg'), 0) AS kn, avg(sim) FILTER (side = 'pos') AS sp, coalesce(avg(sim) FILTER (side = 'neg'), 0) AS sn FROM sig GROUP BY query_id),
lh AS (SELECT query_id, CASE WHEN kp IS NULL THEN 0 ELSE least(0.6::DOUBLE, abs(kp - kn) / (abs(kp - kn) + abs(sp - sn) + 1e-8)) END AS lambda_hat FROM lam)"""


def _stretched(spark, sf_dir):
    return base.hits(spark, sf_dir, 20).withColumn("time_days", (F.col("time_days") - 738886) * 40)


@query("time_signals", f"WITH {_SIGNALS} SELECT query_id, doc_id, {r('t_star')} AS t_star, {r('sigma')} AS sigma, {r('kappa')} AS kappa, side FROM sig")
def time_signals(spark, sf_dir):
    s = policy.time_signals(_stretched(spark, sf_dir))
    return s.select("query_id", "doc_id", *[S.steady(F.col(c)).alias(c) for c in ("t_star", "sigma", "kappa")], "side")


@query("lambda_estimate", f"WITH {_SIGNALS} SELECT query_id, {r('lambda_hat')} AS lambda_hat FROM lh")
def lambda_estimate(spark, sf_dir):
    return policy.recency_weight(policy.time_signals(_stretched(spark, sf_dir))).select("query_id", S.steady(F.col("lambda_hat")).alias("lambda_hat"))


@query("rank_update", f"""WITH {_SIGNALS}, c AS (SELECT query_id, lambda_hat, unnest([0.0, 0.5])::DOUBLE AS prev FROM lh), b AS (SELECT *, unnest([true, false]) AS boost FROM c), a AS (SELECT *, unnest([true, false, NULL]) AS allowed FROM b),
n AS (SELECT query_id, bool_or(coalesce(side = 'neg', false)) AS neg FROM sig GROUP BY query_id),
raised AS (SELECT a.*, neg, CASE WHEN boost THEN greatest(lambda_hat, 0.4::DOUBLE) WHEN allowed THEN greatest(lambda_hat, 0.35::DOUBLE) ELSE lambda_hat END AS raised FROM a JOIN n USING (query_id)),
held AS (SELECT *, greatest(least(raised, prev + 0.35::DOUBLE), prev - 0.35::DOUBLE) AS held FROM raised)
SELECT query_id, prev, boost, coalesce(allowed::VARCHAR, 'unset') AS allowed, {r('CASE WHEN NOT allowed THEN 0 WHEN boost THEN least(0.6::DOUBLE, greatest(held, 0.4::DOUBLE)) ELSE held END')} AS lam, CASE WHEN neg THEN 0.35::DOUBLE ELSE 0 END AS eta_soft FROM held""")
def rank_update(spark, sf_dir):
    """Every combination of an earlier value, a boost and permission."""
    signals = policy.time_signals(_stretched(spark, sf_dir))
    negative = signals.groupBy("query_id").agg(F.bool_or(F.coalesce(F.col("side") == "neg", F.lit(False))).alias("neg"))
    rows = policy.recency_weight(signals).join(negative, "query_id")
    rows = rows.withColumn("prev", F.explode(F.array(F.lit(0.0), F.lit(0.5)))).withColumn("boost", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("allowed", F.explode(F.array(F.lit(True), F.lit(False), F.lit(None).cast("boolean"))))
    out = policy.rank_update(F.col("prev"), F.col("lambda_hat"), F.col("boost"), F.col("allowed"), F.col("neg"))
    return rows.withColumn("u", out).select("query_id", "prev", "boost", F.coalesce(F.col("allowed").cast("string"), F.lit("unset")).alias("allowed"), S.steady(F.col("u.lam")).alias("lam"), F.col("u.eta_soft").alias("eta_soft"))


@query("filter_update", f"""WITH {sql_hits(40)}, b AS (SELECT query_id, doc_id, rk, label = query_label OR query_id % 100 = 0 AND rk <= 4 AS bound, doc_id % 2 = 0 AS relevant, doc_id % 3 = 0 AS negative FROM hits),
n AS (SELECT query_id, sum((NOT bound AND rk <= 5)::INT) AS n_unbound, list(doc_id ORDER BY rk) FILTER (NOT bound AND NOT relevant) AS ids, list(doc_id ORDER BY rk) FILTER (NOT bound AND NOT relevant AND negative) AS noisy FROM b GROUP BY query_id)
SELECT query_id, n_unbound >= 2 AS polluted, n_unbound::BIGINT AS n_unbound, coalesce(array_to_string((CASE WHEN n_unbound >= 2 THEN ids ELSE noisy END)[1:24], ','), '') AS drop_ids FROM n""")
def filter_update(spark, sf_dir):
    """Every second question has hits that are bound at the top, so that they are not polluted."""
    clean = (F.col("query_id") % 100 == 0) & (F.col("rk") <= 4)
    hits = base.hits(spark, sf_dir, 40).withColumn("bound", (F.col("label") == F.col("query_label")) | clean).withColumn("relevant", F.col("doc_id") % 2 == 0).withColumn("negative", F.col("doc_id") % 3 == 0)
    u = policy.filter_update(hits)
    return u.select("query_id", "polluted", F.col("n_unbound").cast("long").alias("n_unbound"), F.array_join(F.array_compact(F.col("drop_ids")).cast("array<string>"), ",").alias("drop_ids"))


@query("diagnose_gap", f"""WITH {_TIME}, t AS (SELECT query_id, max(sim) AS top_sim FROM hits WHERE query_id <> doc_id GROUP BY query_id),
v AS (SELECT query_id, g_time, top_sim - shift AS top_sim, greatest(0, (0.12::DOUBLE - (top_sim - shift)) / 0.12::DOUBLE) AS g_unans FROM gt JOIN t USING (query_id) CROSS JOIN (SELECT unnest([0, 0.35, 0.8])::DOUBLE AS shift))
SELECT query_id, {r('top_sim')} AS top_sim, {r('g_unans')} AS g_unans, CASE WHEN g_unans >= 0.8 THEN 'unanswerable' WHEN greatest(g_time, g_unans) < 0.2 THEN CASE WHEN top_sim >= 0.12 THEN 'sufficient' ELSE 'unknown' END
  WHEN g_time >= g_unans THEN 'time' ELSE 'unanswerable' END AS kind FROM v""")
def diagnose_gap(spark, sf_dir):
    """The kind of gap, with the top similarity as it is and lowered twice to pass the thresholds."""
    hits = base.hits(spark, sf_dir, 20)
    top = hits.where("query_id <> doc_id").groupBy("query_id").agg(F.max("sim").alias("top"))
    rows = policy.time_gap(hits).join(top, "query_id").withColumn("shift", F.explode(F.array(F.lit(0.0), F.lit(0.35), F.lit(0.8)))).withColumn("top_sim", F.col("top") - F.col("shift"))
    rows = rows.withColumn("g_unans", policy.unanswerable_gap(F.col("top_sim")))
    kind = policy.gap_kind(F.col("g_time"), F.lit(0.0), F.col("g_unans"), F.col("top_sim"), F.lit(False), F.lit(False))
    return rows.select("query_id", S.steady(F.col("top_sim")).alias("top_sim"), S.steady(F.col("g_unans")).alias("g_unans"), kind.alias("kind"))


_BITS = ["unans", "covers", "dead_end", "missing", "hop_ok", "filter_ok", "mismatch", "used_query", "used_filter", "used_rank"]
_DECIDED = """CASE WHEN unans THEN 'stop::unanswerable' WHEN covers THEN 'stop::enough' WHEN round = 3 THEN 'stop::max_rounds'
 WHEN dead_end AND filter_ok AND NOT used_filter THEN 'inject:filter:dead_end_filter' WHEN dead_end THEN 'stop::dead_end_stop'
 WHEN missing AND hop_ok AND NOT used_query THEN 'inject:query:missing_query_once' WHEN filter_ok AND NOT used_filter THEN 'inject:filter:memory_filter'
 WHEN mismatch AND NOT used_rank THEN 'inject:rank:time_mismatch_rank' ELSE 'stop::no_operator' END"""


@query("decide_action", f"""WITH n AS (SELECT i FROM range(2048) t(i)), c AS (SELECT i, 2 + (i // 1024) AS round, {', '.join(f'(i >> {k}) & 1 = 1 AS {b}' for k, b in enumerate(_BITS))} FROM n)
SELECT i, {_DECIDED} AS action FROM c""")
def decide_action(spark, sf_dir):
    """The whole truth table of the state machine, over rounds 2 and 3."""
    rows = spark.range(2048).withColumnRenamed("id", "i").withColumn("round", 2 + F.shiftright("i", 10)).withColumns({b: F.shiftright("i", k).bitwiseAND(F.lit(1)) == 1 for k, b in enumerate(_BITS)})
    used = F.array_compact(F.array(*[F.when(F.col(f"used_{s}"), s) for s in ("query", "filter", "rank")]))
    c = F.col
    act = policy.next_action(c("covers"), c("unans"), c("round"), F.lit(3), c("dead_end"), c("missing"), c("hop_ok"), c("filter_ok"), c("mismatch"), used)
    return rows.withColumn("a", act).select("i", F.concat("a.kind", F.lit(":"), F.coalesce("a.slot", F.lit("")), F.lit(":"), "a.why").alias("action"))


@query("geometric_slot", """WITH n AS (SELECT i, (['time', 'alias', 'unanswerable', 'sufficient', 'unknown'])[1 + i % 5] AS kind, 3.0 + 3 * ((i // 5) % 2) AS nt, 3.0 + 3 * ((i // 10) % 2) AS na, (i // 20) % 2 = 1 AS uq, (i // 40) % 2 = 1 AS ur FROM range(80) t(i))
SELECT i, CASE WHEN kind IN ('unanswerable', 'sufficient', 'unknown') THEN NULL WHEN NOT uq AND NOT ((kind = 'alias' AND na < 5) OR (kind = 'time' AND nt < 5)) THEN 'query' WHEN NOT ur AND NOT (kind = 'time' AND nt < 5) THEN 'rank' END AS slot FROM n""")
def geometric_slot(spark, sf_dir):
    i = F.col("i")
    kinds = F.array(*map(F.lit, ["time", "alias", "unanswerable", "sufficient", "unknown"]))
    bit = lambda d: F.floor(i / d) % 2
    used = F.array_compact(F.array(F.when(bit(20) == 1, "query"), F.when(bit(40) == 1, "rank")))
    slot = policy.geometric_slot(F.element_at(kinds, (i % 5 + 1).cast("int")), 3.0 + 3 * bit(5), 3.0 + 3 * bit(10), used)
    return spark.range(80).withColumnRenamed("id", "i").select("i", slot.alias("slot"))


def sql_two_means(hits: str = "hits", prefix: str = "km") -> str:
    """WITH-parts of twelve Lloyd steps over a relation (query_id, doc_id, rk, e); the last one is {prefix} (query_id, doc_id, cluster)."""
    d = lambda c: f"list_inner_product(h.e, h.e) - 2 * list_inner_product(h.e, {c}) + list_inner_product({c}, {c})"
    parts = [
        f"{prefix}f AS MATERIALIZED (SELECT query_id, e AS a FROM {hits} WHERE rk = 1)",
        f"{prefix}c0 AS MATERIALIZED (SELECT f.query_id, any_value(f.a) AS a, arg_min(h.e, list_inner_product(h.e, f.a) + h.rk * 1e-13) AS b FROM {prefix}f f JOIN {hits} h USING (query_id) GROUP BY f.query_id)",
    ]
    for i in range(policy.LLOYD_STEPS):
        label = f"({d('c.b')} < {d('c.a')} - 1e-12)"
        parts.append(f"{prefix}l{i} AS MATERIALIZED (SELECT h.query_id, h.doc_id, h.e, {label} AS far FROM {hits} h JOIN {prefix}c{i} c USING (query_id))")
        mean = lambda side: f"(SELECT query_id, list(m ORDER BY i) AS m FROM (SELECT query_id, i, avg(x) AS m FROM (SELECT query_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {prefix}l{i} WHERE {side}) GROUP BY query_id, i) GROUP BY query_id)"  # noqa: E731, B023
        parts.append(f"{prefix}c{i + 1} AS MATERIALIZED (SELECT c.query_id, coalesce(p.m, c.a) AS a, coalesce(n.m, c.b) AS b FROM {prefix}c{i} c LEFT JOIN {mean('NOT far')} p USING (query_id) LEFT JOIN {mean('far')} n USING (query_id))")
    last = policy.LLOYD_STEPS - 1
    parts.append(f"{prefix} AS MATERIALIZED (SELECT query_id, doc_id, far::INT AS cluster FROM {prefix}l{last})")
    return ", ".join(parts)


def sql_means(rows: str, keys: str, value: str = "avg(x)") -> str:
    """A mean vector m per key of rows (keys, e, ...); value may use x and w."""
    return f"(SELECT {keys}, list(m ORDER BY i) AS m FROM (SELECT {keys}, i, {value} AS m FROM (SELECT *, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM {rows}) GROUP BY {keys}, i) GROUP BY {keys})"


_HITS = f"{sql_hits(20, 'found')}, hits AS MATERIALIZED (SELECT * FROM found), {sql_two_means()}, k AS MATERIALIZED (SELECT hits.*, cluster FROM hits JOIN km USING (query_id, doc_id)), kc AS MATERIALIZED {sql_means('k', 'query_id, cluster')}"
_APART = "kd AS (SELECT a.query_id, list_distance(a.m, b.m) AS separation FROM kc a JOIN kc b ON a.query_id = b.query_id AND a.cluster = 0 AND b.cluster = 1)"
SQL_ALIAS_GAP = f"""{_APART}, ks AS (SELECT *, exp(greatest(-40, least(40, sim - max(sim) OVER (PARTITION BY query_id)))) AS e1 FROM k),
ka AS (SELECT query_id, count(*) AS n_hits, pow(sum(e1), 2) / sum(e1 * e1) AS n_eff, avg(sim) FILTER (cluster = 0) AS s0, avg(sim) FILTER (cluster = 1) AS s1 FROM ks GROUP BY query_id),
ga AS (SELECT ka.*, separation, CASE WHEN NOT (n_hits < 5 OR n_eff < 5 OR s0 IS NULL OR s1 IS NULL) THEN least(s0, s1) / greatest(s0, s1, 1e-8) END AS balance FROM ka LEFT JOIN kd USING (query_id)),
gap_alias AS (SELECT query_id, n_hits, n_eff, balance, separation, CASE WHEN balance IS NULL THEN 0 ELSE greatest(0, least(1, balance / (1 + exp(-4 * (separation / 0.25::DOUBLE - 1))))) END AS g_alias FROM ga)"""


@query("alias_gap", f"WITH {_HITS}, {SQL_ALIAS_GAP} SELECT query_id, n_hits, {r('n_eff')} AS n_eff, {r('balance')} AS balance, {r('separation')} AS separation, {r('g_alias')} AS g_alias FROM gap_alias")
def alias_gap(spark, sf_dir):
    """Two-means over each query's hits."""
    g = policy.alias_gap(policy.two_means(base.hits(spark, sf_dir, 20)))
    return g.select("query_id", "n_hits", *[S.steady(F.col(c)).alias(c) for c in ("n_eff", "balance", "separation", "g_alias")])


@query("alias_signals", f"""WITH {_HITS}, q AS (SELECT query_id, list(m / greatest(t, 1e-8) ORDER BY i) AS m FROM (SELECT query_id, i, sum(sim * x) AS m FROM (SELECT query_id, sim, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM k) GROUP BY query_id, i) JOIN (SELECT query_id, sum(sim) AS t FROM k GROUP BY query_id) USING (query_id) GROUP BY query_id),
best AS (SELECT query_id, arg_min(cluster, list_distance(kc.m, q.m) + cluster * 1e-13) AS pos FROM kc JOIN q USING (query_id) GROUP BY query_id)
SELECT query_id, doc_id, CASE WHEN cluster = pos THEN 'pos' ELSE 'neg' END AS side FROM k JOIN best USING (query_id)""")
def alias_signals(spark, sf_dir):
    """Hits of the cluster nearer to the similarity-weighted mean are positive, the other cluster is negative."""
    return policy.alias_signals(policy.two_means(base.hits(spark, sf_dir, 20))).select("query_id", "doc_id", "side")


@query("multihop_rank", f"""WITH {_HITS}, o AS (SELECT query_id, doc_id, sim, cluster, (label = query_label)::INT::DOUBLE AS ov FROM k),
m AS (SELECT query_id, cluster, avg(ov) AS mov, avg(sim) AS ms, count(*) AS n FROM o GROUP BY ALL), f AS (SELECT query_id, arg_max(cluster, (mov, ms, -cluster)) AS first, sum(n) AS n FROM m GROUP BY query_id)
SELECT query_id, doc_id, CASE WHEN cluster <> first AND f.n >= 4 AND mov > 1e-6 THEN 0.12::DOUBLE ELSE 0 END AS bonus, CASE WHEN ov < 1e-6 THEN 0.25::DOUBLE ELSE 0 END AS penalty FROM o JOIN m USING (query_id, cluster) JOIN f USING (query_id)""")
def multihop_rank(spark, sf_dir):
    """Bonus for the second cluster of hits where it has overlap with the question, penalty for hits without any."""
    hits = policy.two_means(base.hits(spark, sf_dir, 20)).withColumn("ov", F.when(F.col("label") == F.col("query_label"), 1.0).otherwise(F.lit(0.0)))
    return policy.multihop(hits).select("query_id", "doc_id", "bonus", "penalty")
