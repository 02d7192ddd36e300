"""The loop of `vecmill.operators.loop` in SQL, its rounds written out, for DuckDB."""

from __future__ import annotations

from vecmill.plans import base
from vecmill.plans.memory_sql import sql_shown
from vecmill.plans.statistics import sql_means, sql_two_means

K, ROUNDS = 20, 3


def _softmax(x: str, keys: str, temperature: str) -> str:
    e = f"exp(greatest(-40, least(40, ({x} - max({x}) OVER (PARTITION BY {keys})) / {temperature}::DOUBLE)))"
    return e


def _round(n: int) -> list[str]:
    s, h = f"state{n}", f"hits{n}"
    rec = "CASE WHEN c.time_days IS NULL OR s.t_star IS NULL OR s.sigma IS NULL THEN 0 ELSE exp(-greatest(0, s.t_star - c.time_days) / greatest(s.sigma, 1e-8)) END"
    fused = f"round((1 - lam) * list_inner_product(s.q, c.e) + lam * {rec} - CASE WHEN list_contains(soft_ids, c.doc_id) THEN eta_soft ELSE 0 END, 9)"
    parts = [
        f"""{h} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM (
  SELECT s.query_id, c.doc_id, c.e, c.time_days, s.lam, list_inner_product(s.q, c.e) AS sim, CASE WHEN lam > 0 OR eta_soft > 0 THEN {fused} ELSE list_inner_product(s.q, c.e) END AS score FROM {s} s CROSS JOIN corpus c)) WHERE rk <= {K})""",
        f"td{n} AS (SELECT *, {_softmax('sim', 'query_id', '1')} AS w FROM {h} WHERE time_days IS NOT NULL)",
        f"tm{n} AS (SELECT query_id, sum(w * time_days) / sum(w) AS mu, count(*) AS nd, pow(sum(w), 2) / sum(w * w) AS n_eff FROM td{n} GROUP BY query_id)",
        f"""tg{n} AS (SELECT d.query_id, any_value(nd) AS nd, any_value(n_eff) AS n_eff, any_value(lam) AS lam, sqrt(greatest(0, sum(w * pow(time_days - mu, 2)) / sum(w))) / 365.25::DOUBLE AS spread FROM td{n} d JOIN tm{n} m USING (query_id) GROUP BY d.query_id)""",
        f"gt{n} AS MATERIALIZED (SELECT query_id, CASE WHEN nd < 2 THEN 0 ELSE n_eff END AS n_eff_time, CASE WHEN nd < 2 OR n_eff < 5 THEN 0 ELSE greatest(0, least(1, (1 - lam) / (1 + exp(-4 * (spread / 0.35::DOUBLE - 1))))) END AS g_time FROM tg{n})",
        sql_two_means(h, f"km{n}_"),
        f"k{n} AS MATERIALIZED (SELECT h.*, cluster FROM {h} h JOIN km{n}_ USING (query_id, doc_id))",
        f"kc{n} AS MATERIALIZED {sql_means(f'k{n}', 'query_id, cluster')}",
        f"kd{n} AS (SELECT a.query_id, list_distance(a.m, b.m) AS separation FROM kc{n} a JOIN kc{n} b ON a.query_id = b.query_id AND a.cluster = 0 AND b.cluster = 1)",
        f"ks{n} AS (SELECT *, {_softmax('sim', 'query_id', '1')} AS w FROM k{n})",
        f"ka{n} AS (SELECT query_id, count(*) AS nh, pow(sum(w), 2) / sum(w * w) AS n_eff, avg(sim) FILTER (cluster = 0) AS s0, avg(sim) FILTER (cluster = 1) AS s1 FROM ks{n} GROUP BY query_id)",
        f"""ga{n} AS MATERIALIZED (SELECT query_id, n_eff AS n_eff_alias, CASE WHEN nh < 5 OR n_eff < 5 OR s0 IS NULL OR s1 IS NULL THEN 0 ELSE greatest(0, least(1, least(s0, s1) / greatest(s0, s1, 1e-8) / (1 + exp(-4 * (separation / 0.25::DOUBLE - 1))))) END AS g_alias FROM ka{n} LEFT JOIN kd{n} USING (query_id))""",
        f"ft{n} AS (SELECT query_id, arg_min(sim, rk) AS top_sim, (list(time_days ORDER BY rk))[1] AS top_days, list(doc_id ORDER BY rk) AS top FROM {h} GROUP BY query_id)",
        f"""dg{n} AS (SELECT f.query_id, top_sim, top_days, top, coalesce(g_time, 0) AS gt, coalesce(g_alias, 0) AS ga, greatest(0, (0.12::DOUBLE - top_sim) / 0.12::DOUBLE) AS gu, coalesce(n_eff_time, 0) AS nt, coalesce(n_eff_alias, 0) AS na, used,
  list_contains(used, 'rank') AND coalesce(top_days >= t_star - coalesce(sigma, 1), false) AS rank_done, list_contains(used, 'query') AND len(pos_ids) > 0 AND len(list_filter(top[1:3], lambda x: NOT list_contains(pos_ids, x))) = 0 AS query_done
  FROM ft{n} f LEFT JOIN gt{n} USING (query_id) LEFT JOIN ga{n} USING (query_id) JOIN {s} USING (query_id))""",
        f"""gk{n} AS (SELECT *, CASE WHEN gu >= 0.8 THEN 'unanswerable' WHEN rank_done OR query_done THEN 'sufficient' WHEN greatest(gt, ga, gu) < 0.2 THEN CASE WHEN top_sim >= 0.12 THEN 'sufficient' ELSE 'unknown' END
  WHEN gt = greatest(gt, ga, gu) THEN 'time' WHEN ga = greatest(gt, ga, gu) THEN 'alias' ELSE 'unanswerable' END AS gap FROM dg{n})""",
        f"""act{n} AS MATERIALIZED (SELECT query_id, gap, top, CASE WHEN {n} = {ROUNDS} OR gap IN ('sufficient', 'unanswerable', 'unknown') THEN NULL WHEN NOT list_contains(used, 'query') AND NOT ((gap = 'alias' AND na < 5) OR (gap = 'time' AND nt < 5)) THEN 'query'
  WHEN NOT list_contains(used, 'rank') AND NOT (gap = 'time' AND nt < 5) THEN 'rank' END AS slot FROM gk{n})""",
        f"stop{n} AS (SELECT query_id, {n} AS round, gap, slot, true AS accepted, CASE WHEN gap IN ('sufficient', 'unanswerable', 'unknown') THEN gap WHEN {n} = {ROUNDS} THEN 'max_rounds' ELSE 'no eligible slot' END AS why, top FROM act{n} WHERE slot IS NULL)",
        f"final{n} AS (SELECT query_id, doc_id, rk, score FROM {h} WHERE query_id IN (SELECT query_id FROM stop{n}))",
        f"full{n} AS (SELECT *, '' AS focus, 0::DOUBLE AS omega, 0::DOUBLE AS eta_hard, [] AS hard_ids, [] AS div_ids, 0::DOUBLE AS delta, []::VARCHAR[] AS binds, [] AS drop_ids, false AS require_bind, 0::DOUBLE AS filter_eta FROM {s})",
        f"paper{n} AS (SELECT query_id, document FROM {sql_shown(f'full{n}')} WHERE query_id IN (SELECT query_id FROM stop{n}))",
    ]
    if n == ROUNDS:
        return parts
    return [
        *parts,
        f"go{n} AS MATERIALIZED (SELECT k.*, gap, slot FROM k{n} k JOIN act{n} USING (query_id) WHERE slot IS NOT NULL)",
        f"ts{n} AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS nd, {_softmax('sim', 'query_id', '0.15')} AS w, quantile_cont(time_days, 0.9) OVER (PARTITION BY query_id) AS t1 FROM go{n} WHERE gap <> 'alias' AND time_days IS NOT NULL)",
        f"tt{n} AS (SELECT query_id, sum(w * time_days) / sum(w) AS mu FROM ts{n} GROUP BY query_id)",
        f"tv{n} AS (SELECT t.query_id, greatest(30, sqrt(greatest(0, sum(w * pow(time_days - mu, 2)) / sum(w)))) AS sg FROM ts{n} t JOIN tt{n} USING (query_id) GROUP BY t.query_id)",
        f"tk{n} AS (SELECT t.query_id, doc_id, e, sim, t1, sg, exp(-greatest(0, t1 - time_days) / sg) AS kappa, CASE WHEN time_days < t1 - sg AND sim > 0 THEN 'neg' WHEN exp(-greatest(0, t1 - time_days) / sg) >= exp(-1::DOUBLE) THEN 'pos' END AS side FROM ts{n} t JOIN tv{n} USING (query_id) WHERE nd >= 2)",
        f"aq{n} AS (SELECT query_id, list(m ORDER BY i) AS m FROM (SELECT query_id, i, sum(sim * x) / greatest(any_value(t), 1e-8) AS m FROM (SELECT query_id, sim, t, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM go{n} JOIN (SELECT query_id, sum(sim) AS t FROM go{n} GROUP BY query_id) USING (query_id) WHERE gap = 'alias') GROUP BY query_id, i) GROUP BY query_id)",
        f"ab{n} AS (SELECT query_id, arg_min(cluster, list_distance(kc.m, q.m) + cluster * 1e-13) AS pos FROM kc{n} kc JOIN aq{n} q USING (query_id) GROUP BY query_id)",
        f"sd{n} AS MATERIALIZED (SELECT * FROM tk{n} UNION ALL SELECT g.query_id, doc_id, e, sim, NULL, NULL, NULL, CASE WHEN cluster = pos THEN 'pos' ELSE 'neg' END FROM go{n} g JOIN ab{n} USING (query_id))",
        f"si{n} AS (SELECT query_id, max(t1) AS new_t, max(sg) AS new_sigma, list(doc_id) FILTER (side = 'pos') AS pos, list(doc_id) FILTER (side = 'neg') AS neg FROM sd{n} GROUP BY query_id)",
        f"sw{n} AS (SELECT *, {_softmax('sim', 'query_id, side', '0.15')} AS w FROM sd{n} WHERE side IS NOT NULL)",
        f"sm{n} AS MATERIALIZED {sql_means(f'sw{n}', 'query_id, side', 'sum(w * x) / sum(w)')}",
        f"lh{n} AS (SELECT query_id, avg(kappa) FILTER (side = 'pos') AS kp, coalesce(avg(kappa) FILTER (side = 'neg'), 0) AS kn, avg(sim) FILTER (side = 'pos') AS sp, coalesce(avg(sim) FILTER (side = 'neg'), 0) AS sn FROM sd{n} WHERE t1 IS NOT NULL GROUP BY query_id)",
        f"""mv{n} AS MATERIALIZED (SELECT s.*, a.gap, a.top, p.m AS pm, m.m AS nm, new_t, new_sigma, coalesce(pos, []) AS pos, coalesce(neg, []) AS neg, CASE WHEN a.slot = 'query' AND p.m IS NULL AND m.m IS NULL THEN 'rank' ELSE a.slot END AS slot, a.slot AS asked,
  CASE WHEN kp IS NULL THEN 0 ELSE least(0.6::DOUBLE, abs(kp - kn) / (abs(kp - kn) + abs(sp - sn) + 1e-8)) END AS lh
  FROM {s} s JOIN act{n} a USING (query_id) LEFT JOIN si{n} USING (query_id) LEFT JOIN lh{n} USING (query_id) LEFT JOIN sm{n} p ON p.query_id = s.query_id AND p.side = 'pos' LEFT JOIN sm{n} m ON m.query_id = s.query_id AND m.side = 'neg' WHERE a.slot IS NOT NULL)""",
        f"""mq{n} AS (SELECT *, list_transform(q0, lambda x, i: x + 0.75::DOUBLE * coalesce(pm[i], 0) - 0.15::DOUBLE * coalesce(nm[i], 0)) AS raw,
  CASE WHEN slot = 'rank' AND len(pos) = 0 THEN pos_ids ELSE pos END AS pos1, CASE WHEN slot = 'rank' AND len(neg) = 0 THEN soft_ids ELSE neg END AS neg1, greatest(least(lh, lam + 0.35::DOUBLE), lam - 0.35::DOUBLE) AS lam1 FROM mv{n})""",
        f"""mb{n} AS MATERIALIZED (SELECT *, CASE WHEN len(neg1) > 0 THEN 0.35::DOUBLE ELSE 0 END AS eta1, CASE WHEN slot = 'rank' THEN
  CASE WHEN list_contains(used, 'query') AND (beta <> 0 OR gamma <> 0) AND (len(pos1) <> len(pos_ids) OR len(neg1) <> len(soft_ids)) THEN 'another slot changed' WHEN lam1 = 0 AND len(neg1) = 0 THEN 'the slot did not change' END END AS broken FROM mq{n})""",
        f"""state{n + 1} AS MATERIALIZED (SELECT query_id, q0, CASE WHEN broken IS NULL AND slot = 'query' THEN list_transform(raw, lambda x: x / greatest(sqrt(list_inner_product(raw, raw)), 1e-8)) ELSE q END AS q,
  CASE WHEN broken IS NULL AND slot = 'query' THEN CASE WHEN pm IS NULL THEN 0 ELSE 0.75::DOUBLE END ELSE beta END AS beta, CASE WHEN broken IS NULL AND slot = 'query' THEN CASE WHEN nm IS NULL THEN 0 ELSE 0.15::DOUBLE END ELSE gamma END AS gamma,
  CASE WHEN broken IS NULL AND slot = 'rank' THEN lam1 ELSE lam END AS lam, CASE WHEN broken IS NULL THEN coalesce(new_t, t_star) ELSE t_star END AS t_star, CASE WHEN broken IS NULL THEN coalesce(new_sigma, sigma) ELSE sigma END AS sigma,
  CASE WHEN broken IS NULL THEN pos1 ELSE pos_ids END AS pos_ids, CASE WHEN broken IS NULL THEN neg1 ELSE soft_ids END AS soft_ids, CASE WHEN broken IS NULL AND slot = 'rank' THEN eta1 ELSE eta_soft END AS eta_soft,
  CASE WHEN broken IS NULL THEN list_append(used, slot) ELSE used END AS used FROM mb{n})""",
        f"went{n} AS (SELECT query_id, {n} AS round, gap, slot, broken IS NULL AS accepted, coalesce('rollback: ' || broken, 'compiled ' || asked) AS why, top FROM mb{n})",
    ]


def sql_evolve() -> str:
    """WITH-parts evidence (query_id, doc_id, rk, score) and log (query_id, round, gap, slot, accepted, why, top)."""
    parts = [
        base.SQL_UNIT, base.SQL_DATED,
        "corpus AS MATERIALIZED (SELECT u.vec_id AS doc_id, u.u AS e, (t.time_days - 738886) * 40 AS time_days FROM unit u LEFT JOIN dated t ON t.doc_id = u.vec_id)",
        f"state1 AS MATERIALIZED (SELECT vec_id AS query_id, u AS q0, u AS q, 0::DOUBLE AS beta, 0::DOUBLE AS gamma, 0::DOUBLE AS lam, NULL::DOUBLE AS t_star, NULL::DOUBLE AS sigma, []::BIGINT[] AS pos_ids, []::BIGINT[] AS soft_ids, 0::DOUBLE AS eta_soft, []::VARCHAR[] AS used FROM unit WHERE vec_id % {base.EVERY} = 0)",
    ]
    for n in range(1, ROUNDS + 1):
        parts += _round(n)
    parts.append("evidence AS (" + " UNION ALL ".join(f"SELECT * FROM final{n}" for n in range(1, ROUNDS + 1)) + ")")
    parts.append("log AS (" + " UNION ALL ".join([*(f"SELECT * FROM stop{n}" for n in range(1, ROUNDS + 1)), *(f"SELECT * FROM went{n}" for n in range(1, ROUNDS))]) + ")")
    parts.append("papers AS (" + " UNION ALL ".join(f"SELECT * FROM paper{n}" for n in range(1, ROUNDS + 1)) + ")")
    return ", ".join(parts)
