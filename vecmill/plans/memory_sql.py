"""The loop of `vecmill.operators.memory` over conversations in SQL, its rounds written out, for DuckDB."""

from __future__ import annotations

from vecmill.functions import text as T
from vecmill.operators import policy
from vecmill.plans.review_sql import bounded, sql_review
from vecmill.plans.statistics import sql_means, sql_two_means
from vecmill.plans.texts import SQL_GROUPS, SQL_VARIANTS, lit, sql_binds, sql_list, sql_terms

K, ROUNDS, DIM = 5, 3, 64


def sql_hashed(rows: str, key: str, text: str) -> str:
    """(key, e): the stand-in encoder over rows (key, text)."""
    return f"""(SELECT {key}, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-8)) AS e FROM (
  SELECT {key}, list(coalesce(x, 0) ORDER BY b)::DOUBLE[] AS v FROM (SELECT {key}, unnest(range({DIM})) AS b FROM {rows}) LEFT JOIN (
    SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT % {DIM} AS b, sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM (SELECT {key}, md5(unnest({sql_terms(text)})) AS h FROM {rows}) GROUP BY ALL) USING ({key}, b) GROUP BY {key}))"""


def _unit(v: str) -> str:
    return f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-8))"


def _without(v: str, axis: str) -> str:
    """v without its part along axis."""
    return f"CASE WHEN {axis} IS NULL OR sqrt(list_inner_product({axis}, {axis})) < 1e-8 THEN {v} ELSE list_transform({v}, lambda x, i: x - list_inner_product({v}, {axis}) / list_inner_product({axis}, {axis}) * {axis}[i]) END"


def _softmax(x: str, keys: str, temperature: str) -> str:
    return f"exp(greatest(-40, least(40, ({x} - max({x}) OVER (PARTITION BY {keys})) / {temperature}::DOUBLE)))"


def _printf(template: str, *values: str) -> str:
    return f"printf({lit(template)}, {', '.join(values)})"


#: The slots' texts, written out again.
_SAME = ("恒等：q' = q", "恒等：score(d) = sim(q, d)", "恒等：keep(d) = true")
_FOCUS = "memory-informed query focus（关键词，禁止粘贴会话正文）\nfocus: %s\nslate: S(d)=max(sim(q0,d), ω sim(v_slot,d)) − γ sim(μ_noise,d) (only if high noise-sim and low q0-sim); q stays q0\nω=%.4f γ=%.4f α=1.0000 β_miss=%.4f"
_MOVED = "Rocchio（向量空间，禁止文本拼接）\nq' = normalize(α q + β μ+ − γ μ−)\nα=1.0000 β=%.4f γ=%.4f\n|M+|=%d |M−|=%d（仅计数与 id 指纹，无正文）"
_RANK = "线性融合（dense 内核不变；时序 κ / 多跳互补簇）\nscore(d) = (1−λ) sim(q', d) + λ κ(t_d) − η_s 1[d ∈ M_soft−] − η_h 1[d ∈ M_hard−] + δ 1[d ∈ D_div]\nκ(t) = exp(−max(0, t* − t) / σ)\nλ=%.4f η_s=%.4f η_h=%.4f t*=%s σ=%s\n|M_soft−|=%d |M_hard−|=%d"
_HOPS = "\nmulti-hop: +δ 1[d ∈ D_div] δ=%.4f |D_div|=%d"
_FILTER = "约束过滤（仅 bind 词与 id 指纹，禁止会话正文）\nscore(d) ← score(d) − η_f if d ∈ D_drop or (require_bind ∧ bind ∩ d = ∅)\nrequire_bind=%d η_f=%.4f |D_drop|=%d bind=%s\nD_drop ids: %s"
_NUMBER = "CASE WHEN {0} IS NULL THEN 'na' ELSE printf('%.2f', {0}) END"
_DASH = "CASE WHEN {0} = '' THEN '-' ELSE {0} END"
SQL_QUERY_BODY = f"coalesce(nullif(concat_ws(chr(10), CASE WHEN focus <> '' THEN {_printf(_FOCUS, 'focus[1:120]', 'omega', 'gamma', 'beta')} END, CASE WHEN list_contains(used, 'query') AND (beta <> 0 OR gamma <> 0) THEN {_printf(_MOVED, 'beta', 'gamma', 'len(pos_ids)', 'len(soft_ids)')} END), ''), {lit(_SAME[0])})"
SQL_RANK_BODY = f"CASE WHEN list_contains(used, 'rank') AND (lam <> 0 OR eta_soft <> 0 OR eta_hard <> 0 OR len(div_ids) > 0) THEN {_printf(_RANK, 'lam', 'eta_soft', 'eta_hard', _NUMBER.format('t_star'), _NUMBER.format('sigma'), 'len(soft_ids)', 'len(hard_ids)')} || CASE WHEN len(div_ids) > 0 THEN {_printf(_HOPS, 'delta', 'len(div_ids)')} ELSE '' END ELSE {lit(_SAME[1])} END"
_DROPS = "array_to_string(list_transform(drop_ids[1:8], lambda x: x::VARCHAR), ',') || CASE WHEN len(drop_ids) > 8 THEN ',...' ELSE '' END"
SQL_FILTER_BODY = f"CASE WHEN list_contains(used, 'filter') AND (len(drop_ids) > 0 OR require_bind OR filter_eta <> 0) THEN {_printf(_FILTER, 'require_bind::INT', 'filter_eta', 'len(drop_ids)', _DASH.format("(array_to_string(binds[1:8], ','))"), _DASH.format(f"({_DROPS})"))} ELSE {lit(_SAME[2])} END"
SQL_DOCUMENT = "'# Policy' || chr(10)" + "".join(f" || chr(10) || '## {n.title()}' || chr(10) || '<!-- EVOLVE:{n}:START -->' || chr(10) || {b} || chr(10) || '<!-- EVOLVE:{n}:END -->' || chr(10)" for n, b in (("QUERY", "query_body"), ("RANK", "rank_body"), ("FILTER", "filter_body")))


def sql_shown(state: str) -> str:
    """A relation of states with query_body, rank_body, filter_body and document."""
    return f"(SELECT *, {SQL_DOCUMENT} AS document FROM (SELECT *, {SQL_QUERY_BODY} AS query_body, {SQL_RANK_BODY} AS rank_body, {SQL_FILTER_BODY} AS filter_body FROM {state}))"


_FIELDS = "question query_days task q0 q v mu omega beta gamma focus pos_ids soft_ids hard_ids eta_soft eta_hard lam t_star sigma div_ids delta binds drop_ids require_bind filter_eta used proxy last".split()


def _round(n: int, rounds: int, forced: str, probe: bool) -> list[str]:
    s, h = f"state{n}", f"hits{n}"
    rec = "CASE WHEN t.time_days IS NULL OR t_star IS NULL OR sigma IS NULL THEN 0 ELSE exp(-greatest(0, t_star - t.time_days) / greatest(sigma, 1e-8)) END"
    parts = [
        f"""sc{n} AS MATERIALIZED (SELECT t.*, s.question, s.query_days, omega, gamma, lam, soft_ids, hard_ids, eta_soft, eta_hard, div_ids, delta, used, require_bind, filter_eta, drop_ids, list_inner_product(q0, e) AS s0, list_inner_product(q, e) AS sq, CASE WHEN v IS NOT NULL THEN list_inner_product({_unit('v')}, e) END AS sv, CASE WHEN mu IS NOT NULL THEN list_inner_product({_unit('mu')}, e) END AS mud, {rec} AS rec FROM texts t JOIN {s} s USING (query_id))""",
        f"sm{n} AS (SELECT *, CASE WHEN sv IS NOT NULL AND omega > 0 THEN greatest(s0, omega * sv) ELSE sq END - CASE WHEN mud IS NOT NULL AND gamma > 0 AND mud > 0.4::DOUBLE AND s0 < 0.5::DOUBLE THEN gamma * mud ELSE 0 END AS sim FROM sc{n})",
        f"sf{n} AS (SELECT *, round((1 - lam) * sim + lam * rec - CASE WHEN list_contains(hard_ids, doc_id) THEN CASE WHEN eta_hard > 0 THEN eta_hard ELSE 0.5::DOUBLE END WHEN list_contains(soft_ids, doc_id) THEN eta_soft ELSE 0 END + CASE WHEN list_contains(div_ids, doc_id) THEN delta ELSE 0 END - CASE WHEN list_contains(used, 'filter') AND filter_eta > 0 AND (list_contains(drop_ids, doc_id) OR require_bind AND NOT bound) THEN filter_eta ELSE 0 END, 9) AS score FROM sm{n})",
        f"{h} AS MATERIALIZED (SELECT * FROM (SELECT query_id, question, query_days, doc_id, text, e, time_days, sim, score, bound, n_binds, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM sf{n}) WHERE rk <= {K})",
        sql_review(h, f"rv{n}"),
        f"fa{n} AS (SELECT query_id, max(sim) AS top_sim, count(*) FILTER (NOT bound AND rk <= {policy.POLLUTED_TOP}) AS unbound, max(n_binds) AS n_binds FROM {h} GROUP BY query_id)",
        f"""dc{n} AS (SELECT r.*, used, last = 'query' AND r.proxy <= s.proxy + 1e-6 AS dead, n_binds > 0 AND unbound >= {policy.POLLUTED_LEAST} AS filter_ok, greatest(0, (0.12::DOUBLE - top_sim) / 0.12::DOUBLE) >= 0.8 AS unans FROM rv{n} r JOIN {s} s USING (query_id) JOIN fa{n} USING (query_id))""",
        f"""act{n} AS MATERIALIZED (SELECT *, CASE WHEN unans THEN ['', 'unanswerable'] WHEN covers THEN ['', 'enough'] WHEN {n} = {rounds} THEN ['', 'max_rounds'] WHEN dead AND filter_ok AND NOT list_contains(used, 'filter') THEN ['filter', 'dead_end_filter'] WHEN dead THEN ['', 'dead_end_stop']
  WHEN hop <> '' AND NOT list_contains(used, 'query') THEN ['query', 'missing_query_once'] WHEN NOT list_contains(used, 'filter') AND filter_ok THEN ['filter', 'memory_filter'] WHEN NOT list_contains(used, 'rank') AND time_mismatch THEN ['rank', 'time_mismatch_rank'] ELSE ['', 'no_operator'] END AS act FROM dc{n})""",
        f"stop{n} AS (SELECT query_id, {n} AS round, covers, cause, NULL::VARCHAR AS slot, true AS accepted, act[2] AS why, hop, proxy FROM act{n} WHERE act[1] = '')",
        f"final{n} AS (SELECT query_id, doc_id, rk, score FROM {h} WHERE query_id IN (SELECT query_id FROM act{n} WHERE act[1] = ''))",
        f"paper{n} AS (SELECT query_id, document FROM {sql_shown(s)} WHERE query_id IN (SELECT query_id FROM act{n} WHERE act[1] = ''))",
    ]
    if n == rounds:
        return parts
    by = lambda name, query=None, rank=None, filter_=None: f"CASE slot {''.join(f'WHEN {lit(k)} THEN {v} ' for k, v in (('query', query), ('rank', rank), ('filter', filter_)) if v)}ELSE {name} END AS {name}"
    either = lambda new, old: f"CASE WHEN len({new}) > 0 THEN {new} ELSE {old} END"
    union = lambda *lists: f"list_distinct(list_concat({', '.join(lists)}))"
    after = [
        by("q", query=f"CASE WHEN towards THEN {_unit('raw')} ELSE q0 END"), by("v", query="v1"), by("mu", query=f"CASE WHEN NOT towards THEN {_without('a1', 'b1')} END"), by("omega", query="CASE WHEN found THEN 0.85::DOUBLE ELSE 0 END"),
        by("beta", query="CASE WHEN found THEN 0.85::DOUBLE WHEN towards THEN 0.75::DOUBLE ELSE 0 END"), by("gamma", query="CASE WHEN found OR towards THEN 0.15::DOUBLE ELSE 0 END"), by("focus", query="CASE WHEN trim(hop) <> '' THEN trim(hop) ELSE focus END"),
        by("pos_ids", query=either("pos1", "pos_ids"), rank="CASE WHEN task = 'multihop' THEN " + either("main", "pos_ids") + " ELSE " + either("sig_pos", "pos_ids") + " END"),
        by("soft_ids", query="CASE WHEN len(soft1) > 0 THEN soft1 WHEN towards THEN list_concat(soft1, hard1) ELSE soft_ids END", rank="soft2"), by("hard_ids", query=either("hard1", "hard_ids"), rank="hard2"),
        by("eta_soft", rank="CASE WHEN len(soft2) = 0 THEN 0 WHEN task = 'multihop' THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END"), by("eta_hard", rank="CASE WHEN task = 'multihop' THEN CASE WHEN coalesce(n_hits, 0) >= 4 THEN 0 ELSE eta_hard END WHEN len(hard2) > 0 THEN 0.5::DOUBLE ELSE eta_hard END"),
        by("lam", rank="CASE WHEN task = 'multihop' OR NOT boost THEN 0 ELSE least(0.6::DOUBLE, greatest(held, 0.4::DOUBLE)) END"), by("t_star", query="CASE WHEN towards THEN query_days ELSE t_star END", rank="CASE WHEN task = 'multihop' THEN t_star ELSE coalesce(new_t, t_star) END"),
        by("sigma", query="CASE WHEN towards THEN 30::DOUBLE ELSE sigma END", rank="CASE WHEN task = 'multihop' THEN sigma ELSE coalesce(new_sigma, sigma) END"), by("div_ids", rank="CASE WHEN task = 'multihop' THEN others ELSE div_ids END"),
        by("delta", rank="CASE WHEN task = 'multihop' THEN CASE WHEN len(others) > 0 THEN 0.12::DOUBLE ELSE 0 END ELSE delta END"), by("binds", filter_="own_binds"), by("drop_ids", filter_="drops"), by("require_bind", filter_="polluted"),
        by("filter_eta", filter_="CASE WHEN polluted OR len(drops) > 0 THEN 0.75::DOUBLE ELSE 0 END"), "list_append(used, slot) AS used", "proxy1 AS proxy", "slot AS last",
    ]
    slot = "'query'" if probe else "act[1]"
    listed = lambda condition: f"coalesce(list(doc_id ORDER BY rk) FILTER ({condition}), [])"
    return [
        *parts,
        f"go{n} AS MATERIALIZED (SELECT query_id, {slot} AS slot, hop, relevant_ids AS pos1, soft_ids AS soft1, hard_ids AS hard1, time_mismatch, proxy AS proxy1, CASE WHEN {slot} = 'rank' THEN task ELSE '' END AS way FROM act{n} JOIN (SELECT query_id, task FROM {s}) USING (query_id) WHERE {'hop' if probe else slot} <> '')",
        f"ph{n} AS MATERIALIZED (SELECT query_id, hop FROM go{n} WHERE slot = 'query')",
        f"pv{n} AS MATERIALIZED {sql_hashed(f'ph{n}', 'query_id', 'hop')}",
        f"jd{n} AS MATERIALIZED (SELECT h.*, way, list_contains(pos1, doc_id) AS relevant, list_contains(soft1, doc_id) OR list_contains(hard1, doc_id) AS negative FROM {h} h JOIN go{n} USING (query_id))",
        f"jr{n} AS (SELECT * FROM jd{n} WHERE relevant)", f"jn{n} AS (SELECT * FROM jd{n} WHERE negative)",
        f"mm{n} AS MATERIALIZED {sql_means(f'jd{n}', 'query_id')}", f"mp{n} AS MATERIALIZED {sql_means(f'jr{n}', 'query_id')}", f"mn{n} AS MATERIALIZED {sql_means(f'jn{n}', 'query_id')}",
        f"dr{n} AS (SELECT query_id, polluted, CASE WHEN polluted THEN stray ELSE noisy END[1:{policy.DROP_CAP}] AS drops FROM (SELECT query_id, count(*) FILTER (NOT bound AND rk <= {policy.POLLUTED_TOP}) >= {policy.POLLUTED_LEAST} AS polluted, {listed('NOT bound AND NOT relevant')} AS stray, {listed('NOT bound AND NOT relevant AND negative')} AS noisy FROM jd{n} GROUP BY query_id))",
        # every hit has a verdict of the review, so the review's sides always exist where the task is not time
        f"rs{n} AS (SELECT query_id, doc_id, rk, sim, query_days AS t1, 30::DOUBLE AS sg, exp(-greatest(0, query_days - time_days) / 30) AS kappa, CASE WHEN relevant THEN 'pos' WHEN negative THEN 'neg' END AS side FROM jd{n} WHERE way <> 'time')",
        f"ts{n} AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS nd, {_softmax('sim', 'query_id', '0.15')} AS w FROM jd{n} WHERE way = 'time' AND time_days IS NOT NULL)",
        f"tt{n} AS (SELECT query_id, sum(w * time_days) / sum(w) AS m FROM ts{n} GROUP BY query_id)",
        f"tv{n} AS (SELECT t.query_id, greatest(30, sqrt(greatest(0, sum(w * pow(time_days - m, 2)) / sum(w)))) AS sg FROM ts{n} t JOIN tt{n} USING (query_id) GROUP BY t.query_id)",
        f"tk{n} AS (SELECT t.query_id, doc_id, rk, sim, query_days AS t1, sg, exp(-greatest(0, query_days - time_days) / sg) AS kappa, CASE WHEN time_days < query_days - sg AND sim > 1e-12 THEN 'neg' WHEN exp(-greatest(0, query_days - time_days) / sg) >= exp(-1::DOUBLE) THEN 'pos' END AS side FROM ts{n} t JOIN tv{n} USING (query_id) WHERE nd >= 2)",
        f"sd{n} AS MATERIALIZED (SELECT * FROM rs{n} UNION ALL SELECT * FROM tk{n})",
        f"lh{n} AS (SELECT query_id, max(t1) AS new_t, max(sg) AS new_sigma, {listed('side = ' + lit('pos'))} AS sig_pos, {listed('side = ' + lit('neg'))} AS sig_neg, avg(kappa) FILTER (side = 'pos') AS kp, coalesce(avg(kappa) FILTER (side = 'neg'), 0) AS kn, avg(sim) FILTER (side = 'pos') AS sp, coalesce(avg(sim) FILTER (side = 'neg'), 0) AS sn FROM sd{n} GROUP BY query_id)",
        f"mj{n} AS MATERIALIZED (SELECT * FROM jd{n} WHERE way = 'multihop')",
        sql_two_means(f"mj{n}", f"mk{n}_"),
        f"mo{n} AS MATERIALIZED (SELECT j.query_id, j.doc_id, j.rk, j.sim, cluster, cov AS ov FROM mj{n} j JOIN mk{n}_ USING (query_id, doc_id) JOIN rv{n}h2 r ON r.query_id = j.query_id AND r.doc_id = j.doc_id)",
        f"mc{n} AS (SELECT query_id, cluster, avg(ov) AS mov, avg(sim) AS ms, count(*) AS c FROM mo{n} GROUP BY ALL)",
        f"mf{n} AS (SELECT query_id, arg_max(cluster, (mov, ms, -cluster)) AS main_cluster, sum(c)::BIGINT AS n_hits FROM mc{n} GROUP BY query_id)",
        f"mh{n} AS (SELECT query_id, any_value(n_hits) AS n_hits, {listed('ov < 1e-6')} AS noise, {listed('cluster = main_cluster AND n_hits >= 4')} AS main, {listed('cluster <> main_cluster AND n_hits >= 4 AND mov > 1e-6')} AS others FROM mo{n} JOIN mc{n} USING (query_id, cluster) JOIN mf{n} USING (query_id) GROUP BY query_id)",
        f"""mv{n} AS MATERIALIZED (SELECT s.*, g.* EXCLUDE (query_id), pv.e AS v1, pv.e IS NOT NULL AS found, pv.e IS NULL AND len(pos1) > 0 AND len(soft1) + len(hard1) > 0 AS towards, task = 'time' OR time_mismatch AS boost, m.m, p.m AS pm, o.m AS nm, drops, polluted, new_t, new_sigma, coalesce(sig_pos, []) AS sig_pos, coalesce(sig_neg, []) AS sig_neg, n_hits, coalesce(noise, []) AS noise, coalesce(main, []) AS main, coalesce(others, []) AS others, b.binds AS own_binds,
  CASE WHEN kp IS NULL THEN 0 ELSE least(0.6::DOUBLE, abs(kp - kn) / (abs(kp - kn) + abs(sp - sn) + 1e-8)) END AS lh
  FROM {s} s JOIN go{n} g USING (query_id) JOIN bd b USING (query_id) LEFT JOIN pv{n} pv USING (query_id) LEFT JOIN mm{n} m USING (query_id) LEFT JOIN mp{n} p USING (query_id) LEFT JOIN mn{n} o USING (query_id) LEFT JOIN dr{n} USING (query_id) LEFT JOIN lh{n} USING (query_id) LEFT JOIN mh{n} USING (query_id))""",
        f"""mw{n} AS MATERIALIZED (SELECT *, {_without('m', 'q0')} AS a1, CASE WHEN v1 IS NOT NULL THEN {_without('v1', 'q0')} END AS b1, list_transform(q0, lambda x, i: x + 0.75::DOUBLE * coalesce(pm[i], 0) - 0.15::DOUBLE * coalesce(nm[i], 0)) AS raw,
  CASE WHEN task = 'multihop' THEN noise WHEN task = 'time' THEN {either('sig_neg', 'soft_ids')} ELSE {union(either('sig_neg', 'soft_ids'), 'soft1')} END AS soft2, CASE WHEN task = 'multihop' THEN CASE WHEN coalesce(n_hits, 0) >= 4 THEN [] ELSE hard_ids END WHEN task = 'time' THEN {union('sig_neg', 'hard1', 'hard_ids')} ELSE {union('hard1', 'hard_ids')} END AS hard2,
  greatest(least(CASE WHEN boost THEN greatest(lh, 0.4::DOUBLE) ELSE lh END, lam + 0.35::DOUBLE), lam - 0.35::DOUBLE) AS held FROM mv{n})""",
        f"made{n} AS MATERIALIZED (SELECT query_id, question, query_days, task, q0, {', '.join(after)} FROM mw{n})",
        f"shown{n} AS MATERIALIZED (SELECT a.query_id, a.last AS slot, {forced.format(n=n)} AS forced, b.document AS before, a.document AS made, b.query_body AS q1, a.query_body AS q2, b.rank_body AS r1, a.rank_body AS r2, b.filter_body AS f1, a.filter_body AS f2 FROM {sql_shown(f'made{n}')} a JOIN {sql_shown(s)} b USING (query_id))",
        f"""rule{n} AS MATERIALIZED (SELECT query_id, CASE forced WHEN 'backbone' THEN 'backbone changed' WHEN 'slots' THEN 'another slot changed' WHEN 'lost' THEN 'a slot is missing' END AS first_rule,
  CASE WHEN (slot <> 'query' AND q1 <> q2) OR (slot <> 'rank' AND r1 <> r2) OR (slot <> 'filter' AND f1 <> f2) THEN 'another slot changed' WHEN CASE slot WHEN 'query' THEN q1 = q2 WHEN 'rank' THEN r1 = r2 ELSE f1 = f2 END THEN 'the slot did not change' END AS rule,
  forced = 'passage' OR query_id IN (SELECT query_id FROM (SELECT query_id, regexp_replace(lower(made), '\\s+', '', 'g') AS tight FROM shown{n}) d JOIN pieces p USING (query_id) WHERE contains(tight, piece)) AS copies FROM shown{n})""",
        f"why{n} AS MATERIALIZED (SELECT query_id, {'NULL' if probe else "coalesce(first_rule, rule, CASE WHEN copies THEN 'a passage was copied' END)"} AS broken FROM rule{n})",
        f"state{n + 1} AS MATERIALIZED (SELECT query_id, {', '.join(f'CASE WHEN broken IS NULL THEN a.{c} ELSE b.{c} END AS {c}' for c in _FIELDS)} FROM made{n} a JOIN {s} b USING (query_id) JOIN why{n} USING (query_id))",
        f"went{n} AS (SELECT query_id, {n} AS round, covers, cause, act[1] AS slot, broken IS NULL AS accepted, coalesce('rollback: ' || broken, act[2]) AS why, hop, proxy FROM act{n} JOIN why{n} USING (query_id))",
    ]


#: The queries with tasks: every second conversation is asked a question without words to bind, all of its texts but one
#: speak of it, and texts are further apart.
CUED, SAID, GAPS, TASKS = "How long was it last year?", " It took long last year.", (40, 120), ["", "time", "multihop"]


def sql_memory(rounds: int = ROUNDS, cued: bool = False, forced: str = "''", probe: bool = False) -> str:
    """WITH-parts evidence (query_id, doc_id, rk, score), log (query_id, round, covers, cause, slot, accepted, why, hop,
    proxy) and papers (query_id, document). forced: SQL for the kind of violation that an editor forces on a.query_id in round
    {n}. probe: every question that has a phrase searches for it, unchecked."""
    distinctive = f"list_filter({sql_binds('question')}, lambda v: length(v) >= 4 AND NOT list_contains({sql_list(T.WEAK_BINDS)}, v))[1:6]"
    question = f"CASE WHEN conv_id % 2 = 1 THEN {lit(CUED)} ELSE text END" if cued else "text"
    task = f"({sql_list(TASKS)})[1 + (conv_id // 2) % 3]" if cued else "''"
    said = f"text || CASE WHEN turn > 1 AND conv_id % 2 = 1 THEN {lit(SAID)} ELSE '' END" if cued else "text"
    none = "[]::BIGINT[]"
    parts = [
        SQL_GROUPS,
        f"asked AS (SELECT conv_id AS query_id, text, {question} AS question, {task} AS task FROM conversations WHERE turn = 0)",
        f"later AS (SELECT conv_id AS query_id, conv_id * 100 + turn AS doc_id, {said} AS text, (738000 + turn * {GAPS[cued]})::DOUBLE AS time_days FROM conversations WHERE turn > 0)",
        f"qe AS MATERIALIZED {sql_hashed('asked', 'query_id', 'text')}",
        f"le AS MATERIALIZED {sql_hashed('later', 'doc_id', 'text')}",
        f"bd AS MATERIALIZED (SELECT query_id, {distinctive} AS binds FROM asked)",
        f"bv AS MATERIALIZED (SELECT query_id, list(DISTINCT v) AS variants FROM (SELECT query_id, unnest({SQL_VARIANTS}) AS v FROM (SELECT query_id, unnest(binds) AS b FROM bd) LEFT JOIN syn ON w = b) GROUP BY query_id)",
        f"""texts AS MATERIALIZED (SELECT l.*, e, len(binds) AS n_binds, len(binds) = 0 OR len(list_filter(variants, lambda v: list_contains({sql_terms('text')}, v) OR regexp_matches(coalesce(text, ''), {bounded('v')}))) > 0 AS bound FROM later l JOIN le USING (doc_id) JOIN bd USING (query_id) LEFT JOIN bv USING (query_id))""",
        "pieces AS MATERIALIZED (SELECT DISTINCT query_id, substr(s, place + 1, 24) AS piece FROM (SELECT query_id, s, unnest(range(0, length(s) - 23, 24)) AS place FROM (SELECT query_id, regexp_replace(lower(text), '\\s+', '', 'g') AS s FROM later)))",
        f"""state1 AS MATERIALIZED (SELECT a.query_id, question, 738640::DOUBLE AS query_days, task, e AS q0, e AS q, NULL::DOUBLE[] AS v, NULL::DOUBLE[] AS mu, 0::DOUBLE AS omega, 0::DOUBLE AS beta, 0::DOUBLE AS gamma, '' AS focus, {none} AS pos_ids, {none} AS soft_ids, {none} AS hard_ids, 0::DOUBLE AS eta_soft, 0::DOUBLE AS eta_hard, 0::DOUBLE AS lam, NULL::DOUBLE AS t_star, NULL::DOUBLE AS sigma,
  {none} AS div_ids, 0::DOUBLE AS delta, []::VARCHAR[] AS binds, {none} AS drop_ids, false AS require_bind, 0::DOUBLE AS filter_eta, []::VARCHAR[] AS used, -1::DOUBLE AS proxy, '' AS last FROM asked a JOIN qe USING (query_id))""",
    ]
    for n in range(1, rounds + 1):
        parts += [p.removeprefix(SQL_GROUPS + ",\n") for p in _round(n, rounds, forced, probe)]
    all_of = lambda name, last: " UNION ALL ".join(f"SELECT * FROM {name}{n}" for n in range(1, last + 1))
    parts += [f"evidence AS ({all_of('final', rounds)})", f"log AS ({all_of('stop', rounds)} UNION ALL {all_of('went', rounds - 1)})", f"papers AS ({all_of('paper', rounds)})"]
    return ", ".join(parts)
