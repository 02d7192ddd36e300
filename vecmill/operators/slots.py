"""The writable slots of a policy document: their bodies from a question's state, and what a round may change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecmill.functions import text as T

# The formulas as the slots show them.
QUERY_SAME, RANK_SAME, FILTER_SAME = "恒等：q' = q", "恒等：score(d) = sim(q, d)", "恒等：keep(d) = true"
QUERY_FORMULA = "Rocchio（向量空间，禁止文本拼接）\nq' = normalize(α q + β μ+ − γ μ−)\nα=%.4f β=%.4f γ=%.4f\n|M+|=%d |M−|=%d（仅计数与 id 指纹，无正文）"
FOCUS_FORMULA = "memory-informed query focus（关键词，禁止粘贴会话正文）\nfocus: %s\nslate: S(d)=max(sim(q0,d), ω sim(v_slot,d)) − γ sim(μ_noise,d) (only if high noise-sim and low q0-sim); q stays q0\nω=%.4f γ=%.4f α=%.4f β_miss=%.4f"
RANK_FORMULA = "线性融合（dense 内核不变；时序 κ / 多跳互补簇）\nscore(d) = (1−λ) sim(q', d) + λ κ(t_d) − η_s 1[d ∈ M_soft−] − η_h 1[d ∈ M_hard−] + δ 1[d ∈ D_div]\nκ(t) = exp(−max(0, t* − t) / σ)\nλ=%.4f η_s=%.4f η_h=%.4f t*=%s σ=%s\n|M_soft−|=%d |M_hard−|=%d"
HOPS_FORMULA = "\nmulti-hop: +δ 1[d ∈ D_div] δ=%.4f |D_div|=%d"
FILTER_FORMULA = "约束过滤（仅 bind 词与 id 指纹，禁止会话正文）\nscore(d) ← score(d) − η_f if d ∈ D_drop or (require_bind ∧ bind ∩ d = ∅)\nrequire_bind=%d η_f=%.4f |D_drop|=%d bind=%s\nD_drop ids: %s"
SHOWN_IDS, FOCUS_CHARS = 8, 120


def query_body(active: Column, focus: Column, omega: Column, alpha: Column, beta: Column, gamma: Column, n_pos: Column, n_neg: Column) -> Column:
    """Text of the query slot; active: the slot was changed before."""
    focused = F.when(F.trim(focus) != "", F.format_string(FOCUS_FORMULA, F.substring(F.trim(focus), 1, FOCUS_CHARS), omega, gamma, alpha, beta))
    moved = F.when(active & ((beta != 0) | (gamma != 0)), F.format_string(QUERY_FORMULA, alpha, beta, gamma, n_pos, n_neg))
    text = F.concat_ws("\n", focused, moved)
    return F.when(text == "", QUERY_SAME).otherwise(text)


def rank_body(active: Column, lam: Column, eta_soft: Column, eta_hard: Column, t_star: Column, sigma: Column, n_soft: Column, n_hard: Column, n_div: Column | None = None, delta: Column | None = None) -> Column:
    """Text of the rank slot; n_div, delta: texts of other clusters and their bonus, where a question needs several texts."""
    n_div, delta = F.lit(0) if n_div is None else n_div, F.lit(0.0) if delta is None else delta
    number = lambda x: F.coalesce(F.format_string("%.2f", x), F.lit("na"))
    shown = lambda x: F.when(x.isNull(), "na").otherwise(number(x))
    text = F.format_string(RANK_FORMULA, lam, eta_soft, eta_hard, shown(t_star), shown(sigma), n_soft, n_hard)
    text = F.concat(text, F.when(n_div > 0, F.format_string(HOPS_FORMULA, delta, n_div)).otherwise(""))
    return F.when(active & ((lam != 0) | (eta_soft != 0) | (eta_hard != 0) | (n_div > 0)), text).otherwise(RANK_SAME)


def filter_body(active: Column, require_bind: Column, eta: Column, drop_ids: Column, binds: Column) -> Column:
    ids = drop_ids.cast("array<string>")
    listed = F.concat(F.array_join(F.slice(ids, 1, SHOWN_IDS), ","), F.when(F.size(ids) > SHOWN_IDS, ",...").otherwise(""))
    dash = lambda x: F.when(x == "", "-").otherwise(x)
    text = F.format_string(FILTER_FORMULA, require_bind.cast("int"), eta, F.size(ids), dash(F.array_join(F.slice(binds, 1, SHOWN_IDS), ",")), dash(listed))
    return F.when(active & ((F.size(ids) > 0) | require_bind | (eta != 0)), text).otherwise(FILTER_SAME)


#: A document with nothing but the three slots.
DOCUMENT = "# Policy\n\n" + "\n\n".join(f"## {n.title()}\n<!-- EVOLVE:{n}:START -->\n<!-- EVOLVE:{n}:END -->" for n in T.SLOTS) + "\n"


def rendered(document: Column, bodies: dict[str, Column]) -> Column:
    """The document with these bodies in its slots."""
    for name, body in bodies.items():
        document = T.with_slot(document, name.upper(), body)
    return document


def document_violation(slot: Column, baseline: Column, before: Column, after: Column) -> Column:
    """Why a changed document is not allowed, or null, as far as it can be told from documents alone: a slot is lost, or `violation`."""
    lost = F.lit(False)
    for name in T.SLOTS:
        lost = lost | ~F.contains(after, F.lit(f"<!-- EVOLVE:{name}:START -->")) | ~F.contains(after, F.lit(f"<!-- EVOLVE:{name}:END -->"))
    bodies = lambda d: {n.lower(): T.slot_body(d, n) for n in T.SLOTS}
    return F.when(lost, "a slot is missing").otherwise(violation(slot, bodies(before), bodies(after), T.backbone(baseline), T.backbone(after)))


def violation(slot: Column, before: dict[str, Column], after: dict[str, Column], backbone_before: Column, backbone_after: Column) -> Column:
    """Why a round's change is not allowed, or null: only the chosen slot's body may change, it has to, and nothing else may."""
    changed = {name: ~before[name].eqNullSafe(after[name]) for name in before}
    others = F.lit(False)
    for name, c in changed.items():
        others = others | (c & (slot != name))
    chosen = F.coalesce(*[F.when(slot == name, c) for name, c in changed.items()])
    return (
        F.when(~backbone_before.eqNullSafe(backbone_after), "backbone changed").when(chosen.isNull(), "unknown slot")
        .when(others, "another slot changed").when(~chosen, "the slot did not change")
    )


def flags(gold_rank: Column, was_missing: Column, still_missing: Column, action: Column) -> Column:
    """Tags for a traced round: what the rank of the gold text says about the action taken."""
    return F.array_compact(F.array(
        F.when(was_missing & ~still_missing, "missing cleared by rule"), F.when((gold_rank <= 3) & (action == "query"), "gold in top 3, still query"),
        F.when((gold_rank > 5) & (action == "stop"), "gold beyond 5, stopped"), F.when((gold_rank > 3) & (gold_rank <= 10) & (action == "stop"), "gold in 4 to 10, stopped"),
        F.when(action == "query-dead-end", "dead end"),
    ))
