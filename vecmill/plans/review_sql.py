"""The evidence review in SQL, for DuckDB: WITH-parts from a relation of hits to one row per question."""

from __future__ import annotations

from vecmill.functions import text as T
from vecmill.operators import review
from vecmill.plans.texts import SQL_GROUPS, SQL_VARIANTS, lit, sql_binds, sql_body, sql_class, sql_list, sql_terms, sql_value


# Borders of words as Unicode has them, where this dialect's own know ASCII only.
_EDGE = r"[^\p{L}\p{N}_]"
_PROPER = rf"(?:^|{_EDGE})([A-Z][a-zA-Z0-9'-]*[a-zA-Z0-9])(?:$|{_EDGE})"


def bounded(word: str) -> str:
    return f"'(?i)(?:^|{_EDGE})' || {word} || '(?:$|{_EDGE})'"


def _proper(text: str) -> str:
    spaced = f"regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_''-])', '\\1\\1', 'g')"  # so that a border serves two words
    return f"list_transform(regexp_extract_all({spaced}, {lit(_PROPER)}, 1), lambda v: lower(v))"


def _heads(q: str) -> list[str]:
    found = []
    for pattern in review.WH_HEADS:
        head = f"regexp_extract({q}, {lit(pattern)}, 1)"
        found += [sql_terms(head), f"CASE WHEN regexp_matches(lower(trim({head})), '^[a-z][a-z0-9''-]{{1,}}$') THEN [lower(trim({head}))] ELSE [] END"]
    return found


def sql_review(hits: str, prefix: str) -> str:
    """hits: query_id, question, doc_id, rk, text, time_days, query_days. The result is {prefix} (query_id, covers, cause,
    first_cause, slot, hop, proxy, relevant_ids, soft_ids, hard_ids, time_mismatch, missing_terms)."""
    p = prefix
    body = sql_body("question")
    heads = ", ".join(_heads("body"))
    cue = " OR ".join(f"contains(lower(question), {lit(c)})" for c in T.TIME_CUES)
    mention = lambda k: f"(list_contains(terms, {k}) OR regexp_matches(coalesce(text, ''), {bounded(k)}))"
    return f"""{SQL_GROUPS},
{p}q0 AS (SELECT query_id, any_value(question) AS question, max(query_days) AS query_days FROM {hits} GROUP BY query_id),
{p}q1 AS MATERIALIZED (SELECT *, {body} AS body, {sql_class('question', 0)} AS cls, {sql_class('question', 1)} AS grain, {sql_class('question', 3)} AS tail, {sql_binds('question')} AS binds FROM {p}q0),
{p}q2 AS MATERIALIZED (SELECT *, {sql_terms('body')} AS qterms, list_filter(flatten([{heads}, {_proper('body')}]), lambda v: NOT list_contains({sql_list(T.GENERIC + T.STOP)}, v)) AS found FROM {p}q1),
{p}q3 AS MATERIALIZED (SELECT *, CASE WHEN len(found) > 0 THEN list_distinct(found) ELSE list_filter(qterms, lambda v: NOT list_contains({sql_list(T.GENERIC)}, v)) END AS keys,
  CASE WHEN len(binds) = 0 THEN '' ELSE substr(array_to_string(list_append(binds[1:5], tail), ' '), 1, 80) END AS hop FROM {p}q2),
{p}v AS MATERIALIZED (SELECT query_id, list(DISTINCT v) AS variants FROM (SELECT query_id, unnest({SQL_VARIANTS}) AS v FROM (SELECT query_id, unnest(binds[1:6]) AS b FROM {p}q3) LEFT JOIN syn ON w = b) GROUP BY query_id),
{p}h0 AS MATERIALIZED (SELECT h.query_id, doc_id, rk, text, time_days, {sql_terms('text')} AS terms, substr(coalesce(text, ''), 1, {review.READ_CHARS}) AS front FROM {hits} h),
{p}h1 AS MATERIALIZED (SELECT h.*, {sql_terms('front')} AS front_terms, q.question, q.query_days, q.keys, q.qterms, q.cls, q.grain, q.binds, coalesce(v.variants, []) AS variants, CASE WHEN len(keys) > 0 THEN keys ELSE qterms END AS asked FROM {p}h0 h JOIN {p}q3 q USING (query_id) LEFT JOIN {p}v v USING (query_id)),
{p}h2 AS MATERIALIZED (SELECT *, coalesce(len(list_intersect(asked, terms)) / nullif(len(asked), 0)::DOUBLE, 0) AS ov, coalesce(len(list_intersect(keys, terms)) / nullif(len(keys), 0)::DOUBLE, 0) AS cov,
  CASE WHEN rk <= 3 THEN list_filter(keys, lambda k: {mention('k')}) ELSE [] END AS mentioned,
  rk <= 3 AND (len(binds) = 0 OR len(list_filter(variants, lambda v: list_contains(front_terms, v) OR regexp_matches(front, {bounded('v')}))) > 0) AND {sql_value('front')} AS asserted FROM {p}h1),
{p}f AS (SELECT query_id, list_distinct(flatten(list(mentioned))) AS present, bool_or(asserted) AS covers FROM {p}h2 GROUP BY query_id),
{p}h3 AS MATERIALIZED (SELECT h.*, covers, len(present) > 0 AND len(list_intersect(present, terms)) / len(present)::DOUBLE >= {review.RELEVANT} AS relevant, coalesce(time_days < query_days - {review.YEAR}, false) AS old FROM {p}h2 h JOIN {p}f USING (query_id)),
{p}h4 AS MATERIALIZED (SELECT *, NOT relevant AND ov >= {review.IRRELEVANT} AND old AS hard FROM {p}h3),
{p}e AS (SELECT query_id, any_value(question) AS question, bool_or(covers) AS covers, coalesce(list(doc_id ORDER BY rk) FILTER (relevant), []) AS relevant_ids, coalesce(list(doc_id ORDER BY rk) FILTER (NOT relevant AND NOT hard), []) AS soft_ids, coalesce(list(doc_id ORDER BY rk) FILTER (hard), []) AS hard_ids,
  count(*) FILTER (relevant AND rk <= 3) AS top_relevant, count(time_days) AS n_dated, max(time_days) - min(time_days) AS spread, coalesce(min(time_days) FILTER (relevant) < coalesce(max(query_days), max(time_days)) - {review.YEAR}, false) AS old_relevant,
  2.0 * coalesce(avg(cov) FILTER (rk <= 3), 0) + coalesce(avg((cov >= {review.RELEVANT})::INT) FILTER (rk <= 3), 0) + 0.3 * avg(cov) AS proxy, list_distinct(flatten(list(terms))) AS bag FROM {p}h4 GROUP BY query_id),
{p}m AS (SELECT e.*, q.hop, ({cue.replace('question', 'e.question')}) AND n_dated >= 3 AND (spread > {review.HALF_YEAR} OR old_relevant) AS time_mismatch, len(relevant_ids) > 0 AND top_relevant < least(2, len(relevant_ids)) AS noise, list_sort(list_filter(q.qterms, lambda t: NOT list_contains(bag, t)))[1:{review.MISSING_TERMS}] AS missing_terms FROM {p}e e JOIN {p}q3 q USING (query_id)),
{p} AS MATERIALIZED (SELECT query_id, covers, hop, proxy, relevant_ids, soft_ids, hard_ids, time_mismatch, missing_terms,
  CASE WHEN NOT covers AND hop <> '' THEN 'unrecalled' WHEN NOT covers OR len(relevant_ids) = 0 THEN 'rank_refine' WHEN time_mismatch THEN 'time_mismatch' WHEN noise THEN 'noise_top3' ELSE 'rank_refine' END AS cause,
  CASE WHEN NOT covers AND hop <> '' THEN 'unrecalled' WHEN len(relevant_ids) = 0 THEN 'semantic_gap' WHEN time_mismatch THEN 'time_mismatch' WHEN noise THEN 'noise_top3' ELSE 'rank_refine' END AS first_cause,
  CASE WHEN NOT covers AND hop <> '' THEN 'query' ELSE 'rank' END AS slot FROM {p}m)"""
