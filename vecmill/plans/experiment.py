"""Experiments from texts to a verdict, slots of a policy document, and probes of single questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.functions import text as T
from vecmill.functions import vectors as V
from vecmill.operators import harness, memory, metrics, policy, review, search, sessions, slots
from vecmill.plans import base, evolve, memory_sql, texts
from vecmill.plans.base import r, sql_hits
from vecmill.plans.registry import query
from vecmill.plans.texts import lit, sql_list, sql_terms
from vecmill.session import table, written
from vecmill.sources import experiments

# An experiment with ids that are strings: items are queries, documents the corpus; a document is relevant to an item
# if it has the same first term.

CLAIMS = [("nDCG@10", 0.0), ("Recall@5", 0.5), ("MRR@10", 0.01), ("P@3", 0.2)]
def sql_run(docs: str = "(SELECT 'd' || doc_id AS doc_id, text, text AS said FROM documents WHERE text IS NOT NULL)", filed: str = "", name: str = "run") -> str:
    """WITH-parts up to the means x. docs: (doc_id, text, said), said having the term that decides relevance; filed: what is made of the run, called name."""
    return f"""d AS MATERIALIZED {docs}, q AS MATERIALIZED (SELECT 'i' || item_id AS query_id, text FROM benchmark),
de AS MATERIALIZED {memory_sql.sql_hashed('d', 'doc_id', 'text')}, qe AS MATERIALIZED {memory_sql.sql_hashed('q', 'query_id', 'text')},
run AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rk FROM (SELECT query_id, doc_id, list_inner_product(qe.e, de.e) AS sim FROM qe CROSS JOIN de)) WHERE rk <= 10),{filed}
rel AS MATERIALIZED (SELECT query_id, doc_id FROM (SELECT query_id, ({sql_terms('text')})[1] AS t FROM q) JOIN (SELECT doc_id, ({sql_terms('said')})[1] AS t FROM d) USING (t)),
n AS (SELECT query_id, count(*) AS n_rel FROM rel GROUP BY query_id), j AS (SELECT run.*, (rel.doc_id IS NOT NULL)::INT AS good FROM {name} run LEFT JOIN rel USING (query_id, doc_id)),
m AS (SELECT n.query_id, n_rel, sum(CASE WHEN rk <= 10 THEN good / log2(rk + 1) END) / list_sum([1 / log2(i + 1) FOR i IN range(1, least(n_rel, 10) + 1)]) AS ndcg, sum(CASE WHEN rk <= 5 THEN good END) / n_rel::DOUBLE AS recall, coalesce(1::DOUBLE / min(CASE WHEN good = 1 THEN rk END), 0) AS mrr, sum(CASE WHEN rk <= 3 THEN good END) / 3::DOUBLE AS p FROM n JOIN j USING (query_id) GROUP BY n.query_id, n_rel),
x AS (SELECT avg(ndcg) AS ndcg, avg(recall) AS recall, avg(mrr) AS mrr, avg(p) AS p, count(*) AS n_queries FROM m)"""


_RUN = sql_run()


def _experiment(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("query_id"), "text")
    first = lambda rows, key: rows.select(key, F.get(T.ordered_terms(F.col("text")), F.lit(0)).alias("t"))
    rel = first(items, "query_id").join(first(docs, "doc_id"), "t").select("query_id", "doc_id", F.lit(1).alias("rel"))
    queries = sessions.hashed_vectors(items, "query_id", "text").withColumnRenamed("e", "q")
    return search.exact_search(queries, sessions.hashed_vectors(docs, "doc_id", "text"), 10), rel


@query("ir_experiment", f"""WITH {_RUN}, v AS (SELECT unnest(['nDCG@10', 'Recall@5', 'MRR@10', 'P@3']) AS metric, unnest([ndcg, recall, mrr, p]) AS value FROM x), c(metric, target) AS (VALUES {', '.join(f"('{m}', {t}::DOUBLE)" for m, t in CLAIMS)}),
s AS (SELECT metric, CASE WHEN abs(value - target) <= CASE WHEN metric LIKE 'Recall%' THEN 0.02 ELSE 0.01 END THEN 'PASS' ELSE 'FAIL' END AS status FROM c JOIN v USING (metric))
SELECT 'items' AS dataset, {r('ndcg', 4)} AS primary_value, {r('recall', 4)} AS recall_5, n_queries, (SELECT string_agg(status || ' ' || metric, ',' ORDER BY status || ' ' || metric) FROM s) AS claims, (SELECT bool_and(status = 'PASS') FROM s) AS ok FROM x""")
def ir_experiment(spark, sf_dir):
    """Encode, search, evaluate, compare with claims: one record with an overall verdict."""
    run, rel = _experiment(spark, sf_dir)
    each = metrics.per_query(run, rel, [3, 5, 10])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(t).alias("target")) for m, t in CLAIMS])
    claimed = spark.range(1).select(F.explode(rows).alias("c")).select("c.*")
    record = experiments.metrics_record("items", "NDCG@10", metrics.macro(each, [3, 5, 10]), claimed, each.count())
    return record.select("dataset", S.steady(F.col("primary_value"), 4).alias("primary_value"), S.steady(F.col("metrics")["Recall@5"], 4).alias("recall_5"), "n_queries", F.array_join("claims", ",").alias("claims"), "ok")


@query("result_lines", f"WITH {_RUN} SELECT query_id, count(*) AS n, arg_min(doc_id, rk) AS best, {r('max(sim)')} AS top FROM run GROUP BY query_id")
def result_lines(spark, sf_dir):
    """Each query's hits as one map, best first."""
    lines = experiments.result_lines(_experiment(spark, sf_dir)[0])
    return lines.select("query_id", F.size("hits").cast("long").alias("n"), F.get(F.map_keys("hits"), F.lit(0)).alias("best"), S.steady(F.array_max(F.map_values("hits"))).alias("top"))


_TOKENS = f"t AS (SELECT item_id, ({sql_terms('text')})[1:8] AS t FROM benchmark), h AS (SELECT item_id, [[length(t[i])::DOUBLE, i::DOUBLE, ((i * i) % 7)::DOUBLE] FOR i IN range(1, len(t) + 1)] AS h, [(i <= 5)::INT FOR i IN range(1, len(t) + 1)] AS m FROM t WHERE len(t) > 0)"


@query("token_pooling", f"""WITH {_TOKENS}, p AS (SELECT item_id, h[1] AS cls, h[list_sum(m)::BIGINT] AS eos, h[-1] AS eos_left, [list_sum([x[j] * m[i] FOR x, i IN h]) / list_sum(m) FOR j IN range(1, 4)] AS mean FROM h)
SELECT item_id, {', '.join(f"{r(f'{c}[{j}]')} AS {c}_{j}" for c in ('cls', 'eos', 'eos_left', 'mean') for j in (1, 2, 3))} FROM p""")
def token_pooling(spark, sf_dir):
    """One vector of the vectors of an item's first tokens, in each way of pooling; the first five are no padding."""
    terms = F.slice(T.ordered_terms(F.col("text")), 1, 8)
    t = table(spark, sf_dir, "benchmark").select("item_id", terms.alias("t")).where(F.size("t") > 0)
    t = t.withColumn("h", F.transform("t", lambda w, i: F.array(F.length(w).cast("double"), (i + 1).cast("double"), ((i + 1) * (i + 1) % 7).cast("double")))).withColumn("m", F.transform("t", lambda w, i: (i < 5).cast("int")))
    pools = {"cls": V.pooled(F.col("h"), F.col("m"), "cls"), "eos": V.pooled(F.col("h"), F.col("m"), "eos"), "eos_left": V.pooled(F.col("h"), F.col("m"), "eos", "left"), "mean": V.pooled(F.col("h"), F.col("m"), "mean")}
    return t.select("item_id", *[S.steady(F.get(p, F.lit(j - 1))).alias(f"{c}_{j}") for c, p in pools.items() for j in (1, 2, 3)])


_COMPOSED = f"""{sql_hits(10)}, mu AS (SELECT query_id, i, avg(x) AS m FROM (SELECT query_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM hits) GROUP BY query_id, i),
c AS (SELECT query_id, i, m, a.u[i] AS q, b.u[i] AS s FROM mu JOIN unit a ON a.vec_id = query_id JOIN unit b ON b.vec_id = query_id + 1),
c1 AS (SELECT *, m / sqrt(sum(m * m) OVER w) AS mu, s - q * sum(s * q) OVER w AS o FROM c WINDOW w AS (PARTITION BY query_id)),
c2 AS (SELECT *, mu - q * sum(mu * q) OVER w AS m1 FROM c1 WINDOW w AS (PARTITION BY query_id)),
c3 AS (SELECT *, q + 0.85::DOUBLE * s - 0.15::DOUBLE * (m1 - o * sum(m1 * o) OVER w / sum(o * o) OVER w) AS x FROM c2 WINDOW w AS (PARTITION BY query_id))"""


@query("composed_query", f"WITH {_COMPOSED} SELECT query_id, (i - 1)::BIGINT AS i, {r('x / sqrt(sum(x * x) OVER (PARTITION BY query_id))')} AS x FROM c3")
def composed_query(spark, sf_dir):
    """A query with a second vector added and the noise of its hits taken off."""
    mu = V.mean_vectors(base.hits(spark, sf_dir, 10), ["query_id"], "e", name="mu")
    u = base.units(spark, sf_dir)
    rows = base.queries_of(u).join(mu, "query_id").join(u.select((F.col("vec_id") - 1).alias("query_id"), F.col("u").alias("s")), "query_id")
    v = V.with_composed(rows, "v", "q", "s", "mu", 0.85, 0.15).select("query_id", F.posexplode("v").alias("i", "x"))
    return v.select("query_id", F.col("i").cast("long").alias("i"), S.steady(F.col("x")).alias("x"))


@query("alias_terms", f"""WITH a AS (SELECT conv_id, list_sort(list_distinct(list_transform({sql_terms('text')}, lambda v: v[1:5]))) AS missing FROM conversations WHERE turn = 0), b AS (SELECT conv_id, list_sort(list_distinct(flatten(list({sql_terms('text')})))) AS bag FROM conversations WHERE turn > 0 GROUP BY conv_id),
v AS (SELECT conv_id, missing, flatten(list_transform(missing, lambda m: list_concat(list_filter(bag, lambda t: t <> m AND (starts_with(t, m) OR starts_with(m, t)) AND abs(length(t) - length(m)) <= 4), list_filter([m || 'd', m || 'ing', m || 'ion'], lambda t: list_contains(bag, t))))) AS found FROM a JOIN b USING (conv_id))
SELECT conv_id, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i AND NOT list_contains(missing, x))[1:6], ' ') AS aliases FROM v""")
def alias_terms(spark, sf_dir):
    """Words of a conversation's later turns that are variants of the beginnings of its first turn's terms."""
    c = table(spark, sf_dir, "conversations")
    asked = c.where("turn = 0").select("conv_id", F.array_sort(F.array_distinct(F.transform(T.ordered_terms(F.col("text")), lambda v: F.substring(v, 1, 5)))).alias("missing"))
    bag = c.where("turn > 0").select("conv_id", F.explode(T.ordered_terms(F.col("text"))).alias("t")).groupBy("conv_id").agg(F.collect_set("t").alias("bag"))
    later = c.where("turn > 0").select("conv_id").distinct().join(bag, "conv_id", "left").withColumn("bag", F.coalesce("bag", F.array().cast("array<string>")))
    return asked.join(later, "conv_id").select("conv_id", F.array_join(T.aliases(F.col("missing"), F.col("bag")), " ").alias("aliases"))


# States of a policy: every combination of a few values.

_GRID = "g AS (SELECT i, (i % 2) = 1 AS active, (['', 'colour of the wall'])[1 + (i // 2) % 2] AS focus, 0.25::DOUBLE * ((i // 4) % 3) AS a, 0.15::DOUBLE * ((i // 12) % 2) AS b, CASE WHEN (i // 24) % 2 = 1 THEN 738000.25::DOUBLE END AS t, (i // 48) % 12 AS n FROM range(576) t(i))"


def _printf(template: str, *values: str) -> str:
    return f"printf({lit(template.replace('%d', '%d'))}, {', '.join(values)})"


_Q_BODY = f"concat_ws(chr(10), CASE WHEN focus <> '' THEN {_printf(slots.FOCUS_FORMULA, 'focus', 'a', 'b', '1.0::DOUBLE', 'a')} END, CASE WHEN active AND (a <> 0 OR b <> 0) THEN {_printf(slots.QUERY_FORMULA, '1.0::DOUBLE', 'a', 'b', 'n', '2')} END)"
_T = "CASE WHEN t IS NULL THEN 'na' ELSE printf('%.2f', t) END"
_IDS = "list_transform(range(n), lambda x: (x * 7)::VARCHAR)"


@query("slot_bodies", f"""WITH {_GRID} SELECT i, CASE WHEN {_Q_BODY} = '' THEN {lit(slots.QUERY_SAME)} ELSE {_Q_BODY} END AS query_body,
CASE WHEN active AND (a <> 0 OR b <> 0 OR focus <> '') THEN {_printf(slots.RANK_FORMULA, 'a', 'b', "CASE WHEN focus <> '' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END", _T, _T, 'n', '1')} ELSE {lit(slots.RANK_SAME)} END AS rank_body,
CASE WHEN active AND (n > 0 OR focus <> '' OR a <> 0) THEN {_printf(slots.FILTER_FORMULA, "(focus <> '')::INT", 'a', 'n', "CASE WHEN focus <> '' THEN 'wall,colour' ELSE '-' END", f"CASE WHEN n = 0 THEN '-' ELSE array_to_string(({_IDS})[1:8], ',') || CASE WHEN n > 8 THEN ',...' ELSE '' END END")} ELSE {lit(slots.FILTER_SAME)} END AS filter_body FROM g""")
def slot_bodies(spark, sf_dir):
    """The text of each slot for every combination of a few values of a state."""
    c, i = F.col, F.col("i")
    step = lambda d, m: F.floor(i / d) % m
    g = spark.range(576).withColumnRenamed("id", "i").select(
        "i", (i % 2 == 1).alias("active"), F.when(step(2, 2) == 1, "colour of the wall").otherwise("").alias("focus"), (0.25 * step(4, 3)).alias("a"), (0.15 * step(12, 2)).alias("b"), F.when(step(24, 2) == 1, 738000.25).alias("t"), step(48, 12).cast("int").alias("n"),
    )
    focused, ids = c("focus") != "", F.transform(F.slice(F.sequence(F.lit(0), F.lit(11)), F.lit(1), c("n")), lambda x: x * 7)
    binds = F.when(focused, F.array(F.lit("wall"), F.lit("colour"))).otherwise(F.array().cast("array<string>"))
    return g.select(
        "i", slots.query_body(c("active"), c("focus"), c("a"), F.lit(1.0), c("a"), c("b"), c("n"), F.lit(2)).alias("query_body"),
        slots.rank_body(c("active"), c("a"), c("b"), F.when(focused, 0.5).otherwise(0.0), c("t"), c("t"), c("n"), F.lit(1)).alias("rank_body"),
        slots.filter_body(c("active"), focused, c("a"), ids, binds).alias("filter_body"),
    )


@query("slot_rules", """WITH g AS (SELECT i, (['query', 'rank', 'filter', 'other'])[1 + i % 4] AS slot, (i // 4) % 2 = 1 AS q, (i // 8) % 2 = 1 AS r, (i // 16) % 2 = 1 AS f, (i // 32) % 2 = 1 AS b FROM range(64) t(i))
SELECT i, slot, CASE WHEN b THEN 'backbone changed' WHEN slot = 'other' THEN 'unknown slot' WHEN (q AND slot <> 'query') OR (r AND slot <> 'rank') OR (f AND slot <> 'filter') THEN 'another slot changed'
 WHEN NOT CASE slot WHEN 'query' THEN q WHEN 'rank' THEN r ELSE f END THEN 'the slot did not change' END AS broken FROM g""")
def slot_rules(spark, sf_dir):
    """Which changes of three slots and the rest of the document are allowed."""
    i = F.col("i")
    bit = lambda d: (F.floor(i / d) % 2).cast("string")
    slot = F.element_at(F.array(*map(F.lit, ["query", "rank", "filter", "other"])), (i % 4 + 1).cast("int"))
    g = spark.range(64).withColumnRenamed("id", "i").withColumn("slot", slot)
    same = F.lit("0")
    broken = slots.violation(F.col("slot"), {"query": same, "rank": same, "filter": same}, {"query": bit(4), "rank": bit(8), "filter": bit(16)}, same, bit(32))
    return g.select("i", "slot", broken.alias("broken"))


@query("trace_flags", """WITH g AS (SELECT i, nullif(i % 13, 0) AS rank, (i // 13) % 2 = 1 AS was, (i // 26) % 2 = 1 AS still, (['query', 'stop', 'rank', 'query-dead-end'])[1 + (i // 52) % 4] AS action FROM range(208) t(i))
SELECT i, array_to_string(list_filter([CASE WHEN was AND NOT still THEN 'missing cleared by rule' END, CASE WHEN rank <= 3 AND action = 'query' THEN 'gold in top 3, still query' END, CASE WHEN rank > 5 AND action = 'stop' THEN 'gold beyond 5, stopped' END,
 CASE WHEN rank > 3 AND rank <= 10 AND action = 'stop' THEN 'gold in 4 to 10, stopped' END, CASE WHEN action = 'query-dead-end' THEN 'dead end' END], lambda x: x IS NOT NULL), '|') AS flags FROM g""")
def trace_flags(spark, sf_dir):
    i = F.col("i")
    action = F.element_at(F.array(*map(F.lit, ["query", "stop", "rank", "query-dead-end"])), (F.floor(i / 52) % 4 + 1).cast("int"))
    tags = slots.flags(F.when(i % 13 != 0, i % 13), F.floor(i / 13) % 2 == 1, F.floor(i / 26) % 2 == 1, action)
    return spark.range(208).withColumnRenamed("id", "i").select("i", F.array_join(tags, "|").alias("flags"))


_RELABELLED = f"""SELECT i, i % 3 = 0 AS qa_correct_old, CASE WHEN len(packed) > 0 THEN lower(packed[-1]) = 'true' ELSE coalesce(ends_with(lower(labels[-1]), 'yes'), false) END AS qa_correct, (i % 3 = 0) <> CASE WHEN len(packed) > 0 THEN lower(packed[-1]) = 'true' ELSE coalesce(ends_with(lower(labels[-1]), 'yes'), false) END AS flipped
FROM (SELECT i, regexp_extract_all(verdict, {lit(T.JSON_LABEL)}, 1) AS packed, {texts.SQL_LABEL_LINES} AS labels FROM v)"""


@query("relabelled", f"WITH {texts.SQL_VERDICTS} {_RELABELLED}")
def relabelled(spark, sf_dir):
    """Labels read anew from the judge's words, and which of them changed."""
    rows = texts.rows(spark, texts.VERDICTS, "i", "judge_verdict").withColumn("qa_correct", F.col("i") % 3 == 0)
    return harness.relabelled(rows).select("i", "qa_correct_old", "qa_correct", "flipped")


@query("relabelled_turns", f"WITH v AS (SELECT conv_id * 1000 + turn AS i, text || chr(10) || ({sql_list(texts.VERDICTS)})[1 + (conv_id + turn) % {len(texts.VERDICTS)}] AS verdict FROM conversations) {_RELABELLED}")
def relabelled_turns(spark, sf_dir):
    """The same for every turn of the conversations, as a judge's words before a verdict."""
    verdict = F.get(F.array(*map(F.lit, texts.VERDICTS)), ((F.col("conv_id") + F.col("turn")) % len(texts.VERDICTS)).cast("int"))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("i"), F.concat("text", F.lit("\n"), verdict).alias("judge_verdict"))
    return harness.relabelled(rows.withColumn("qa_correct", F.col("i") % 3 == 0)).select("i", "qa_correct_old", "qa_correct", "flipped")


# Probes: each question's gold text is its conversation's second turn.


def _probe(spark, sf_dir):
    questions, later = (written(x, "talks") for x in evolve.talks(spark, sf_dir))  # both searches read them
    state = memory.start(questions)
    before = written(memory.retrieve(state, later, memory_sql.K), "before")
    seen = written(review.review(before), "seen")
    acts = seen.where("hop <> ''").withColumn("slot", F.lit("query"))
    after = memory.retrieve(memory.changed(state, before, acts), later, memory_sql.K)
    return before, seen, after, questions.select("query_id", (F.col("query_id") * 100 + 1).alias("doc_id"))


_PROBE = memory_sql.sql_memory(rounds=2, probe=True)


@query("slate_probe", f"""WITH {_PROBE}, a AS (SELECT query_id, rk FROM hits1 WHERE doc_id = query_id * 100 + 1), b AS (SELECT query_id, rk FROM hits2 WHERE doc_id = query_id * 100 + 1)
SELECT asked.query_id, a.rk AS rank_before, b.rk AS rank_after, a.rk - b.rk AS delta FROM asked LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""")
def slate_probe(spark, sf_dir):
    """Where the gold text stands before and after the search for the question's phrase."""
    before, _, after, gold = _probe(spark, sf_dir)
    return harness.rank_probe(before, after, gold).select("query_id", *[F.col(c).cast("long").alias(c) for c in ("rank_before", "rank_after", "delta")])


@query("audit_probe", f"""WITH {_PROBE}, a AS (SELECT query_id, rk FROM hits1 WHERE doc_id = query_id * 100 + 1)
SELECT query_id, a.rk AS gold_rank, coalesce(a.rk > 2, true) AS expected, NOT covers AND hop <> '' AS missing, coalesce(a.rk > 2, true) = (NOT covers AND hop <> '') AS aligned FROM rv1 LEFT JOIN a USING (query_id)""")
def audit_probe(spark, sf_dir):
    """Whether the review says that something is missing where gold is not among the first two."""
    before, seen, after, gold = _probe(spark, sf_dir)
    ranks = harness.rank_probe(before, after, gold).select("query_id", F.col("rank_before").cast("long").alias("gold_rank"))
    return harness.audit_probe(ranks, seen.select("query_id", (~F.col("covers") & (F.col("hop") != "")).alias("missing")), 2)
