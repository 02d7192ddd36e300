"""What runs leave for later ones: a reviewer's answers, cached vectors, answered questions, the files of an experiment."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.functions import text as T
from vecmill.operators import metrics, replay, review, search, sessions
from vecmill.plans import evolve, experiment, memory_sql
from vecmill.plans.base import r
from vecmill.plans.registry import query
from vecmill.plans.review_sql import sql_review
from vecmill.plans.texts import lit, sql_body, sql_list, sql_terms
from vecmill.session import scratch_path, table, written
from vecmill.sources import cache, experiments, files
from vecmill.streaming import answers

# Objects in texts that have other braces, broken JSON, braces and quotes in strings, and nested objects around them.

_PLANTED = [
    ('', '', ''),
    (' {"note": {"a": 1}} [{"outer": ', '{"slot_decision": "} {", "n": {"query_intents": []}}', '}, {"missing_keys": 2}]'),
    (' {broken {"missing_keys": [1, {"x": {"y": ', '{"query_intents": ["a\\"}{b", "\\\\"]}', ' then {"slot_decision": "RANK"}'),
    (' he said "{" and {"x": 1 2} ', '{"missing_keys":\n["' + "ü" * 40 + '"]}', ' " }'),
    (' {"missing keys": 1, "slot": "missing_keys"} {"missing_keys" 1} {"missing_keys": ', '', ''),
]
_OBJECT_ROWS = "SELECT 'd' || doc_id AS id, doc_id AS n FROM documents UNION ALL SELECT 'c' || conv_id || '-' || turn, conv_id + turn FROM conversations"


@query("objects_in_text", f"WITH x AS ({_OBJECT_ROWS}) SELECT id, nullif(({sql_list([p[1] for p in _PLANTED])})[1 + n % {len(_PLANTED)}], '') AS object FROM x")
def objects_in_text(spark, sf_dir):
    """The first JSON object with a wanted key in each document and turn, planted between the text and itself."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("n"), "text")
    c = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"), (F.col("conv_id") + F.col("turn")).alias("n"), "text")
    rows, text = d.unionByName(c), F.coalesce("text", F.lit(""))
    plants = F.array(*[F.lit("".join(p)) for p in _PLANTED])
    said = F.concat(text, F.get(plants, (F.col("n") % len(_PLANTED)).cast("int")), text)
    return rows.select("id", T.json_object(said, review.ANSWER_KEYS).alias("object"))


# A reviewer whose answers follow from what it is shown: none, one that breaks off, phrases of every kind, and decisions.

_LONG = "far too many words in one phrase"
_SNIP = "trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'))[1:500]"
_CLEAN = "trim(trim(regexp_replace(s, '\\s+', ' ', 'g'), ' '), ' .,;:\"''`')"


def _sane(items: str, touching: bool) -> str:
    """(query_id, phrases) of p (query_id, low, blob, items): the first three fine phrases, lower-cased."""
    parts = "string_split(s, ' ')"
    fine = f"""s <> '' AND NOT contains(s, '.') AND NOT contains(s, '?') AND length(s) <= 48 AND len({parts}) <= 4 AND len(list_filter({parts}, lambda w: NOT list_contains({sql_list(T.STOP + T.GENERIC)}, w))) > 0"""
    fine += f" AND (contains(low, lower(s)) OR len(list_filter({parts}, lambda w: length(w) > 2 AND contains(low, lower(w)))) > 0 OR len({parts}) <= 2)" if touching else " AND NOT (length(s) >= 12 AND contains(blob, lower(s)))"
    return f"""(SELECT query_id, (list(s ORDER BY i))[1:3] AS phrases FROM (SELECT query_id, lower(s) AS s, min(i) AS i FROM (
  SELECT query_id, low, blob, i, {_CLEAN} AS s FROM (SELECT query_id, low, blob, unnest({items}) AS s, unnest(range(len({items}))) AS i FROM p)) WHERE {fine} GROUP BY query_id, lower(s)) GROUP BY query_id)"""


_KEPT = f"list_filter(lacking, lambda k: NOT list_contains({sql_list(T.ABSTRACT)}, k) AND NOT (starts_with(k, 'specific ') AND len(string_split(k, ' ')) <= 4))"
_ANSWERED = f"""talks AS MATERIALIZED (SELECT a.conv_id AS query_id, CASE WHEN a.conv_id % 2 = 1 THEN {lit(memory_sql.CUED)} ELSE a.text END AS question, a.conv_id * 100 + b.turn AS doc_id, row_number() OVER (PARTITION BY a.conv_id ORDER BY b.turn) AS rk,
  b.text || CASE WHEN b.turn > 1 AND a.conv_id % 2 = 1 THEN {lit(memory_sql.SAID)} ELSE '' END AS text, (738000 + b.turn * {memory_sql.GAPS[1]})::DOUBLE AS time_days, 738640::DOUBLE AS query_days FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn > 0),
{sql_review('talks', 'rv')},
p0 AS (SELECT query_id, any_value(question) AS question, string_agg({_SNIP}, ' ' ORDER BY rk) FILTER (rk <= 10) AS shown, arg_min({_SNIP}, rk) AS best, coalesce(({sql_terms('arg_min(text, rk)')})[1], '') AS word FROM talks GROUP BY query_id),
p AS MATERIALIZED (SELECT query_id, lower({sql_body('question')}) AS low, lower(shown) AS blob, CASE WHEN trim(question) = '' THEN 0 ELSE ('0x' || substr(md5(best[1:400]), 1, 2))::INT % 6 END AS kind,
  ['how   LONG was', {lit(_LONG)}, word || ' trip', 'long.', 'last year', 'How long was'] AS intents, [best[1:24], 'Specific place', word || ' trip to see', 'what when', word || '!'] AS missing FROM p0),
i AS {_sane('intents', True)}, m AS {_sane('missing', False)},
a AS (SELECT p.query_id, kind >= 2 AS said, CASE WHEN kind IN (2, 4) THEN coalesce(i.phrases, []) ELSE [] END AS intents, CASE WHEN kind IN (2, 5) THEN coalesce(m.phrases, []) ELSE [] END AS lacking FROM p LEFT JOIN i USING (query_id) LEFT JOIN m USING (query_id)),
o AS (SELECT rv.*, said, intents, lacking, CASE WHEN covers THEN '' WHEN hop <> '' THEN hop ELSE coalesce(({_KEPT})[1], '') END AS phrase FROM rv JOIN a USING (query_id))"""


def _reviewed(spark, sf_dir):
    questions, texts = evolve.talks(spark, sf_dir, cued=True)
    hits = texts.join(questions.select("query_id", "question", "query_days"), "query_id").withColumn("rk", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
    return review.asked(review.review(hits), hits, "reviewer")


def _reviewer(calls):
    """(call_key, answer) of the reviewer to open calls (call_key, prompt, shown, question)."""
    best = F.get("shown", F.lit(0))["text"]
    word = F.coalesce(F.get(T.ordered_terms(best), F.lit(0)), F.lit(""))
    strings = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    intents = strings("how   LONG was", _LONG, F.concat(word, F.lit(" trip")), "long.", "last year", "How long was").alias("query_intents")
    missing = strings(F.substring(best, 1, 24), "Specific place", F.concat(word, F.lit(" trip to see")), "what when", F.concat(word, F.lit("!"))).alias("missing_keys")
    kind = F.conv(F.substring(F.md5(F.substring(best, 1, 400)), 1, 2), 16, 10).cast("int") % 6
    talk = F.lit("Let me see {first}: ")
    said = F.when(kind == 1, '{"missing_keys": ["cut').when(kind == 2, F.concat(talk, F.to_json(F.struct(intents, missing, F.lit("QUERY").alias("slot_decision")))))
    said = said.when(kind == 3, '{"slot_decision": "RANK", "missing_keys": []} Done.').when(kind == 4, F.concat(F.to_json(F.struct(intents, F.lit("query").alias("slot"))), talk))
    return calls.select("call_key", said.when(kind == 5, F.concat(F.lit("{}"), F.to_json(F.struct(missing, F.lit(7).alias("query_intents"))))).alias("answer"))


@query("review_answers", f"""WITH {_ANSWERED} SELECT query_id, said AS answered, covers, CASE WHEN phrase <> '' THEN 'unrecalled' WHEN NOT covers OR said THEN 'rank_refine' ELSE cause END AS cause, CASE WHEN phrase <> '' THEN 'query' ELSE 'rank' END AS slot, phrase,
  CASE WHEN NOT covers THEN phrase WHEN NOT said THEN '' WHEN len(lacking) > 0 THEN array_to_string(lacking, ' ') ELSE array_to_string(intents, ' ') END AS focus, array_to_string(intents, '|') AS intents FROM o""")
def review_answers(spark, sf_dir):
    """The review with a reviewer's answers, which a first run asks for in files and a second one replays from files."""
    prompts, said = scratch_path(spark, "prompts"), scratch_path(spark, "answers")
    calls = written(_reviewed(spark, sf_dir), "calls")  # read four times
    nothing = spark.createDataFrame([], "call_key string, answer string")
    replay.unanswered(replay.answered(calls, nothing)).write.json(prompts)
    asked = spark.read.schema("call_key string, prompt string").json(prompts).join(calls.select("call_key", "shown").dropDuplicates(["call_key"]), "call_key")
    _reviewer(asked).write.json(said)
    answered = replay.answered(calls, spark.read.schema("call_key string, answer string").json(said))
    return review.refined(answered).withColumn("intents", F.array_join("intents", "|"))


@query("open_calls", f"WITH {_ANSWERED}, k AS (SELECT DISTINCT low, blob, kind FROM p) SELECT (SELECT count(*) FROM p) AS questions, (SELECT count(*) FROM p WHERE kind > 0) AS answered, (SELECT count(*) FROM k) AS calls, (SELECT count(*) FROM k WHERE kind = 0) AS open")
def open_calls(spark, sf_dir):
    """How many questions and different calls there are, and how many calls a run with the reviewer's answers leaves open."""
    calls = _reviewed(spark, sf_dir)
    answered = replay.answered(calls, _reviewer(calls))
    each = answered.agg(F.count("*").alias("questions"), F.count("answer").alias("answered"), F.count_distinct("call_key").alias("calls"))
    return each.join(replay.unanswered(answered).agg(F.count("*").alias("open")))


# Vectors of turns, cached under a hash of model and text; an earlier run knew those of even conversations.

_TURNS = "t AS (SELECT DISTINCT text FROM conversations WHERE text IS NOT NULL)"


@query("cached_vectors", f"""WITH {_TURNS}, k AS (SELECT sha1('hashing|false|' || text) AS key, text FROM t), v AS {memory_sql.sql_hashed('k', 'key', 'text')}, old AS (SELECT DISTINCT sha1('hashing|false|' || text) AS key FROM conversations WHERE conv_id % 2 = 0)
SELECT key, key IN (SELECT key FROM old) AS hit, CASE WHEN key IN (SELECT key FROM old) THEN 2 ELSE 1 END AS copies, {r('list_sum(list_transform(e, lambda x, i: x * i))')} AS digest FROM v""")
def cached_vectors(spark, sf_dir):
    """Vectors got from a shared table or computed into it; keys repeat, and two runs have added some of them at once."""
    path = scratch_path(spark, "cache")
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "text", files.cache_key(F.lit("hashing"), F.lit(False), F.col("text")).alias("key"))
    encode = lambda missing: sessions.hashed_vectors(missing, "key", "text").withColumnRenamed("e", "value")
    even = c.where("conv_id % 2 = 0")
    cache.get_or_compute(even, path, encode, prefix=1)
    # another run that looked before the first had written adds the same keys, with values of its own
    late = encode(even.dropDuplicates(["key"])).withColumn("value", F.transform("value", lambda x: x + 1))
    late.repartition(1).select("key", "value", F.lit("9").alias("run"), F.substring("key", 1, 1).alias("part")).write.mode("append").partitionBy("part").parquet(path)
    hit = cache.stored(c, path, "array<double>", 1).select("key", F.lit(True).alias("hit"))
    hit.write.parquet(f"{path}-hits")
    got = cache.get_or_compute(c, path, encode, prefix=1)
    copies = spark.read.parquet(path).groupBy("key").agg(F.count("*").alias("copies"))
    digest = F.aggregate(F.transform("value", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return got.join(copies, "key").join(spark.read.parquet(f"{path}-hits"), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"), "copies", S.steady(digest).alias("digest"))


# Questions of a stream, each asked twice, answered by a run that is killed between its two sets of files.


@query("answers_once", "SELECT conv_id::VARCHAR AS question_id, 1::BIGINT AS n_results, (length(text) % 3 > 0)::BIGINT AS n_hypotheses, CASE WHEN length(text) % 3 > 0 THEN md5(text) ELSE '' END AS hypothesis FROM conversations WHERE turn = 0 AND conv_id IS NOT NULL AND text IS NOT NULL")
def answers_once(spark, sf_dir):
    """Each question stands once in results and hypotheses, although it came twice and the run was killed and repeated."""
    path = scratch_path(spark, "answers")
    c = table(spark, sf_dir, "conversations").where("turn = 0 and conv_id is not null and text is not null").select(F.col("conv_id").cast("string").alias("question_id"), "text")
    for _ in range(2):
        c.repartition(2, "question_id").write.mode("append").parquet(f"{path}/in")
    seen = []

    def once(name, number):
        seen.append((name, number))
        if len(seen) == 3:
            raise RuntimeError("killed after the results of the second batch")

    def run(after=None):
        stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        answer = lambda b: b.select("question_id", F.when(F.length("text") % 3 > 0, F.md5("text")).otherwise("").alias("hypothesis"))
        return answers.answer_stream(stream, answer, f"{path}/out", f"{path}/state", after=after)

    try:
        run(once).awaitTermination()
    except Exception as e:  # only the kill above
        if "killed after the results" not in str(e):
            raise
    run().awaitTermination()
    kind = "question_id string, hypothesis string"
    a = answers.read_answers(spark, f"{path}/out", "results", kind).groupBy("question_id").agg(F.count("*").alias("n_results"), F.max("hypothesis").alias("hypothesis"))
    b = answers.read_answers(spark, f"{path}/out", "hypotheses", kind).groupBy("question_id").agg(F.count("*").alias("n_hypotheses"))
    return a.join(b, "question_id", "full").select("question_id", "n_results", F.coalesce("n_hypotheses", F.lit(0)).alias("n_hypotheses"), F.coalesce("hypothesis", F.lit("")).alias("hypothesis"))


# An experiment that lives in files: settings, dataset, vectors under a contract, a run, results and metrics.

_CLAIMS = {"nDCG@10": 0.0, "Recall@5": 0.5, "MRR@10": 0.01, "P@3": 0.0}
_DOCS = "(SELECT 'd' || doc_id AS doc_id, CASE WHEN trim(coalesce(source, '')) = '' THEN '' ELSE source || ' ' END || coalesce(text, '') AS text, coalesce(text, '') AS said FROM documents)"
_FILED = "\nfiled AS MATERIALIZED (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY printf('%.6f', sim)::DOUBLE DESC, doc_id) AS rk FROM run),"


@query("files_experiment", f"""WITH {experiment.sql_run(_DOCS, _FILED, 'filed')}, v AS (SELECT unnest(['nDCG@10', 'Recall@5', 'MRR@10', 'P@3']) AS metric, unnest([ndcg, recall, mrr, p]) AS value FROM x), c(metric, target) AS (VALUES {', '.join(f"('{m}', {t}::DOUBLE)" for m, t in _CLAIMS.items())}),
s AS (SELECT metric, CASE WHEN abs(value - target) <= CASE WHEN metric LIKE 'Recall%' THEN 0.02 ELSE 0.01 END THEN 'PASS' ELSE 'FAIL' END AS status FROM c JOIN v USING (metric))
SELECT 'items' AS dataset, {r('ndcg', 4)} AS primary_value, {r('recall', 4)} AS recall_5, {r('mrr', 4)} AS mrr_10, n_queries, (SELECT string_agg(status || ' ' || metric, ',' ORDER BY status || ' ' || metric) FROM s) AS claims, (SELECT bool_and(status = 'PASS') FROM s) AS ok,
  (SELECT count(DISTINCT query_id) FROM run) AS result_lines, (SELECT count(*) FROM run) AS run_lines, 'ValueError' AS stale FROM x""")
def files_experiment(spark, sf_dir):
    """Every step of an experiment reads what the step before has written; vectors of another contract are refused."""
    path = scratch_path(spark, "experiment")
    at = lambda name: f"{path}/{name}"
    given = {"dataset": "items", "encode": {"model": "hashing", "dim": 64, "title_mode": "concat_space"}, "top_k": 10, "primary": "NDCG@10", "claims": _CLAIMS, "cutoffs": [3, 5, 10]}
    spark.createDataFrame([(json.dumps(given),)], "value string").coalesce(1).write.text(at("settings"))
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("_id"), F.col("source").alias("title"), "text")
    q = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("_id"), "text")
    # an older line of the same id stands before each one
    lines = d.select(F.explode(F.array(F.struct("_id", F.lit("old").alias("title"), F.lit("an older text").alias("text")), F.struct("_id", "title", "text"))).alias("x")).select("x.*")
    lines.write.json(at("corpus"))
    q.write.json(at("queries"))
    term = lambda rows, key: rows.select(F.col("_id").alias(key), F.get(T.ordered_terms(F.col("text")), F.lit(0)).alias("t"))
    judged = term(q, "query_id").join(term(d, "doc_id"), "t").select(F.concat_ws("\t", "query_id", "doc_id", F.lit("1")).alias("value"))
    files.with_first_line(judged, "query-id\tcorpus-id\tscore").write.text(at("qrels"))

    settings = experiments.read_settings(spark, at("settings"))
    contract, cuts = settings["encode"], settings["cutoffs"]
    docs, asked, rel = experiments.load_dataset(spark, at("corpus"), at("queries"), at("qrels"), contract["title_mode"])
    experiments.write_vectors(sessions.hashed_vectors(docs, "doc_id", "text", contract["dim"]), at("documents"), contract)
    experiments.write_vectors(sessions.hashed_vectors(asked, "query_id", "text", contract["dim"]), at("questions"), contract)
    try:
        experiments.read_vectors(spark, at("documents"), {**contract, "title_mode": "text_only"})
        stale = "read"
    except ValueError as e:
        stale = type(e).__name__
    vectors = [experiments.read_vectors(spark, at(n), contract) for n in ("questions", "documents")]
    hits = search.exact_search(vectors[0].withColumnRenamed("e", "q"), vectors[1], settings["top_k"])
    files.write_run(hits, at("run"))
    run = files.read_run(spark, at("run"))
    experiments.write_results(run.withColumnRenamed("score", "sim"), at("results"))
    each = metrics.per_query(run, rel, cuts)
    claimed = spark.createDataFrame([(m, float(t)) for m, t in settings["claims"].items()], "metric string, target double")
    count = each.count()
    experiments.write_metrics(experiments.metrics_record(settings["dataset"], settings["primary"], metrics.macro(each, cuts), claimed, count), at("metrics"))
    found = spark.read.schema("dataset string, primary_value double, metrics map<string,double>, claims array<string>, ok boolean, n_queries long").json(at("metrics"))
    n_lines = experiments.read_results(spark, at("results"), "query_id string, hits map<string,double>").where("cardinality(hits) > 0").agg(F.count("*").alias("result_lines"))
    metric = lambda m: S.steady(F.col("metrics")[m], 4)
    row = found.join(n_lines).join(run.agg(F.count("*").alias("run_lines")))
    return row.select("dataset", S.steady(F.col("primary_value"), 4).alias("primary_value"), metric("Recall@5").alias("recall_5"), metric("MRR@10").alias("mrr_10"), "n_queries", F.array_join("claims", ",").alias("claims"), "ok", "result_lines", "run_lines", F.lit(stale).alias("stale"))
