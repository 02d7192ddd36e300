"""Search, vectors, score fusion and run files."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.functions import vectors as V
from vecmill.operators import search
from vecmill.plans import base
from vecmill.plans.base import r, sql_hits
from vecmill.plans.registry import query
from vecmill.session import dealt, scratch_path, table
from vecmill.sources import files



def _shown(hits):
    return hits.select("query_id", "doc_id", F.col("rk").cast("long").alias("rk"), S.steady(F.col("sim")).alias("sim"))


_HITS_SQL = f"WITH {sql_hits(10)} SELECT query_id, doc_id, rk::BIGINT AS rk, {r('sim')} AS sim FROM hits"


@query("exact_search_ip", f"WITH {sql_hits(10)} SELECT query_id, doc_id, rk::BIGINT AS rk, {r('sim')} AS sim FROM hits")
def exact_search_ip(spark, sf_dir):
    """Top 10 by inner product of unit vectors, in blocks."""
    u = base.units(spark, sf_dir)
    corpus = u.select(F.col("vec_id").alias("doc_id"), F.col("u").alias("e"))
    return _shown(search.exact_search(base.queries_of(u), corpus, 10))


@query("exact_search_plan", _HITS_SQL)
def exact_search_plan(spark, sf_dir):
    """The same search with rows of odd vectors under the column expression, which the blocks follow in their sums."""
    u = base.units(spark, sf_dir)
    corpus = u.select(F.col("vec_id").alias("doc_id"), F.col("u").alias("e"))
    return _shown(search.search_expression(base.queries_of(u), corpus, 10))


@query("exact_search_cos", f"""WITH p AS (
  SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
    list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_inner_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])) + 1e-12) AS sim
  FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % {base.EVERY} = 0)
SELECT query_id, doc_id, rk, {r('sim')} AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, doc_id) AS rk FROM p) WHERE rk <= 10""")
def exact_search_cos(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), V.doubles(F.col("embedding")).alias("e"))
    q = e.where(F.col("doc_id") % base.EVERY == 0).select(F.col("doc_id").alias("query_id"), F.col("e").alias("q"))
    return _shown(search.search_expression(q, e, 10, V.cosine))


@query("search_ignore_identical", f"WITH {sql_hits(10)} SELECT query_id, doc_id, rk::BIGINT AS rk, {r('sim')} AS sim FROM hits WHERE query_id <> doc_id")
def search_ignore_identical(spark, sf_dir):
    """The query's own row goes after the top k, which then has k - 1 rows."""
    return exact_search_ip(spark, sf_dir).where("query_id <> doc_id")


@query("l2_norms", f"SELECT vec_id, {r('sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))')} AS length FROM embeddings")
def l2_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.steady(V.norm(V.doubles(F.col("embedding")))).alias("length"))


@query("mean_vector", f"""SELECT label, (i - 1)::BIGINT AS i, {r('avg(embedding[i]::DOUBLE)')} AS mean
FROM embeddings, unnest(range(1, len(embedding) + 1)) AS t(i) GROUP BY label, i""")
def mean_vector(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", V.doubles(F.col("embedding")).alias("e"))
    return V.mean_vectors(e, ["label"], "e").select("label", F.posexplode("mean").alias("i", "x")).select("label", F.col("i").cast("long").alias("i"), S.steady(F.col("x")).alias("mean"))


_WEIGHTS = f"""{sql_hits(10)}, ex AS (
  SELECT *, exp(greatest(-40, least(40, (sim - max(sim) OVER (PARTITION BY query_id)) / 0.15::DOUBLE))) AS x FROM hits),
weighted AS (SELECT *, x / sum(x) OVER (PARTITION BY query_id) AS w FROM ex)"""


@query("softmax_mean_vector", f"""WITH {_WEIGHTS}
SELECT query_id, (i - 1)::BIGINT AS i, {r('sum(w * e[i]) / sum(w)')} AS mean FROM weighted, unnest(range(1, len(e) + 1)) AS t(i) GROUP BY query_id, i""")
def softmax_mean_vector(spark, sf_dir):
    weighted = S.with_softmax(base.hits(spark, sf_dir, 10), ["query_id"], "sim", "w")
    return V.mean_vectors(weighted, ["query_id"], "e", "w").select("query_id", F.posexplode("mean").alias("i", "x")).select("query_id", F.col("i").cast("long").alias("i"), S.steady(F.col("x")).alias("mean"))


_MEANS = f"""{sql_hits(20)}, parts AS (
  SELECT query_id, i, avg(CASE WHEN label = query_label AND query_id <> doc_id THEN e[i] END) AS pos, avg(CASE WHEN label <> query_label THEN e[i] END) AS neg
  FROM hits, unnest(range(1, 65)) AS t(i) GROUP BY query_id, i),
raw AS (SELECT p.query_id, i, u.u[i] AS q, pos, neg, u.u[i] + 0.75::DOUBLE * coalesce(pos, 0) - 0.15::DOUBLE * coalesce(neg, 0) AS x FROM parts p JOIN unit u ON u.vec_id = p.query_id)"""


def _sides(spark, sf_dir):
    hits = base.hits(spark, sf_dir, 20)
    pos = V.mean_vectors(hits.where("label = query_label and query_id <> doc_id"), ["query_id"], "e", name="pos")
    neg = V.mean_vectors(hits.where("label <> query_label"), ["query_id"], "e", name="neg")
    return base.queries_of(base.units(spark, sf_dir)).join(pos, "query_id", "left").join(neg, "query_id", "left")


@query("rocchio_query", f"""WITH {_MEANS}
SELECT query_id, (i - 1)::BIGINT AS i, {r('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY query_id)), 1e-8)')} AS x FROM raw""")
def rocchio_query(spark, sf_dir):
    moved = _sides(spark, sf_dir).select("query_id", V.rocchio(F.col("q"), F.col("pos"), F.col("neg")).alias("v"))
    return moved.select("query_id", F.posexplode("v").alias("i", "x")).select("query_id", F.col("i").cast("long").alias("i"), S.steady(F.col("x")).alias("x"))


@query("orthogonal_noise", f"""WITH {_MEANS},
one AS (SELECT *, neg - q * sum(neg * q) OVER (PARTITION BY query_id) AS a, pos - q * sum(pos * q) OVER (PARTITION BY query_id) AS b FROM raw),
two AS (SELECT *, sum(a * b) OVER (PARTITION BY query_id) AS ab, sum(b * b) OVER (PARTITION BY query_id) AS bb FROM one)
SELECT query_id, (i - 1)::BIGINT AS i, {r('CASE WHEN bb IS NULL OR sqrt(bb) < 1e-8 THEN a ELSE a - b * ab / bb END')} AS x FROM two WHERE a IS NOT NULL""")
def orthogonal_noise(spark, sf_dir):
    """The mean of the negatives without its part in the span of the query and the mean of the positives."""
    s = _sides(spark, sf_dir).where("neg is not null")
    s = s.withColumn("a", V.without(F.col("neg"), F.col("q"))).withColumn("b", F.when(F.col("pos").isNotNull(), V.without(F.col("pos"), F.col("q"))))
    return s.select("query_id", F.posexplode(V.without(F.col("a"), F.col("b"))).alias("i", "x")).select("query_id", F.col("i").cast("long").alias("i"), S.steady(F.col("x")).alias("x"))


@query("trec_run_lines", f"""WITH {sql_hits(10)}, s AS (SELECT query_id, doc_id, rk, round(sim, 4) + 0.0::DOUBLE AS sim FROM hits WHERE query_id <> doc_id)
SELECT query_id || ' Q0 ' || doc_id || ' ' || row_number() OVER (PARTITION BY query_id ORDER BY rk) || ' ' || printf('%.4f', sim) || ' run' AS line FROM s""")
def trec_run_lines(spark, sf_dir):
    from vecmill.sources.files import run_lines

    hits = base.hits(spark, sf_dir, 10).where("query_id <> doc_id")
    return run_lines(hits.withColumn("sim", S.steady(F.col("sim"), 4)), "run", "rk", places=4)


@query("qrels_dedup", """SELECT l_orderkey AS query_id, l_partkey AS doc_id, arg_max(CAST(round(l_quantity) AS INTEGER), l_linenumber * 1000 + round(l_quantity)) AS rel FROM lineitem GROUP BY ALL""")
def qrels_dedup(spark, sf_dir):
    """Of repeated judgements the last line counts, of equal lines the higher grade."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("doc_id")).agg(F.max(F.struct("l_linenumber", F.round("l_quantity").cast("int").alias("rel")))["rel"].alias("rel"))


_JUDGED = """WITH j AS (SELECT l_orderkey::VARCHAR AS query_id, l_partkey::VARCHAR AS doc_id, trunc(l_quantity)::INTEGER AS rel, l_linenumber * 1000 + l_quantity AS place FROM lineitem)
SELECT query_id, doc_id, arg_max(rel, place) AS rel FROM j GROUP BY ALL"""


@query("qrels_files", _JUDGED)
def qrels_files(spark, sf_dir):
    """Judgements written to text files, with headers, three and four columns and blank lines, and read again: the last line counts."""
    path = scratch_path(spark, "qrels")
    li = table(spark, sf_dir, "lineitem")
    li = li.repartitionByRange(dealt(li), "l_orderkey").sortWithinPartitions("l_orderkey", "l_linenumber", "l_quantity")
    q, d, g = (F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_quantity"))
    line = F.when(F.col("l_orderkey") % 2 == 0, F.concat_ws("\t", q, d, g)).otherwise(F.concat_ws("  ", q, F.lit("0"), d, g, F.lit("x")))
    line = F.when(F.col("l_linenumber") == 3, F.concat(F.lit(" "), line, F.lit("\n"))).otherwise(line)
    files.with_first_line(li.select(line.alias("value")), "Query-ID corpus-id score").write.text(path)
    return files.read_qrels(spark, path)


_TALKS = """WITH c AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL)
SELECT conv_id::VARCHAR AS question_id, conv_id || '-' || (turn // 2) AS session_id, 'day ' || (turn // 2) AS date, count(*) AS n_turns, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM c GROUP BY conv_id, turn // 2"""


@query("instances_files", _TALKS)
def instances_files(spark, sf_dir):
    """Benchmark questions made of conversations, two turns a session, written as JSON arrays and read again by session."""
    path = scratch_path(spark, "instances")
    c = table(spark, sf_dir, "conversations").where("conv_id is not null").withColumn("n", F.floor(F.col("turn") / 2))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("t")))), lambda x: x["t"])
    each = c.groupBy("conv_id", "n").agg(turns.alias("turns")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "turns"))).alias("s"))
    of = lambda f: F.transform("s", f)
    q = F.col("conv_id").cast("string")
    rows = each.select(
        q.alias("question_id"), F.lit('quotes " and \\" {braces] ').alias("question_type"), F.lit("}{").alias("question"), F.lit("now").alias("question_date"), F.lit(None).cast("string").alias("answer"), F.array(F.lit("[")).alias("answer_session_ids"),
        of(lambda x: F.concat(q, F.lit("-"), x["n"].cast("string"))).alias("haystack_session_ids"), of(lambda x: F.concat(F.lit("day "), x["n"].cast("string"))).alias("haystack_dates"), of(lambda x: x["turns"]).alias("haystack_sessions"),
    )
    files.write_json_array(rows, path)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "\n")
    return files.haystack(files.read_instances(spark, path)).select("question_id", "session_id", "date", F.size("turns").cast("long").alias("n_turns"), F.md5(said).alias("digest"))


_RECENT = f"""{sql_hits(20)}, rec AS (
  SELECT *, CASE WHEN time_days IS NULL THEN 0 ELSE exp(-greatest(0, max(time_days) OVER (PARTITION BY query_id) - time_days) / greatest(greatest(stddev_pop(time_days) OVER (PARTITION BY query_id), 30), 1e-8)) END AS rec FROM hits)"""


@query("recency_kernel", f"WITH {_RECENT} SELECT query_id, doc_id, {r('rec')} AS rec FROM rec")
def recency_kernel(spark, sf_dir):
    return search.recency_of(base.hits(spark, sf_dir, 20)).select("query_id", "doc_id", S.steady(F.col("rec")).alias("rec"))


_FUSED = "(1 - 0.35::DOUBLE) * sim + 0.35::DOUBLE * rec - CASE WHEN doc_id % 7 = 0 THEN 0.5::DOUBLE WHEN label <> query_label THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 0.12::DOUBLE ELSE 0 END"


def _fused_rows(spark, sf_dir):
    rows = search.recency_of(base.hits(spark, sf_dir, 20)).drop("rk")
    hard = F.when(F.col("doc_id") % 7 == 0, F.array("doc_id")).otherwise(F.array().cast("array<bigint>"))
    soft = F.when(F.col("label") != F.col("query_label"), F.array("doc_id")).otherwise(F.array().cast("array<bigint>"))
    penalty = search.negative_penalty(F.col("doc_id"), hard, soft, F.lit(0.5), F.lit(0.35))
    return rows.withColumn("score", search.fused(F.col("sim"), F.col("rec"), F.lit(0.35), penalty, F.when(F.col("doc_id") % 5 == 0, 0.12).otherwise(0.0)))


@query("fused_score_topk", f"""WITH {_RECENT}, f AS (SELECT query_id, doc_id, {r(_FUSED, 9)} AS score FROM rec)
SELECT query_id, doc_id, rk, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM f) WHERE rk <= 10""")
def fused_score_topk(spark, sf_dir):
    rows = _fused_rows(spark, sf_dir).withColumn("score", S.steady(F.col("score"), 9))
    return search.top_k(rows, ["query_id"], "score", "doc_id", 10).select("query_id", "doc_id", F.col("rk").cast("long").alias("rk"), S.steady(F.col("score")).alias("score"))


@query("filter_penalty_topk", f"""WITH {_RECENT}, f AS (
  SELECT query_id, doc_id, {r(_FUSED + " - CASE WHEN doc_id % 3 = 0 OR label <> query_label THEN 0.75::DOUBLE ELSE 0 END", 9)} AS score FROM rec)
SELECT query_id, doc_id, rk, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM f) WHERE rk <= 10""")
def filter_penalty_topk(spark, sf_dir):
    """Fusion less the filter's penalty: dropped ids, and hits without the bound term where it is required."""
    rows = _fused_rows(spark, sf_dir)
    filtered = search.filter_penalty(F.lit(True), F.lit(0.75), F.col("doc_id") % 3 == 0, F.lit(True), F.col("label") == F.col("query_label"))
    rows = rows.withColumn("score", S.steady(F.col("score") - filtered, 9))
    return search.top_k(rows, ["query_id"], "score", "doc_id", 10).select("query_id", "doc_id", F.col("rk").cast("long").alias("rk"), S.steady(F.col("score")).alias("score"))


_SLATE = f"""{sql_hits(20)}, m AS (SELECT query_id, list(x ORDER BY i) AS mu FROM (
  SELECT query_id, i, avg(e[i]) AS x FROM hits, unnest(range(1, 65)) AS t(i) WHERE label <> query_label GROUP BY query_id, i) GROUP BY query_id),
s AS (SELECT h.query_id, h.doc_id, h.sim AS s0, list_inner_product(m.mu, h.e) / greatest(sqrt(list_inner_product(m.mu, m.mu)), 1e-8) AS mud FROM hits h LEFT JOIN m USING (query_id)),
f AS (SELECT query_id, doc_id, {r('s0 - CASE WHEN mud > 0.40::DOUBLE AND s0 < 0.50::DOUBLE THEN 0.15::DOUBLE * mud ELSE 0 END', 9)} AS score FROM s)"""


@query("slate_topk", f"WITH {_SLATE} SELECT query_id, doc_id, rk, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rk FROM f) WHERE rk <= 10")
def slate_topk(spark, sf_dir):
    """Similarity less that to the mean of the noise, where the hit is near the noise and far from the query."""
    hits = base.hits(spark, sf_dir, 20)
    mu = V.mean_vectors(hits.where("label <> query_label"), ["query_id"], "e", name="mu")
    rows = hits.join(mu, "query_id", "left").withColumn("mud", V.dot(V.unit(F.col("mu")), F.col("e")))
    none = F.lit(None).cast("double")
    score = search.slate_similarity(F.col("sim"), F.col("sim"), none, F.col("mud"), F.lit(0.0), F.lit(0.15))
    rows = rows.withColumn("score", S.steady(score, 9)).drop("rk")
    return search.top_k(rows, ["query_id"], "score", "doc_id", 10).select("query_id", "doc_id", F.col("rk").cast("long").alias("rk"), S.steady(F.col("score")).alias("score"))
