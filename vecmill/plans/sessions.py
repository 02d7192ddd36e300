"""Sessions, reader input, encoder input, caches and resuming."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmill.functions import statistics as S
from vecmill.operators import analytics, search, sessions
from vecmill.plans import base
from vecmill.plans.base import SPACES, r, sql_hits
from vecmill.plans.registry import query
from vecmill.plans.texts import sql_terms
from vecmill.session import table
from vecmill.sources import files

_CONV = f"""conv AS (SELECT conv_id, string_agg(role || ': ' || trim(text, {SPACES}), chr(10) ORDER BY turn) AS body, count(*) AS n FROM conversations GROUP BY conv_id),
dates AS (SELECT event_id AS conv_id, strftime(ts, '%Y/%m/%d') AS date FROM events),
sess AS (SELECT conv_id, n, body, coalesce(date, '') AS date, '[session date: ' || coalesce(date, '') || ']' || chr(10) || body AS text FROM conv LEFT JOIN dates USING (conv_id))"""


def _sessions(spark, sf_dir):
    turns = sessions.sessions_of(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    dates = table(spark, sf_dir, "events").select(F.col("event_id").alias("conv_id"), F.date_format("ts", "yyyy/MM/dd").alias("date"))
    return turns.join(dates, "conv_id", "left").withColumn("date", F.coalesce("date", F.lit("")))


@query("session_text", f"WITH {_CONV} SELECT conv_id, n, md5(text) AS digest FROM sess")
def session_text(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    return s.select("conv_id", F.size("turns").cast("long").alias("n"), F.md5(sessions.session_text(F.col("date"), F.col("turns"))).alias("digest"))


@query("turn_windows", f"""WITH {_CONV}, c AS (SELECT conv_id, date, n, text, CASE WHEN length(text) <= 600 OR n <= 4 THEN 1 ELSE ceil((n - 4) / 3.0)::INT + 1 END AS k FROM sess),
j AS (SELECT *, unnest(range(0, k)) AS j FROM c)
SELECT j.conv_id, CASE WHEN k = 1 THEN j.conv_id::VARCHAR ELSE j.conv_id || '::c' || j END AS chunk_id, md5(CASE WHEN k = 1 THEN any_value(j.text) ELSE '[session date: ' || date || ']' || chr(10) || string_agg(role || ': ' || trim(t.text, {SPACES}), chr(10) ORDER BY turn) END) AS digest
FROM j JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations) t ON t.conv_id = j.conv_id AND (k = 1 OR (p >= j * 3 AND p < j * 3 + 4)) GROUP BY j.conv_id, j, k, date""")
def turn_windows(spark, sf_dir):
    """Windows of four turns, overlapping by one, of conversations over 600 characters."""
    w = sessions.turn_windows(_sessions(spark, sf_dir), "conv_id", 4, 1, 600)
    return w.select("conv_id", "chunk_id", F.md5("text").alias("digest"))


_COLLAPSED = f"""{sql_hits(30)}, f AS (SELECT query_id, doc_id, doc_id % 40 AS session_id, rk, sim, time_days, row_number() OVER (PARTITION BY query_id, doc_id % 40 ORDER BY rk) AS n FROM hits),
c AS (SELECT query_id, doc_id, session_id, sim, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE time_days END AS time_days, row_number() OVER (PARTITION BY query_id ORDER BY rk) AS session_rk FROM f WHERE n = 1)"""


def _collapsed(spark, sf_dir, limit):
    hits = base.hits(spark, sf_dir, 30).withColumn("session_id", F.col("doc_id") % 40)
    first = search.first_per_session(hits, limit)
    return first.withColumn("time_days", F.when(F.col("doc_id") % 5 != 0, F.col("time_days")))


@query("collapse_sessions", f"WITH {_COLLAPSED} SELECT query_id, doc_id, session_id, session_rk FROM c WHERE session_rk <= 10")
def collapse_sessions(spark, sf_dir):
    """Thirty chunks a query collapse to their ten best sessions."""
    return _collapsed(spark, sf_dir, 10).select("query_id", "doc_id", "session_id", F.col("session_rk").cast("long").alias("session_rk"))


@query("reader_select", f"""WITH {_COLLAPSED} SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN query_id % 100 = 0 THEN (time_days IS NULL)::INT END, CASE WHEN query_id % 100 = 0 THEN time_days END NULLS LAST, session_rk) AS place FROM c WHERE session_rk <= 5""")
def reader_select(spark, sf_dir):
    """Five sessions; for some kinds of questions oldest first, undated ones last."""
    hits = _collapsed(spark, sf_dir, 5).drop("rk").withColumnRenamed("session_rk", "rk")
    return sessions.reader_order(hits, F.col("query_id") % 100 == 0).select("query_id", "doc_id", F.col("place").cast("long").alias("place"))


@query("reader_history", f"""WITH {_CONV}, {_COLLAPSED}, e AS (SELECT query_id, session_rk, chr(10) || '### Session ' || session_rk || ' (session_id=' || conv_id || ', score=' || printf('%.4f', round(sim, 4)) || ')' || chr(10) || 'Session Date: ' || date || chr(10) || 'Session Content:' || chr(10) ||
 CASE WHEN length(body) > 900 THEN substr(body, 1, 900) || chr(10) || '[truncated]' ELSE body END || chr(10) AS entry FROM c JOIN sess ON conv_id = session_id WHERE session_rk <= 5)
SELECT query_id, md5(string_agg(entry, '' ORDER BY session_rk)) AS digest FROM e GROUP BY query_id""")
def reader_history(spark, sf_dir):
    """The text a reader gets: five sessions a question, long ones cut."""
    hits = _collapsed(spark, sf_dir, 5).select("query_id", "session_id", "session_rk", F.round("sim", 4).alias("sim"))
    s = _sessions(spark, sf_dir).withColumnRenamed("conv_id", "session_id")
    e = hits.join(s, "session_id").withColumn("entry", sessions.history_entry(F.col("session_rk"), F.col("session_id").cast("string"), F.col("sim"), F.col("date"), F.col("turns"), 900))
    joined = e.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("session_rk", "entry"))).alias("x"))
    return joined.select("query_id", F.md5(F.array_join(F.transform("x", lambda y: y["entry"]), "")).alias("digest"))


@query("compose_document", f"""SELECT doc_id, md5(trim(text, {SPACES})) AS text_only, md5(source || ' ' || trim(text, {SPACES})) AS concat_space, md5(source || ' [SEP] ' || trim(text, {SPACES})) AS dpr_sep FROM documents""")
def compose_document(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", *[F.md5(files.compose(F.col("source"), F.col("text"), m)).alias(m) for m in ("text_only", "concat_space", "dpr_sep")])


@query("encode_inputs", "SELECT item_id, md5('query: ' || text || '</s>') AS digest FROM benchmark")
def encode_inputs(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(files.prepared(F.col("text"), "query: ", "</s>")).alias("digest"))


@query("cache_misses", "SELECT DISTINCT sha1('hashing|false|' || text) AS key FROM documents WHERE lang = 'de' AND text NOT IN (SELECT text FROM documents WHERE lang <> 'de' UNION SELECT text FROM conversations)")
def cache_misses(spark, sf_dir):
    """Keys of German documents that a cache of all other texts does not have."""
    key = files.cache_key(F.lit("hashing"), F.lit(False), F.col("text")).alias("key")
    d = table(spark, sf_dir, "documents")
    cache = d.where("lang <> 'de'").select(key).unionByName(table(spark, sf_dir, "conversations").select(key))
    return files.cache_misses(d.where("lang = 'de'").select(key), cache)


@query("resume_anti_join", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark, sf_dir):
    return analytics.remaining(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("hashed_vectors", f"""WITH t AS (SELECT item_id, md5(unnest({sql_terms('text')})) AS h FROM benchmark),
s AS (SELECT item_id, ('0x' || substr(h, 1, 8))::BIGINT % 64 AS b, CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END AS s FROM t),
v AS (SELECT item_id, b, sum(s)::DOUBLE AS x FROM s GROUP BY item_id, b)
SELECT item_id, b AS i, {r('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-8)')} AS x FROM v WHERE true QUALIFY x <> 0""")
def hashed_vectors(spark, sf_dir):
    v = sessions.hashed_vectors(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return v.select("item_id", F.posexplode("e").alias("i", "x")).where("x <> 0").select("item_id", F.col("i").cast("long").alias("i"), S.steady(F.col("x")).alias("x"))
