"""Terms, questions, value detectors and clean-up of generated text."""

from __future__ import annotations

from pyspark.sql import functions as F

from vecmill.functions import dates, text as T
from vecmill.functions import statistics as S
from vecmill.operators import review, scans
from vecmill.plans.base import SPACES, r
from vecmill.plans.registry import query
from vecmill.session import table


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


#: One question for each class, some with a date line before them.
QUESTIONS = [
    "What size is my new television?", "How long is my daily commute to the office?", "How many weeks did I stay in Lisbon?",
    "How many shirts did I pack for the trip to Lisbon?", "What color is the bedroom wall?", "When did I visit the Modern Museum?",
    "Current date: 2023/05/30 (Tue) 23:40\nWhere did I redeem the coupon for coffee creamer?", "What degree did I graduate with?",
    "Which play did I attend at the community theater?", "What did I buy for my sister's birthday gift?", "Who gave me the recipe?",
    "Tell me about my yoga classes", "", "Which years did the latest update change?",
]
#: Texts that assert a value on the topic, stay on the topic without one, or have one off the topic.
SNIPPETS = [
    "I finally bought a 55 inches television for the living room.", "My television is new and the size is great.",
    "My commute takes 45 minutes each way by train.", "The commute is long and I dislike driving.", "I stayed in Lisbon for 3 weeks.",
    "For the trip to Lisbon I packed 7 shirts and two pairs.", "The bedroom wall is painted a soft grey.", "We went to the Modern Museum on March 12.",
    "I used the coupon for coffee creamer at Target last Sunday.", "I graduated with a degree in Business Administration.",
    "At the theater I saw \"The Glass Menagerie\" with friends.", "I got a yellow dress for my sister's birthday.", "Rachel Green gave me the recipe.",
    "The store sold 30 items yesterday.", "Nothing happens here.", "", "Yoga with Anna Maria at the studio on 2023/05/20",
]
_Q = "q(qid, question) AS (VALUES " + ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(QUESTIONS)) + ")"
_S = "s(sid, text) AS (VALUES " + ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(SNIPPETS)) + ")"


def rows(spark, values, key, column):
    structs = [F.struct(F.lit(i).alias(key), F.lit(v).cast("string").alias(column)) for i, v in enumerate(values)]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def sql_terms(x: str) -> str:
    low = f"list_transform(regexp_extract_all(coalesce({x}, ''), {lit(T.TOKEN)}), lambda v: lower(v))"
    return f"list_filter(list_filter({low}, lambda v, i: list_position({low}, v) = i), lambda v: NOT list_contains({sql_list(T.STOP)}, v))"


def sql_body(q: str) -> str:
    b = f"trim(regexp_replace({q}, '(?i)^Current date:.*\n', ''), {SPACES})"
    return f"CASE WHEN {b} = '' THEN {q} ELSE {b} END"


def sql_binds(q: str) -> str:
    return f"list_filter({sql_terms(sql_body(q))}, lambda v: NOT list_contains({sql_list(T.GENERIC + T.LIGHT_VERBS)}, v))[1:8]"


def sql_class(q: str, field: int) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({sql_body(q)}), {lit(c[4])}) THEN {lit(c[field])}" for c in T.QUESTION_CLASSES[:-1])
    return f"CASE {whens} ELSE {lit(T.QUESTION_CLASSES[-1][field])} END"


@query("tokens", f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {sql_terms('text')} AS t FROM documents)")
def tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.ordered_terms(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("snippets", "SELECT doc_id, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 500) AS snippet FROM documents")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


@query("term_overlap", f"""WITH a AS (SELECT item_id, {sql_terms('text')} AS q FROM benchmark), m AS (SELECT list_distinct(flatten(list(q))) AS q FROM a),
d AS (SELECT doc_id, {sql_terms('text')} AS t FROM documents)
SELECT doc_id, {r('len(list_intersect(m.q, d.t)) / len(m.q)::DOUBLE')} AS overlap FROM d, m""")
def term_overlap(spark, sf_dir):
    """Share of the benchmark's terms in each document: a term table on one side, so no pairs are made."""
    asked = table(spark, sf_dir, "benchmark").select(F.explode(T.ordered_terms(F.col("text"))).alias("term")).distinct()
    n = asked.agg(F.count("*").alias("n")).scalar()
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(T.ordered_terms(F.col("text"))).alias("term"))
    met = d.join(asked.withColumn("hit", F.lit(1)), "term", "left").groupBy("doc_id").agg(F.sum(F.coalesce("hit", F.lit(0))).alias("h"))
    return met.select("doc_id", S.steady(F.col("h") / n).alias("overlap"))


@query("doc_freq", f"SELECT term, count(*) AS n FROM (SELECT unnest({sql_terms('text')}) AS term FROM documents) GROUP BY term")
def doc_freq(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.explode(T.ordered_terms(F.col("text"))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("n"))


@query("missing_terms", f"""WITH b AS (SELECT item_id, {sql_terms('text')} AS q FROM benchmark), c AS (SELECT DISTINCT unnest({sql_terms('text')}) AS term FROM conversations),
m AS (SELECT item_id, term FROM (SELECT item_id, unnest(q) AS term FROM b) ANTI JOIN c USING (term))
SELECT item_id, count(*) AS n, array_to_string(list_sort(list(term))[1:12], ' ') AS missing FROM m GROUP BY item_id""")
def missing_terms(spark, sf_dir):
    """Terms of each benchmark item that no conversation has, the first twelve in order."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.ordered_terms(F.col("text"))).alias("term"))
    c = table(spark, sf_dir, "conversations").select(F.explode(T.ordered_terms(F.col("text"))).alias("term")).distinct()
    left = b.join(c, "term", "left_anti").groupBy("item_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("term")).alias("t"))
    return left.select("item_id", "n", F.array_join(F.slice("t", 1, 12), " ").alias("missing"))


_STEMS = """list_sort(list_distinct(list_filter([w, CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN w[:-4] || 'y' END, CASE WHEN length(w) > 4 AND ends_with(w, 'es') THEN w[:-3] END,
 CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN w[:-2] END, CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN w[:-4] END, CASE WHEN length(w) > 5 AND ends_with(w, 'ing') THEN w[:-4] || 'e' END,
 CASE WHEN length(w) > 4 AND ends_with(w, 'ed') THEN w[:-3] END, CASE WHEN length(w) > 4 AND ends_with(w, 'ed') THEN w[:-2] END], lambda x: x IS NOT NULL AND length(x) > 2)))"""


@query("stems", f"WITH t AS (SELECT DISTINCT unnest({sql_terms('text')}) AS w FROM benchmark) SELECT w AS term, array_to_string({_STEMS}, ' ') AS stems FROM t")
def stems(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select(F.explode(T.ordered_terms(F.col("text"))).alias("term")).distinct()
    return t.select("term", F.array_join(F.array_sort(T.stems(F.col("term"))), " ").alias("stems"))


_GROUPS = "syn(w, g) AS (VALUES " + ", ".join(f"({lit(k)}, {sql_list(v)})" for k, v in T.synonym_groups().items()) + ")"


@query("synonyms", f"WITH {_GROUPS} SELECT w AS term, array_to_string(list_sort(list_distinct(list_concat({_STEMS}, g))), ' ') AS variants FROM syn")
def synonyms(spark, sf_dir):
    """Stems of every word of the dictionary, with all words that share a group with it."""
    t = rows(spark, list(T.synonym_groups()), "i", "term")
    return t.select("term", F.array_join(F.array_sort(T.variants(F.col("term"))), " ").alias("variants"))


@query("proxy_quality", f"""WITH q AS (SELECT conv_id, list_filter({sql_terms('text')}, lambda v: length(v) > 3) AS q FROM conversations WHERE turn = 0),
h AS (SELECT conv_id, turn AS rk, {sql_terms('text')} AS t FROM conversations WHERE turn > 0),
o AS (SELECT conv_id, rk, coalesce(len(list_intersect(q, t)) / nullif(len(q), 0)::DOUBLE, 0) AS ov FROM h JOIN q USING (conv_id))
SELECT conv_id, {r('2.0 * avg(ov) FILTER (rk <= 3) + avg((ov >= 0.15)::INT) FILTER (rk <= 3) + 0.3 * avg(ov)')} AS proxy FROM o GROUP BY conv_id""")
def proxy_quality(spark, sf_dir):
    """Coverage of a conversation's first turn by its later ones, the first three counting most."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("turn = 0").select("conv_id", F.filter(T.ordered_terms(F.col("text")), lambda v: F.length(v) > 3).alias("q"))
    hits = c.where("turn > 0").join(q, "conv_id").select("conv_id", F.col("turn").alias("rk"), T.overlap(F.col("q"), T.ordered_terms(F.col("text"))).alias("ov"))
    return review.proxy(hits, "conv_id").select("conv_id", S.steady(F.col("proxy")).alias("proxy"))


_ASKED = f"{_Q}, asked AS (SELECT 'q' || qid AS id, question FROM q UNION ALL SELECT 'c' || conv_id || '.' || turn, text FROM conversations WHERE role = 'user')"


def _asked(spark, sf_dir):
    q = rows(spark, QUESTIONS, "qid", "question").select(F.concat(F.lit("q"), "qid").alias("id"), "question")
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat(F.lit("c"), "conv_id", F.lit("."), "turn").alias("id"), F.col("text").alias("question"))
    return q.unionByName(c)


@query("target_slot", f"WITH {_ASKED} SELECT id, {sql_class('question', 0)} AS cls, {sql_class('question', 1)} AS grain, {sql_class('question', 2)} AS label FROM asked")
def target_slot(spark, sf_dir):
    a = _asked(spark, sf_dir).withColumn("s", T.target_slot(F.col("question")))
    return a.select("id", "s.cls", "s.grain", "s.label")


@query("hop_phrase", f"""WITH {_ASKED}, b AS (SELECT id, {sql_binds('question')} AS binds, {sql_class('question', 3)} AS tail FROM asked)
SELECT id, array_to_string(binds, ' ') AS binds, CASE WHEN len(binds) = 0 THEN '' ELSE substr(array_to_string(list_append(binds[1:5], tail), ' '), 1, 80) END AS hop,
 array_to_string(list_filter(binds, lambda v: length(v) >= 4 AND NOT list_contains({sql_list(T.WEAK_BINDS)}, v))[1:6], ' ') AS distinctive FROM b""")
def hop_phrase(spark, sf_dir):
    a = _asked(spark, sf_dir).withColumn("b", T.bind_terms(F.col("question"))).withColumn("s", T.target_slot(F.col("question")))
    return a.select("id", F.array_join("b", " ").alias("binds"), T.hop_phrase(F.col("b"), F.col("s.tail")).alias("hop"), F.array_join(T.distinctive_binds(F.col("question")), " ").alias("distinctive"))


_FLAGS = ["measure", "size", "duration", "day", "month", "color", "place", "degree", "stage", "quoted", "bought"]


@query("value_detectors", f"""SELECT doc_id, {', '.join(f"regexp_matches(text, {lit(T.DETECTORS[f])}) AS has_{f}" for f in _FLAGS)},
 regexp_matches(regexp_replace(text, {lit(T.COUNTED_DAYS)}, ' ', 'g'), {lit(T.DETECTORS['count'])}) AS has_count FROM documents""")
def value_detectors(spark, sf_dir):
    """Which kinds of values each document has."""
    d = table(spark, sf_dir, "documents").withColumn("counted", F.regexp_replace("text", T.COUNTED_DAYS, " "))
    return scans.matched(d, "doc_id", {f"has_{f}": ("counted" if f == "count" else "text", T.DETECTORS[f]) for f in [*_FLAGS, "count"]})


_EDGE = r"[^\p{L}\p{N}_]"  # of words as Unicode has them; this dialect's own borders know ASCII only
_NAMES = rf"(?:^|{_EDGE})([A-Z][a-zA-Z0-9'&.-]+(?:\s+[A-Z][a-zA-Z0-9'&.-]+)*\s+[A-Z][a-zA-Z0-9'&.-]*[a-zA-Z0-9])(?:$|{_EDGE})"


def sql_value(text: str) -> str:
    """Whether a text has a value of the asked class; beside columns question, cls and grain."""
    v = {f: f"regexp_matches({text}, {lit(T.DETECTORS[f])})" for f in T.DETECTORS} | {"count": f"regexp_matches(regexp_replace({text}, {lit(T.COUNTED_DAYS)}, ' ', 'g'), {lit(T.DETECTORS['count'])})"}
    new = f"len(list_filter(regexp_extract_all({text}, {lit(_NAMES)}, 1), lambda p: NOT contains(lower({sql_body('question')}), lower(p)))) > 0"
    entity = f"({v['quoted']} OR {new})"
    return f"""CASE WHEN grain = 'size' THEN {v['size']} WHEN grain = 'duration' THEN {v['duration']} WHEN cls = 'count' THEN {v['count']} WHEN cls = 'datetime' THEN {v['day']}
 WHEN cls = 'place' THEN {v['place']} OR {new} WHEN cls = 'color' THEN {v['color']} WHEN cls = 'item' THEN {v['bought']} OR {entity} WHEN grain = 'degree' THEN {v['degree']}
 WHEN grain = 'title' THEN ({v['stage']} OR contains(lower({text}), 'play')) AND {entity} ELSE {entity} END"""


SQL_GROUPS, SQL_Q, SQL_S = _GROUPS, _Q, _S
SQL_VARIANTS = f"list_distinct(list_concat({_STEMS.replace('(w', '(lower(b)').replace('[w,', '[lower(b),').replace(' w[', ' b[').replace('length(w)', 'length(b)').replace('ends_with(w', 'ends_with(b')}, coalesce(g, [])))"


@query("value_asserted", f"""WITH {_Q}, {_S}, {_GROUPS}, qs AS (SELECT qid, question, {sql_class('question', 0)} AS cls, {sql_class('question', 1)} AS grain, {sql_binds('question')} AS binds FROM q),
qb AS (SELECT qid, unnest(binds[1:6]) AS b FROM qs), qv AS (SELECT DISTINCT qid, unnest({SQL_VARIANTS}) AS v FROM qb LEFT JOIN syn ON w = b),
ok AS (SELECT qid, sid, text, bool_or(list_contains({sql_terms('text')}, v) OR regexp_matches(text, '(?i)\\b' || v || '\\b')) AS bound FROM qv, s GROUP BY ALL)
SELECT qs.qid, s.sid, (len(binds) = 0 OR coalesce(bound, false)) AND {sql_value('s.text')} AS asserted
FROM qs CROSS JOIN s LEFT JOIN ok ON ok.qid = qs.qid AND ok.sid = s.sid""")
def value_asserted(spark, sf_dir):
    """Every question of the fixture against every text of it."""
    q = rows(spark, QUESTIONS, "qid", "question").withColumn("slot", T.target_slot(F.col("question"))).withColumn("binds", T.bind_terms(F.col("question")))
    s = rows(spark, SNIPPETS, "sid", "text").withColumn("terms", T.ordered_terms(F.col("text")))
    both = q.join(F.broadcast(s), F.lit(True))
    return both.select("qid", "sid", T.value_asserted(F.col("text"), F.col("terms"), F.col("question"), F.col("slot"), F.col("binds")).alias("asserted"))


DATES = ["2023/05/20 (Sat) 02:21", "2023-05-20", "2023/5/2 1:05", "on 2023/05/20", "2023/13/01", "", "2023/05/20 23:59:30", "no date", "1999-1-1 then 2001-2-2"]
_DATES = "d(i, raw) AS (VALUES " + ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(DATES)) + f", ({len(DATES)}, NULL))"


@query("parse_dates", f"""WITH {_DATES}, a AS (SELECT i, raw FROM d UNION ALL SELECT 1000 + o_orderkey, strftime(o_orderdate, '%Y/%m/%d (%a) %H:%M') FROM orders),
p AS (SELECT i, try_strptime(regexp_extract(raw, {lit(dates.PATTERN)}, 1) || '-' || regexp_extract(raw, {lit(dates.PATTERN)}, 2) || '-' || regexp_extract(raw, {lit(dates.PATTERN)}, 3), '%Y-%m-%d') AS day, regexp_extract(raw, {lit(dates.CLOCK)}, 1) AS h, regexp_extract(raw, {lit(dates.CLOCK)}, 2) AS m FROM a)
SELECT i::BIGINT AS i, {r("date_diff('day', DATE '1970-01-01', day::DATE) + 719163 + CASE WHEN h <> '' THEN h::INT / 24.0::DOUBLE + m::INT / 1440.0::DOUBLE ELSE 0 END")} AS days FROM p""")
def parse_dates(spark, sf_dir):
    """The fixture's dates, and every order's date as text."""
    f = rows(spark, [*DATES, None], "i", "raw").select(F.col("i").cast("long").alias("i"), "raw")
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1000).alias("i"), F.date_format("o_orderdate", "yyyy/MM/dd (EEE) HH:mm").alias("raw"))
    return f.unionByName(o).select("i", S.steady(dates.parse_days(F.col("raw"))).alias("days"))


VERDICTS = ['{"correct": true}', '{"correct": true} then {"correct": FALSE}', "**Yes**.", "Label: no", "Yes or No", "", "I think so\nyes!", "Answer yes if right\nno.", "Yes, it is", "`No`\nLABEL - Yes"]
_VERDICTS = "v(i, verdict) AS (VALUES " + ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(VERDICTS)) + ")"
_LINES = "list_filter(list_transform(string_split(verdict, chr(10)), lambda x: trim(regexp_replace(trim(regexp_replace(x, '[*`#_]', '', 'g'), " + SPACES + "), '[.!]+$', ''), " + SPACES + ")), lambda x: x <> '' AND NOT regexp_matches(x, " + lit(T.ECHO) + ") AND regexp_matches(x, " + lit(T.LABEL) + "))"


SQL_VERDICTS, SQL_LABEL_LINES = _VERDICTS, _LINES


@query("judge_labels", f"""WITH {_VERDICTS}, a AS (SELECT i, verdict FROM v UNION ALL SELECT 1000 + doc_id, text FROM documents),
p AS (SELECT i, regexp_extract_all(verdict, {lit(T.JSON_LABEL)}, 1) AS packed, {_LINES} AS labels FROM a)
SELECT i::BIGINT AS i, CASE WHEN len(packed) > 0 THEN lower(packed[-1]) = 'true' ELSE coalesce(ends_with(lower(labels[-1]), 'yes'), false) END AS label FROM p""")
def judge_labels(spark, sf_dir):
    f = rows(spark, VERDICTS, "i", "verdict").select(F.col("i").cast("long").alias("i"), "verdict")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("i"), F.col("text").alias("verdict"))
    return f.unionByName(d).select("i", T.judge_label(F.col("verdict")).alias("label"))


HYPOTHESES = ["The answer is forty-five minutes each way.\nWe need to answer now", "Short\nLet me think", "Plain answer", "", "  A longer answer with spaces   \nNeed answer in one line"]
_HYP = "h(i, t) AS (VALUES " + ", ".join(f"({i}, {lit(x)})" for i, x in enumerate(HYPOTHESES)) + ")"


@query("clip_text", f"""WITH {_HYP}, a AS (SELECT i, trim(t, {SPACES}) AS t FROM h UNION ALL SELECT 1000 + doc_id, trim(text, {SPACES}) FROM documents), p AS (SELECT i, t, length(regexp_extract(t, '(?s)^(.*?)' || {lit(T.PLANNING[4:])}, 1, 'i')) AS pos, regexp_matches(t, {lit(T.PLANNING)}) AS leaked FROM a)
SELECT i::BIGINT AS i, md5(CASE WHEN leaked AND pos >= 24 THEN trim(substr(t, 1, pos), {SPACES}) ELSE t END) AS digest FROM p""")
def clip_text(spark, sf_dir):
    f = rows(spark, HYPOTHESES, "i", "t").select(F.col("i").cast("long").alias("i"), "t")
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("i"), F.col("text").alias("t"))
    return f.unionByName(d).select("i", F.md5(T.clip_planning(F.col("t"))).alias("digest"))


@query("leak_check", r"""WITH w AS (SELECT doc_id, unnest(generate_series(0, length(s) - 24, 24)) AS pos, s FROM (SELECT item_id AS doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS s FROM benchmark)),
p AS (SELECT DISTINCT doc_id AS item_id, substr(s, pos + 1, 24) AS piece FROM w),
d AS (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS s FROM documents)
SELECT d.doc_id, count(DISTINCT p.item_id) AS n_leaked FROM d JOIN p ON contains(d.s, p.piece) GROUP BY d.doc_id""")
def leak_check(spark, sf_dir):
    """Documents that hold a 24-character piece of a benchmark item.

    A table of bits of the pieces' hashes, of bounded size, lets few windows of a text out of its row; these meet the
    pieces in an equality join.  The hashes of all windows of a text are made together, by doubling their length.
    """
    tight = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    b = table(spark, sf_dir, "benchmark").select("item_id", tight(F.col("text")).alias("s")).where(F.length("s") >= 24)
    pieces = b.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.length("s") - 24, F.lit(24)), lambda a: F.substring(F.col("s"), a + 1, F.lit(24)))).alias("piece")).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", tight(F.col("text")).alias("s")).where(F.length("s") >= 24)
    windows = scans.marked_windows(d, "doc_id", scans.leak_bits(pieces, "piece"))
    return windows.join(pieces, "piece").groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_leaked"))


_DOC = "'head ' || doc_id || chr(10) || '<!-- EVOLVE:QUERY:START -->' || chr(10) || text || chr(10) || '<!-- EVOLVE:QUERY:END -->' || chr(10) || '<!-- EVOLVE:RANK:START -->' || source || '<!-- EVOLVE:RANK:END --> tail <!-- EVOLVE:FILTER:START --><!-- EVOLVE:FILTER:END -->'"


@query("slot_parse", rf"""WITH d AS (SELECT doc_id, text, source, {_DOC} AS doc FROM documents)
SELECT doc_id, md5(trim(regexp_extract(doc, '(?s)<!-- EVOLVE:QUERY:START -->(.*?)<!-- EVOLVE:QUERY:END -->', 1))) AS query_digest, regexp_extract(doc, '(?s)<!-- EVOLVE:RANK:START -->(.*?)<!-- EVOLVE:RANK:END -->', 1) AS rank_body,
 sha256('head ' || doc_id || chr(10) || '<!-- EVOLVE:QUERY:START --><!-- EVOLVE:QUERY:END -->' || chr(10) || '<!-- EVOLVE:RANK:START --><!-- EVOLVE:RANK:END --> tail <!-- EVOLVE:FILTER:START --><!-- EVOLVE:FILTER:END -->') AS backbone, true AS held FROM d""")
def slot_parse(spark, sf_dir):
    """Slots of a marked document, its backbone's hash, and that replacing one slot leaves the backbone."""
    d = table(spark, sf_dir, "documents")
    nl = F.lit("\n")
    doc = F.concat(F.lit("head "), F.col("doc_id").cast("string"), nl, F.lit("<!-- EVOLVE:QUERY:START -->"), nl, "text", nl, F.lit("<!-- EVOLVE:QUERY:END -->"), nl, F.lit("<!-- EVOLVE:RANK:START -->"), "source", F.lit("<!-- EVOLVE:RANK:END --> tail <!-- EVOLVE:FILTER:START --><!-- EVOLVE:FILTER:END -->"))
    d = d.withColumn("doc", doc)
    body = F.regexp_extract("doc", r"(?s)<!-- EVOLVE:QUERY:START -->(.*?)<!-- EVOLVE:QUERY:END -->", 1)
    held = T.backbone(T.with_slot(F.col("doc"), "FILTER", "keep all")) == T.backbone(F.col("doc"))
    return d.select("doc_id", F.md5(F.trim(body)).alias("query_digest"), T.slot_body(F.col("doc"), "RANK").alias("rank_body"), T.backbone(F.col("doc")).alias("backbone"), held.alias("held"))


PHRASES = ["commute time", "  the daily  commute!", "a very long phrase that has far too many words in it", "coffee creamer", "Is it?", "coupon", "what when", "red bicycle tyre", "COMMUTE TIME"]


_CLEAN = "trim(trim(regexp_replace(s, '\\s+', ' ', 'g'), ' '), ' .,;:\"''`')"
_PARTS = "string_split(s, ' ')"
_FINE = f"""s <> '' AND NOT contains(s, '.') AND NOT contains(s, '?') AND length(s) <= 48 AND len({_PARTS}) <= 4 AND len(list_filter({_PARTS}, lambda w: NOT list_contains({sql_list(T.STOP + T.GENERIC)}, w))) > 0
 AND NOT (length(s) >= 12 AND contains({lit(' '.join(SNIPPETS).lower())}, lower(s))) AND (contains(low, lower(s)) OR len(list_filter({_PARTS}, lambda w: length(w) > 2 AND contains(low, lower(w)))) > 0 OR len({_PARTS}) <= 2)"""


@query("sanitize_phrases", f"""WITH {_Q}, p AS (SELECT unnest(range({len(PHRASES)})) AS i, unnest({sql_list(PHRASES)}) AS s), x AS (SELECT qid, i, {_CLEAN} AS s, lower({sql_body('question')}) AS low FROM q CROSS JOIN p),
f AS (SELECT qid, lower(s) AS s, min(i) AS i FROM x WHERE {_FINE} GROUP BY ALL)
SELECT q.qid, coalesce(array_to_string((list(s ORDER BY i) FILTER (s IS NOT NULL))[1:3], '|'), '') AS phrases FROM q LEFT JOIN f USING (qid) GROUP BY q.qid""")
def sanitize_phrases(spark, sf_dir):
    """Phrases of a reviewer cleaned against each question."""
    q = rows(spark, QUESTIONS, "qid", "question")
    return q.select("qid", F.array_join(review.sane_phrases(F.array(*map(F.lit, PHRASES)), F.col("question"), F.lit(" ".join(SNIPPETS))), "|").alias("phrases"))
