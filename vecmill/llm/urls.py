"""URL filtering by host and path rules (operator 9), in DataFrame functions only.

Method. The canonical rules (host, path) are put into a blocked Bloom filter: the hash of a rule picks one 64-bit
word, further hash bits pick bits of that word.  A url's candidates are each suffix of its host with each prefix of
its path that has the length of some rule's path; candidates that pass the filter go to an exact hash join with the
rules, which removes false positives; of the rules that fit, the longest wins (by host, then by path).

Scale. The filter has at most `max_words` words, so its size is bounded whatever the number of rules: beyond that
only false positives grow, which the join removes.  Whether a url has a possible hit is known in its own row: rows
without one meet nobody.  The others' distinct (host, path) alone go to the join; its result, a row for each of them,
is broadcast to the rows where it is small (its bytes are counted), so no other column is shuffled.  Beyond that rows
and results are joined by key, very frequent keys apart (`tasks.met`).

Edge cases. A null url or one without `://` has an empty host and path, no rule and the default verdict.  Rows are
kept as they are, repeated ones included.  Rules may repeat; of equal rules with different verdicts block wins.  Urls may
be of any length: of a host only ends of as many labels as some rule has are looked at, of a path only beginnings of a rule's
length.  Empty tables give no rows, without rules all get the default.  Other columns are carried, whatever their names; only
columns named host, path, rule or verdict are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.tasks import met
from vecmill.session import table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BITS = 6
BROADCAST_BYTES = 64 << 20

#: The rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _mask(host: Column, path: Column) -> Column:
    h = F.xxhash64(host, path, F.lit(1))
    mask = F.lit(0).cast("long")
    for i in range(BITS):
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 10 * i).bitwiseAND(F.lit(63)).cast("int")))
    return mask


def _small(table_: DataFrame, texts: list[str], most: int) -> bool:
    """Whether a table with these text columns has at most so many bytes."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(64))
    return table_.agg(F.coalesce(F.sum(width), F.lit(0))).first()[0] <= most


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_words: int = 131_072, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The operator: the rows of urls with host, path, rule (host and path of the one that fits, else null), verdict."""
    listed = rules.groupBy(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    words = min(max_words, 1 << max(0, math.ceil(math.log2(max(1, listed.count()) / 4))))
    word = lambda h, p: F.pmod(F.xxhash64(h, p), F.lit(words))
    filled = listed.groupBy(word(F.col("r_host"), F.col("r_path")).alias("w")).agg(F.bit_or(_mask(F.col("r_host"), F.col("r_path"))).alias("bits"))
    dense = filled.unionByName(filled.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    bloom = dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("bloom")).scalar()
    labels_of = lambda host: F.split(host, r"\.")
    facts = listed.agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths"), F.array_sort(F.collect_set(F.size(labels_of(F.col("r_host"))))).alias("labels"))

    carried = F.struct(*[f"`{c}`" for c in urls.columns]).alias("row")
    rows = urls.select(carried, host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    rows = rows.withColumns({"bloom": bloom, "lengths": facts.select("lengths").scalar(), "counts": facts.select("labels").scalar(), "labels": labels_of(F.col("host"))})
    n_labels = F.size("labels")
    ends = F.transform(F.filter("counts", lambda n: n <= n_labels), lambda n: F.array_join(F.slice("labels", n_labels - n + 1, n), "."))
    starts = lambda h: F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.struct(h.alias("h"), F.substring(F.col("path"), F.lit(1), n).alias("p")))
    possible = F.filter(F.flatten(F.transform(ends, starts)), lambda c: F.element_at("bloom", (word(c["h"], c["p"]) + 1).cast("int")).bitwiseAND(_mask(c["h"], c["p"])) == _mask(c["h"], c["p"]))
    rows = rows.select("row", "host", "path", F.when(F.col("host") == "", F.array().cast("array<struct<h:string,p:string>>")).otherwise(possible).alias("possible"))

    open_ = rows.where(F.size("possible") > 0)
    pages = open_.groupBy("host", "path").agg(F.count("*").alias("c"), F.first("possible").alias("possible"))
    hits = pages.select("host", "path", "c", F.explode("possible").alias("x")).select("host", "path", "c", F.col("x.h").alias("r_host"), F.col("x.p").alias("r_path"))
    if _small(listed, ["r_host", "r_path", "r_verdict"], broadcast_bytes):
        met_rules = hits.join(F.broadcast(listed), ["r_host", "r_path"], "left")
    else:
        hits = written(hits, "hits")
        asked = hits.groupBy("r_host", "r_path").agg(F.count("*").alias("often"))
        met_rules = met(hits, written(asked.join(listed, ["r_host", "r_path"], "left"), "asked"), ["r_host", "r_path"], hits.count(), "often")
    fit = F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))
    best = met_rules.groupBy("host", "path").agg(F.max(F.when(F.col("r_verdict").isNotNull(), fit)).alias("best"), F.max("c").alias("c"))
    best = written(best.select("host", "path", "c", "best.rule", "best.verdict"), "rules")
    if _small(best, ["host", "path", "rule", "verdict"], broadcast_bytes):
        judged = rows.drop("possible").join(F.broadcast(best.where("verdict is not null").drop("c")), ["host", "path"], "left")
    else:
        closed = rows.where(F.size("possible") == 0).select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
        judged = closed.unionByName(met(open_.drop("possible"), best, ["host", "path"], best.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]).drop("c"))
    made = ("host", "path", "rule", "verdict")
    return judged.select(*[F.col("row")[c].alias(c) for c in urls.columns if c.lower() not in made], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = f"""
WITH rules(verdict, r_host, r_path) AS (VALUES {", ".join(str(r) for r in RULES)}),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path
  FROM pages),
pairs AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT p.host, p.path, arg_max(r_host || r_path, length(r_host) * 100000 + length(r_path)) AS rule,
    arg_max(verdict, length(r_host) * 100000 + length(r_path)) AS verdict
  FROM pairs p JOIN rules r ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path)
  GROUP BY p.host, p.path)
SELECT page_id, parts.host AS host, parts.path AS path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
"""
