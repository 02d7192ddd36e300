"""Grouping of spelling variants (operator 13).

Method. Anagram hashing: a word's key is the sum of the fifth powers of its letters' code points, whatever their order.
Adding, removing or exchanging one letter changes the key by that letter's value, or by the difference of two, so each
word is listed under its own key and under its key less each of its letters' values.  Under such a meeting key the keys meet
that differ by one letter; where words of different keys do, the order of the letters is verified: what is left of a word
without the letter, as two position-weighted 64-bit sums, has to be the other word (a letter added or removed) or
what is left of the other word without the letter at the same place (a letter exchanged).

Scale. Counting words is the only work over the texts: tasks add up what they see in a dictionary of bounded size, Spark
adds up the rest.  The vocabulary is numbered in the order of its words, so that all later steps carry numbers; a word of m
letters has m + 1 rows of fixed size, however long it is.  No pairs are written: the words that meet with one remainder are
counted, and each takes the most frequent other one from the group's best two.  Such a group holds at most one word per
letter and place, so none is large; meeting keys of very many rows are broadcast (`tasks.met`).  Chains of forms are
followed by doubling, at most as often as their length has binary digits.

Edge cases. A null text has no words; a null doc_id counts as empty text in the choice of runs with a letter deleted.
Repeated rows count each.  Words may be of any length.  Ties go to the smaller word in code-point order.  An
empty table gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.llm.tasks import met
from vecmill.llm.windows import VALUES, mixed
from vecmill.session import prepare, scratch, table, written

HELD_WORDS = 200_000
RUN = re.compile("[a-zÀ-ÿ]+")
POWERS = np.arange(256, dtype=np.int64) ** 5


def runs_of(text: str) -> list[str]:
    """Runs of letters with A-Z lower-cased."""
    return RUN.findall(text.encode("utf-8").lower().decode("utf-8"))


def misspelt(doc_id: object, run: str, one_in: int) -> str:
    """The run, or, for one in so many pairs of document and run, the run without one letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted_words(docs: DataFrame, least_letters: int = 6, one_in: int | None = 199) -> DataFrame:
    """(word, n): occurrences of the words of at least so many letters, of parts of the table: to be added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in Counter(runs_of(text.as_py() or "")).items():
                    if one_in:
                        word = misspelt(doc_id, word, one_in)
                    if len(word) >= least_letters:
                        held[word] += n
                if len(held) >= HELD_WORDS:
                    yield pa.record_batch({"word": list(held), "n": list(held.values())})
                    held.clear()
        if held:
            yield pa.record_batch({"word": list(held), "n": list(held.values())})

    prepare(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long")


def _remainders(letters: np.ndarray, place: np.ndarray, first: np.ndarray, last: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of letters weighted by place: of each word, and of each word without each of its letters (those after it move up)."""
    factor = mixed(np.arange(int(place.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(977 + which)) | np.uint64(1)
    value = VALUES[which][letters]
    here = np.concatenate([[np.uint64(0)], np.cumsum(value * factor[place])])
    moved = np.concatenate([[np.uint64(0)], np.cumsum(value * factor[np.maximum(place - 1, 0)])])
    at = np.arange(len(letters))
    begin, end = at - place, np.repeat(last, last - first)
    return mixed(here[last] - here[first]), mixed(here[at] - here[begin] + moved[end] - moved[at + 1])


def meetings(vocabulary: DataFrame) -> DataFrame:
    """vocabulary: (id, word, n). Under each meeting key: the word itself (place -1) and the word without the letter at `place`.

    fresh: whether the letter differs from the one before; letters of one run leave the same when removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 20_000):
                batch = whole.slice(at, 20_000)
                listed = [w.encode("latin-1") for w in batch.column(1).to_pylist()]
                letters = np.frombuffer(b"".join(listed), np.uint8)
                size = np.array([len(w) for w in listed], np.int64)
                last = np.cumsum(size)
                first = last - size
                place = np.arange(len(letters)) - np.repeat(first, size)
                sums = np.concatenate([[0], np.cumsum(POWERS[letters])])
                key = sums[last] - sums[first]
                own, rest = zip(*(_remainders(letters, place, first, last, i) for i in range(2)), strict=True)
                fresh = np.ones(len(letters), bool)
                fresh[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
                both = lambda a, b: pa.array(np.concatenate([a, b]))
                each = np.repeat(np.arange(len(size)), size)
                no, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                cols = [both(key, key[each] - POWERS[letters]), both(key, key[each]), *(both(o.view(np.int64), r.view(np.int64)) for o, r in zip(own, rest, strict=True))]
                cols += [both(np.full(len(size), -1, np.int32), place.astype(np.int32)), both(np.ones(len(size), bool), fresh), both(no, no[each]), both(n, n[each])]
                yield pa.RecordBatch.from_arrays(cols, names=["meet", "key", "r1", "r2", "place", "fresh", "id", "n"])

    return vocabulary.select("id", "word", "n").mapInArrow(run, "meet long, key long, r1 long, r2 long, place int, fresh boolean, id long, n long")


def near_words(rows: DataFrame, total: int) -> DataFrame:
    """rows: meetings. (id, n_near, best): how many words are near, and the most frequent of them, (n, -id)."""
    keys = rows.groupBy("meet").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("c")).where("a <> b").select("meet", "c")
    remainder = ["meet", "r1", "r2"]
    open_ = met(rows.drop("key"), keys, ["meet"], total).drop("c").repartition(*remainder)
    best = F.struct("n", (-F.col("id")).alias("minus"))
    alone = F.col("place") < 0
    # one letter exchanged: the same remainder and place
    same = Window.partitionBy(*remainder, "place")
    order = same.orderBy(F.desc("n"), "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    exchanged = open_.where(~alone).withColumns({"others": F.count("*").over(same) - 1, "top": F.first(best).over(order), "second": F.nth_value(best, 2).over(order)})
    exchanged = exchanged.where("others > 0").select("id", F.col("others").alias("near"), F.when(-F.col("top.minus") == F.col("id"), F.col("second")).otherwise(F.col("top")).alias("best"))
    # one letter more or less: a remainder that is a word
    group = Window.partitionBy(*remainder)
    longer = F.when(~alone, best)
    added = open_.where(alone | F.col("fresh")).withColumns({"shorter": F.max(F.when(alone, best)).over(group), "longest": F.max(longer).over(group), "longers": F.count(longer).over(group)})
    added = added.where("shorter is not null and longers > 0").select("id", F.when(alone, F.col("longers")).otherwise(1).alias("near"), F.when(alone, F.col("longest")).otherwise(F.col("shorter")).alias("best"))
    return exchanged.unionByName(added).groupBy("id").agg(F.sum("near").alias("n_near"), F.max("best").alias("best"))


def variants(docs: DataFrame, least_letters: int = 6, least: int = 5, times: int = 5, one_in: int | None = 199) -> DataFrame:
    """The operator: (word, form, root, n, n_near, form_n) for each word of docs (doc_id, text).

    A form has to be `times` as frequent as the word (2 at least, so that chains end); one_in: see misspelt, None for none.
    """
    if times < 2:
        raise ValueError("a form has to be at least twice as frequent")
    with scratch(docs.sparkSession) as keep:
        counted = counted_words(docs, least_letters, one_in).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        vocabulary = keep(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "vocabulary")  # ids in the order of words
        rows = keep(meetings(vocabulary), "meetings")
        near = keep(near_words(rows, rows.count()), "near")
        far = (F.col("best.n") >= times * F.col("n")).alias("far")
        judged = keep(vocabulary.select("id", "n").join(near, "id", "left").select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(far, -F.col("best.minus")).alias("up"), F.when(far, F.col("best.n")).alias("form_n")), "judged")
        up = judged.where("up is not null").select("id", "up")
        while True:
            above = up.select(F.col("id").alias("up"), F.col("up").alias("next"))
            jumped = keep(up.join(above, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "roots")
            up = jumped.select("id", "up")
            if jumped.where("moved").isEmpty():
                break
        name = lambda as_id, as_word: vocabulary.select(F.col("id").alias(as_id), F.col("word").alias(as_word))
        found = vocabulary.join(judged, "id").join(up.withColumnRenamed("up", "top"), "id", "left").join(name("up", "form"), "up", "left").join(name("top", "root"), "top", "left")
        return written(found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the documents."""
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP13_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i AS b, i AS x, 0 AS s FROM range(256) AS r(i)
  UNION ALL SELECT b, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, s + 1 FROM steps WHERE s < 8),
crc AS (SELECT list(x ORDER BY b) AS t FROM steps WHERE s = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, list_transform(range(0, octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT) AS bs FROM each),
hashed AS (SELECT run, n, xor(list_reduce(bs, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM bytes, crc),
spelt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM spelt WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
parts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, 100) AS p(i) WHERE i <= length(word)),
links AS (
  SELECT a.word, b.word AS near, b.n AS m FROM parts a JOIN parts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM parts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM parts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS near, max(m) AS m FROM links GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM words w LEFT JOIN best USING (word)),
climb AS (
  SELECT word, coalesce(form, word) AS root, form IS NOT NULL AS go FROM formed
  UNION ALL SELECT c.word, coalesce(f.form, f.word), f.form IS NOT NULL FROM climb c JOIN formed f ON f.word = c.root WHERE go)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN climb c ON c.word = f.word AND NOT go
"""
