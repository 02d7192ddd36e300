"""Mining of collocations (operator 12).

Method. Hashed counting in passes over the texts, one per phrase length.  While pass k counts phrases of k words exactly, it
also hashes the phrases of k + 1 words into buckets and counts these.  A bitmap of the buckets that reach the threshold
is broadcast to the next pass, beside a bitmap of the phrases of k words that were found frequent; a phrase of k + 1 words
is counted only if its bucket is frequent and both phrases of k words inside it are (Apriori), and it takes part in the
next bucket counts only then.  What is left is counted exactly.  Both bitmaps have `buckets` bits and only ever let too much
through, so the result does not depend on their size.

Scale. Nothing but the two bitmaps (2 MB each) is broadcast.  Words of a slice of texts are numbered by a dictionary, phrases
by pairs of numbers, all exactly, so a slice sends one row per distinct phrase, and Spark adds them up.  Bucket counts, cut off at
the threshold, are added block by block.  Frequencies of a phrase's parts are joined to its cuts, with very frequent parts
(`tasks.met`) broadcast.  A phrase inside a longer one of its frequency is inside one that is longer by one word too, so two
rows per phrase decide what is dropped.

Edge cases. A null text has no words, a null lang is `und`.  Repeated rows count each.  Texts may be of any length; they are
worked through in slices that end where a piece ends.  Ties are broken by the phrase, in the order of its bytes.  An empty
table, or one without frequent phrases, gives no rows.  Other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.llm.tasks import met
from vecmill.llm.windows import mixed
from vecmill.session import prepare, scratch, table, written

SLICE_BYTES = 4 << 20
BLOCK = 1 << 16
BREAKS = re.compile(rb"[.,;:!?\n-\r]")
_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: between words, 2: between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hashes(strings: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(s) for s in strings), np.uint64, len(strings))


def hash_of(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hashes of phrases of len(words) words from those of their languages and words."""
    out = mixed(langs)
    for w in words:
        out = mixed(out * _STEP + w)
    return out


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, np.ndarray, list[str]]]:
    """(lang, text) rows as lower-cased texts joined by line ends, of about SLICE_BYTES, with the ends and langs of the texts."""
    parts: list[bytes] = []
    langs: list[str] = []
    size = 0

    def full() -> tuple[bytes, np.ndarray, list[str]]:
        return b"\n".join(parts), np.cumsum([len(p) + 1 for p in parts]), langs

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data, at = (text.as_py() or "").encode("utf-8").lower(), 0
            while at < len(data):
                end = len(data)
                if end - at > SLICE_BYTES:
                    border = BREAKS.search(data, at + SLICE_BYTES)
                    end = border.end() if border else end
                parts.append(data[at:end])
                langs.append(lang)
                size, at = size + end - at, end
                if size >= SLICE_BYTES:
                    yield full()
                    parts, langs, size = [], [], 0
    if parts:
        yield full()


class Words:
    """The words of a slice: for each its number, the number of its language and of its piece."""

    def __init__(self, data: bytes, ends: np.ndarray, langs: list[str]):
        raw = np.frombuffer(data, np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, stops = edge[::2], edge[1::2]
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
        listed = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        found = listed.dictionary_encode()
        self.known, self.number = found.dictionary, found.indices.to_numpy().astype(np.int64)
        self.langs = sorted(set(langs))
        of_lang = {x: i for i, x in enumerate(self.langs)}
        of_text = np.array([of_lang[x] for x in langs], np.int64)
        self.lang = of_text[np.searchsorted(ends, starts, "right")]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.lang_hash = _hashes([x.encode("utf-8") for x in self.langs])[self.lang] if len(starts) else np.empty(0, np.uint64)
        self.hash = _hashes([x.encode("utf-8") for x in self.known.to_pylist()])[self.number] if len(starts) else np.empty(0, np.uint64)

    def whole(self, k: int) -> np.ndarray:
        """Which words begin k words of one piece."""
        n = max(0, len(self.piece) - k + 1)
        return self.piece[:n] == self.piece[k - 1 :]

    def hashed(self, k: int) -> np.ndarray:
        n = max(0, len(self.hash) - k + 1)
        return hash_of(self.lang_hash[:n], [self.hash[j : n + j] for j in range(k)])

    def counted(self, at: np.ndarray, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(lang, phrase, count) of the distinct phrases of k words that begin at those places."""
        wide = max(1, len(self.known))
        ids = self.lang[at] * wide + self.number[at]
        for j in range(k):
            if j:
                ids = ids * wide + self.number[at + j]
            ids = pa.array(ids).dictionary_encode().indices.to_numpy().astype(np.int64)
        count = np.bincount(ids)
        first = np.empty(len(count), np.int64)
        first[ids[::-1]] = at[::-1]
        parts = [self.known.take(pa.array(self.number[first + j])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0]
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[first])), phrase, count


def has(bits: np.ndarray, hashed: np.ndarray, shift: int) -> np.ndarray:
    at = hashed >> np.uint64(shift)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def one_pass(docs: DataFrame, k: int, most: int, least: int, buckets: int, bitmaps: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """docs: (lang, text). Rows (lang, phrase, n) of phrases of k words, a row per slice, and rows (block, counts) of the
    buckets of k + 1 words, a row per task and block that has any."""
    shift = 64 - buckets.bit_length() + 1
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)
    kind = np.uint8 if least < 256 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "n", "block", "counts"]
        counters = np.zeros(buckets if k < most else 0, np.uint32)
        for data, ends, langs in slices(batches):
            words = Words(data, ends, langs)
            open_ = words.whole(k)
            if k > 1:
                frequent, inside = shared.value
                part = has(inside, words.hashed(k - 1), shift)
                open_ &= has(frequent, words.hashed(k), shift) & part[:-1][: len(open_)] & part[1:][: len(open_)]
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            lang, phrase, count = words.counted(at, k)
            none = pa.nulls(len(count))
            yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(count.astype(np.int64)), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
            if k < most:
                longer = words.whole(k + 1) & open_[:-1] & open_[1:]
                where = (words.hashed(k + 1)[longer] >> np.uint64(shift)).astype(np.int64)
                np.add.at(counters, where, np.uint32(1))
                if len(where) and counters[where].max() > 1 << 31:
                    np.minimum(counters, least, out=counters)
        if k < most:
            packer = zstandard.ZstdCompressor(level=1)
            grid = np.minimum(counters, least).astype(kind).reshape(-1, BLOCK)
            for block in np.flatnonzero(grid.any(1)).tolist():
                row = [pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([packer.compress(grid[block].tobytes())], pa.binary())]
                yield pa.RecordBatch.from_arrays(row, names=names)

    return docs.mapInArrow(run, "lang string, phrase string, n long, block int, counts binary")


def _frequent_buckets(rows: DataFrame, least: int, buckets: int) -> np.ndarray:
    """The bitmap of the buckets whose counts (block, counts) add up to `least`."""
    kind = np.uint8 if least < 256 else np.uint32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, sums = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                row = np.frombuffer(unpacker.decompress(counts.as_py()), kind)
                sums[block] = np.minimum(sums[block] + row, least) if block in sums else row.astype(np.uint32)
        if sums:
            bits = [np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["block", "bits"])

    out = np.zeros(buckets // 8, np.uint8)
    for r in rows.repartition("block").mapInArrow(add, "block int, bits binary").collect():  # buckets / 8 bytes
        out[r["block"] * BLOCK // 8 :][: BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _bitmap(phrases: DataFrame, k: int, buckets: int) -> np.ndarray:
    """The bitmap of the hashes of phrases (lang, phrase) of k words."""
    shift = np.uint64(64 - buckets.bit_length() + 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = [x.encode("utf-8").split(b" ") for x in batch.column(1).to_pylist()]
                langs = _hashes([x.encode("utf-8") for x in batch.column(0).to_pylist()])
                at = hash_of(langs, [_hashes([w[j] for w in words]) for j in range(k)]) >> shift
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((at & np.uint64(63)).astype(np.int32))], names=["word", "bit"])

    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    found = phrases.select("lang", "phrase").mapInArrow(place, "word long, bit int").groupBy("word").agg(F.bit_or(one).alias("bits")).toArrow()  # buckets / 64 rows at most
    out = np.zeros(buckets // 64, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def frequencies(docs: DataFrame, keep: Callable[[DataFrame, str], DataFrame], most: int = 5, least: int = 100, buckets: int = 1 << 24) -> tuple[DataFrame, DataFrame]:
    """docs: (lang, text). ((lang, n): all words; (lang, phrase, k, f): phrases of up to `most` words that occur `least` times)."""
    if buckets % BLOCK or buckets & (buckets - 1):
        raise ValueError(f"buckets has to be a power of two and {BLOCK} at least")
    totals, tables, bitmaps = None, [], None
    for k in range(1, most + 1):
        rows = keep(one_pass(docs, k, most, least, buckets, bitmaps), f"phrases-{k}")
        counts = rows.where("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            totals = keep(rows.where("block is null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        tables.append(keep(counts.where(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("k"), "f"), f"frequent-{k}"))
        if k == most or tables[-1].isEmpty():
            break
        bitmaps = _frequent_buckets(rows.where("block is not null").select("block", "counts"), least, buckets), _bitmap(tables[-1], k, buckets)
    found = tables[0]
    for t in tables[1:]:
        found = found.unionByName(t)
    return totals, found


def collocations(docs: DataFrame, top: int = 2000, most: int = 5, least: int = 100, buckets: int = 1 << 24) -> DataFrame:
    """The operator: docs (lang, text) to each language's best phrases, (lang, rank, phrase, a, l, r, n, score)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.col("text").isNotNull())
    with scratch(docs.sparkSession) as keep:
        totals, found = frequencies(rows, keep, most, least, buckets)
        words = F.split("phrase", " ")
        joined = lambda first, n: F.array_join(F.slice("w", first, n), " ")
        listed = found.where("k > 1").withColumn("w", words)
        inner = listed.where("k > 2").select("lang", F.explode(F.array(joined(1, F.col("k") - 1), joined(2, F.col("k") - 1))).alias("phrase"), "f")
        longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        open_ = listed.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < f").select("lang", "phrase", "k", "w", F.col("f").alias("a"))
        cuts = open_.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
        cuts = keep(cuts.select("lang", "phrase", "a", "cut", joined(1, F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")), "cuts")
        total = cuts.count()
        for part, name in (("first", "l"), ("rest", "r")):
            keys = cuts.groupBy("lang", part).agg(F.count("*").alias("c"))
            parts = keep(keys.join(found.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part]), f"parts-{name}")
            cuts = met(cuts, parts, ["lang", part], total).drop("c", part)
        cuts = cuts.join(totals, "lang")
        wide = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
        score = F.expr("(a_ * n_) div (l_ * r_)")
        scored = cuts.withColumns({"a_": wide("a", 16) * F.lit(1000).cast("decimal(4,0)"), "n_": wide("n", 17), "l_": wide("l", 18), "r_": wide("r", 18)}).withColumn("score", score)
        lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"), F.first("a").alias("a"), F.first("n").alias("n"))
        best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = lowest.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
        return written(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first 2000 phrases of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents WHERE text IS NOT NULL),
listed AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM listed, range(1, 6) AS ks(k)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
found AS (SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE f >= 100),
longer AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f
  FROM found, range(2, 5) AS ms(m), range(1, 5) AS begins(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
kept AS (
  SELECT f.* FROM found f LEFT JOIN longer x ON f.lang = x.lang AND f.phrase = x.phrase
  WHERE f.k > 1 AND (x.f IS NULL OR 100 * x.f < 100 * f.f)),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, n,
    ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM kept c JOIN range(1, 5) AS cs(cut) ON cut < c.k
    JOIN found l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ')
    JOIN found r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:c.k], ' ')
    JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
