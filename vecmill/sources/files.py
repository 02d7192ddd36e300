"""Readers and writers of the formats that retrieval experiments use; all read files in splits."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.functions.text import strip
from vecmill.operators.search import top_k
from vecmill.session import dealt, written

ESCAPED = re.compile(r"\\.", re.DOTALL)


def split_line(line: Column) -> Column:
    return F.split(F.trim(line), r"\s+")


def parse_qrels(lines: DataFrame, tasks: int | None = None) -> DataFrame:
    """lines (at, first, value) to (query_id, doc_id, rel): three columns, or four with an unused second one.

    A header counts only as first line of its file; blank lines are skipped; of repeated judgements the last line
    wins; a line of another shape raises when it is read.  tasks: in how many parts pairs are brought together, the
    session's number of them if None.
    """
    parts = lines.where(F.trim("value") != "").withColumn("p", split_line(F.col("value")))
    data = parts.where(~(F.col("first") & F.lower(F.get("p", F.lit(0))).isin("query-id", "qid")))
    size = F.size("p")
    fields = F.when(size == 3, F.struct(F.get("p", F.lit(0)).alias("q"), F.get("p", F.lit(1)).alias("d"), F.get("p", F.lit(2)).alias("r"))).when(size >= 4, F.struct(F.get("p", F.lit(0)).alias("q"), F.get("p", F.lit(2)).alias("d"), F.get("p", F.lit(3)).alias("r"))).otherwise(F.raise_error(F.concat(F.lit("not a judgement: "), F.col("value"))))
    rows = data.withColumn("f", fields).select("at", F.col("f.q").alias("query_id"), F.col("f.d").alias("doc_id"), F.col("f.r").cast("double").cast("int").alias("rel"))
    if tasks is not None:
        rows = rows.repartition(tasks, "query_id", "doc_id")
    return rows.groupBy("query_id", "doc_id").agg(F.max_by("rel", "at").alias("rel"))


def line_place() -> Column:
    """Where a line stands: file, first byte of its split, place within the split. Ascends along a file, however it is split."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))


def ordered_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(at, first, value): the lines of text files with their place, and whether they are the first of their file.

    Files are split as usual.  Rows of a split arrive in order, so the first row of a split at byte 0 is a file's first line.
    """
    raw = spark.read.text(path, lineSep=separator).select(line_place().alias("at"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple | None = None
        for batch in batches:
            file, block = (batch.column(0).field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.ones(len(file), bool)
            new[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
            if len(file):
                new[0] = seen != (file[0], block[0])
                seen = (file[-1], block[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new & (block == 0)), batch.column(1)], names=["at", "first", "value"])

    return raw.mapInArrow(run, f"at {raw.schema['at'].dataType.simpleString()}, first boolean, value string")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(at, first, value) as of `ordered_lines`, with the place as one number: aggregates keep that in a few bytes, where the
    name of the file would be most of a row.

    High bits: the file's number by name.  Low bits: the split's first byte and the line's number there, which ascend
    together because a line has a byte at least; the line that begins at a split's end is still read by that split.
    """
    raw = spark.read.text(path)
    names = {name: i for i, name in enumerate(sorted(raw.inputFiles(), key=unquote))}
    if len(names) > 1 << 19:
        raise ValueError(f"{path}: too many files to number")
    known = spark.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple | None = None
        base = 0  # what is added to n in the split that goes on
        for batch in batches:
            if not batch.num_rows:
                continue
            n, block = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            files_ = batch.column(0).dictionary_encode()
            file = files_.indices.to_numpy()
            numbers = np.array([known.value[x] for x in files_.dictionary.to_pylist()], np.int64)[file]
            new = np.ones(len(n), bool)
            new[1:] = (file[1:] != file[:-1]) | (block[1:] != block[:-1])
            new[0] = seen != (numbers[0], block[0])
            seen = numbers[-1], block[-1]
            begin = np.flatnonzero(new)
            bases = np.concatenate([[base], (numbers[begin] << 44) + block[begin] + (block[begin] > 0) - n[begin]])
            base = bases[-1]
            yield pa.RecordBatch.from_arrays([pa.array(n + bases[np.cumsum(new)]), pa.array(new & (block == 0)), batch.column(3)], names=["at", "first", "value"])

    n, block = F.monotonically_increasing_id(), F.col("_metadata.file_block_start")
    return raw.select(F.input_file_name().alias("file"), n.alias("n"), block.alias("block"), "value").mapInArrow(run, "at long, first boolean, value string")


def with_first_line(lines: DataFrame, first: str) -> DataFrame:
    """lines (value) with a line before those of each task, so that each file that is written begins with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([first])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    return lines.select("value").mapInArrow(run, "value string")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """Judgements of text files. Pairs come together in as many parts as the files have 8 MB, so that no task holds more for more files."""
    return parse_qrels(numbered_lines(spark, path), dealt(spark.read.text(path)))


def read_texts(spark: SparkSession, path: str, title_mode: str = "concat_space") -> DataFrame:
    """JSON lines with _id, title, text (or contents, or query): (id, title, text, composed); the last line of an id wins."""
    raw = spark.read.schema("_id string, title string, text string, contents string, query string").json(path)
    text = F.coalesce("text", "contents", "query", F.lit(""))
    rows = raw.where(F.col("_id").isNotNull()).select(F.col("_id").alias("id"), F.coalesce("title", F.lit("")).alias("title"), text.alias("text"), line_place().alias("at"))
    last = rows.groupBy("id").agg(F.max_by(F.struct("title", "text"), "at").alias("x")).select("id", "x.title", "x.text")
    return last.withColumn("composed", compose(F.col("title"), F.col("text"), title_mode))


def compose(title: Column, text: Column, mode: str) -> Column:
    """One string of title and text: text_only, concat_space or dpr_sep."""
    t, x = strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(text, F.lit("")))
    joined = {"text_only": x, "concat_space": F.concat(t, F.lit(" "), x), "dpr_sep": F.concat(t, F.lit(" [SEP] "), x)}
    if mode not in joined:
        raise ValueError(f"unknown title mode {mode}")
    return F.when(t == "", x).otherwise(joined[mode])


def prepared(text: Column, prefix: str = "", end: str = "") -> Column:
    return F.concat(F.lit(prefix), F.coalesce(text, F.lit("")), F.lit(end))


def run_lines(hits: DataFrame, tag: str, rank: str, places: int = 6) -> DataFrame:
    """(line): `query Q0 doc rank score tag`, ranked anew from 1 by `rank`."""
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(rank))
    return hits.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), n.cast("string"), F.format_string(f"%.{places}f", "sim"), F.lit(tag)).alias("line"))


def write_run(hits: DataFrame, path: str, tag: str = "run", rank: str = "rk") -> None:
    run_lines(hits, tag, rank).write.mode("overwrite").text(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, score, rk): ranks follow the scores, not the file's own column."""
    p = spark.read.text(path).where(F.trim("value") != "").withColumn("p", split_line(F.col("value")))
    rows = p.select(F.get("p", F.lit(0)).alias("query_id"), F.get("p", F.lit(2)).alias("doc_id"), F.get("p", F.lit(4)).cast("double").alias("score"))
    return top_k(rows, ["query_id"], "score", "doc_id", 1 << 30)


TURN = "struct<role:string,content:string>"
INSTANCE = f"question_id string, question_type string, question string, question_date string, answer string, answer_session_ids array<string>, haystack_session_ids array<string>, haystack_dates array<string>, haystack_sessions array<array<{TURN}>>"


def _steps(fragment: str) -> tuple[tuple[int, int], tuple[int, int]]:
    """What a fragment of JSON, up to and with a closing brace, does to (inside a string, depth) if it begins outside a
    string, and if it begins inside one."""
    parts = ESCAPED.sub("", fragment).split('"')
    out = []
    for inside in (0, 1):
        outside = "".join(parts[inside::2])
        ends_inside = (len(parts) - 1 + inside) & 1
        out.append((ends_inside, outside.count("{") + outside.count("[") - outside.count("]") - (not ends_inside)))
    return out[0], out[1]


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """(value): the objects of files that hold a JSON array each, as text; another value than an array is an error.

    Files are split and read up to closing braces.  Whether a brace closes an object of the array depends on all that
    stands before it: each split is summed up for both cases, beginning inside a string or outside, and the sums, a row
    per split, are put together in order.  With the states at the splits' beginnings a second pass cuts objects out; of those that
    cross borders the parts are joined.
    """
    pieces = ordered_lines(spark, path, "}")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        for batch in batches:
            for at, first, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if first and not value.lstrip().startswith("["):
                    raise ValueError(f"{at['file']}: not a list")
                state = seen.setdefault((at["file"], at["block"]), [(0, 0), (1, 0)])
                steps = _steps(value)
                for i, (inside, depth) in enumerate(state):
                    state[i] = steps[inside][0], depth + steps[inside][1]
        rows = [(*k, *a, *b) for k, (a, b) in seen.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "block", "in0", "d0", "in1", "d1"])

    each = pieces.mapInArrow(sums, "file string, block long, in0 long, d0 long, in1 long, d1 long")
    begins: dict[tuple, tuple] = {}
    file, state, number = None, (0, 0), 0
    for r in each.orderBy("file", "block").toLocalIterator():  # a row per split
        if r["file"] != file:
            file, state, number = r["file"], (0, 0), 0
        begins[file, r["block"]] = *state, number
        state, number = ((r["in0"], state[1] + r["d0"]), (r["in1"], state[1] + r["d1"]))[state[0]], number + 1
    known = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole objects (part 0), and of each split what stands before the first end of one (1) and after the last one (2)."""
        key, held, ended, inside, depth, number = None, [], False, 0, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for at, value in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if (at["file"], at["block"]) != key:
                    if held:
                        out.append((key[0], number, 2 if ended else 1, False, "".join(held)))
                    key, held, ended = (at["file"], at["block"]), [], False
                    inside, depth, number = known.value[key]
                inside, step = _steps(value)[inside]
                depth += step
                held.append(value + "}")
                if not inside and depth == 1:
                    out.append((key[0], number, 0 if ended else 1, True, "".join(held)))
                    held, ended = [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["file", "split", "part", "closed", "value"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (key[0], number, 2 if ended else 1, False, "".join(held))], names=["file", "split", "part", "closed", "value"])

    rows = written(pieces.mapInArrow(cut, "file string, split long, part long, closed boolean, value string"), "objects")
    # of the rest, at most two parts a split: a part without an end goes on with the next one
    border = rows.where("part > 0")
    order = Window.partitionBy("file").orderBy("split", "part")
    number = F.coalesce(F.sum(F.col("closed").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = border.withColumn("number", number).groupBy("file", "number").agg(F.array_sort(F.collect_list(F.struct("split", "part", "value"))).alias("p"), F.max("closed").alias("closed"))
    crossing = joined.where("closed").select(F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    return rows.where("part = 0").select("value").unionByName(crossing).select(F.regexp_replace("value", r"^[\s,\[]+", "").alias("value"))


def read_instances(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of benchmark questions, each with its own sessions."""
    return json_array(spark, path).select(F.from_json("value", INSTANCE).alias("x")).select("x.*")


def write_json_array(rows: DataFrame, path: str) -> None:
    """Files that hold a JSON array each, one object a line."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            for value in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([mark + value])], names=["value"])
                mark = ","
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], names=["value"])

    rows.select(F.to_json(F.struct("*"))).mapInArrow(lines, "value string").write.mode("overwrite").text(path)


def haystack(instances: DataFrame) -> DataFrame:
    """(question_id, session_id, date, turns): a row per session; arrays of unequal length are cut to the shortest."""
    n = F.least(F.size("haystack_session_ids"), F.size("haystack_dates"), F.size("haystack_sessions"))
    zipped = F.slice(F.arrays_zip("haystack_session_ids", "haystack_dates", "haystack_sessions"), F.lit(1), n)
    each = instances.select("question_id", F.explode(zipped).alias("s"))
    return each.select("question_id", F.col("s.haystack_session_ids").alias("session_id"), F.col("s.haystack_dates").alias("date"), F.col("s.haystack_sessions").alias("turns"))


def read_done(spark: SparkSession, path: str) -> DataFrame:
    """question_id of result lines; broken lines and lines without id are skipped."""
    return spark.read.schema("question_id string").json(path).where("question_id is not null").distinct()


def fingerprint(parts: list[Column]) -> Column:
    """Sixteen hex digits of the SHA-256 of the parts, joined by a separator that no part has."""
    text = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_key(model: Column, is_query: Column, text: Column) -> Column:
    return F.sha1(F.concat_ws("|", model, is_query.cast("string"), text))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys that the cache does not have."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")
