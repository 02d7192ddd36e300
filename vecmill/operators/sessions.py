"""Conversations as documents: session text, windows of turns, reader input, and a hashing text encoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecmill.functions import text as T
from vecmill.functions import vectors as V

WINDOW_TURNS, WINDOW_OVERLAP, WINDOW_CHARS = 8, 2, 1600
HISTORY_CHARS = 6000
ROWS = 4096


def turn_lines(turns: Column) -> Column:
    """`role: content` for each turn of array<struct<role, content>>; the role is user where it is missing."""
    return F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("user")), F.lit(": "), T.strip(F.coalesce(t["content"], F.lit("")))))


def session_text(date: Column, turns: Column) -> Column:
    head = F.concat(F.lit("[session date: "), F.coalesce(date, F.lit("")), F.lit("]"))
    return F.array_join(F.concat(F.array(head), turn_lines(turns)), "\n")


def sessions_of(turns: DataFrame, session: str, order: str) -> DataFrame:
    """(session, turns array<struct<role, content>>) from a row per turn. A session's turns are one conversation's."""
    each = turns.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "role", F.col("text").alias("content")))).alias("t"))
    return each.select(session, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("turns"))


def turn_windows(sessions: DataFrame, session: str, size: int = WINDOW_TURNS, overlap: int = WINDOW_OVERLAP, chars: int = WINDOW_CHARS) -> DataFrame:
    """A row per window of turns: (session, chunk_id, text). Only sessions that are long in characters and turns are cut;
    the last window is the first that reaches the end; an uncut session keeps its own id."""
    step = max(1, size - overlap)
    n = F.size("turns")
    whole = session_text(F.col("date"), F.col("turns"))
    short = (F.length(whole) <= chars) | (n <= size)
    count = F.when(short, F.lit(1)).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    each = sessions.withColumn("__n", count).withColumn("__j", F.explode(F.sequence(F.lit(0), count - 1)))
    part = F.when(F.col("__n") == 1, F.col("turns")).otherwise(F.slice("turns", F.col("__j") * step + 1, F.lit(size)))
    sid = F.col(session).cast("string")
    return each.select(session, F.when(F.col("__n") == 1, sid).otherwise(F.concat(sid, F.lit("::c"), F.col("__j").cast("string"))).alias("chunk_id"), session_text(F.col("date"), part).alias("text"))


def session_of(session_id: Column, chunk_id: Column) -> Column:
    """The session of a hit; where it is missing, the chunk's id up to its window mark."""
    return F.when(F.coalesce(session_id, F.lit("")) != "", session_id).otherwise(F.element_at(F.split(chunk_id, "::c"), 1))


def reader_order(hits: DataFrame, by_time: Column) -> DataFrame:
    """Place of each hit in the reader's input: by rank, or oldest first with undated last where by_time holds."""
    w = Window.partitionBy("query_id").orderBy(F.when(by_time, F.col("time_days").isNull().cast("int")), F.when(by_time, F.col("time_days")).asc_nulls_last(), "rk")
    return hits.withColumn("place", F.row_number().over(w))


def history_entry(place: Column, session_id: Column, score: Column, date: Column, turns: Column, most: int = HISTORY_CHARS) -> Column:
    """One session as the reader sees it; turns without content are left out, a long body is cut and marked."""
    said = F.filter(turns, lambda t: T.strip(F.coalesce(t["content"], F.lit(""))) != "")
    body = F.array_join(turn_lines(said), "\n")
    body = F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("\n[truncated]"))).otherwise(body)
    return F.concat(F.format_string("\n### Session %d (session_id=%s, score=%.4f)\nSession Date: %s\nSession Content:\n", place, session_id, score, date), body, F.lit("\n"))


def hashed_vectors(texts: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """(key, e): terms hashed into signed buckets, of unit length; a stand-in for a trained encoder."""
    def coded(t: Column) -> Column:
        h = F.md5(t)
        bucket = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim
        return (bucket * 2 + F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                row, codes = pa.compute.list_parent_indices(part.column(1)).to_numpy(), part.column(1).flatten().to_numpy()
                sums = np.bincount(row * dim + codes // 2, 1.0 - 2.0 * (codes % 2), minlength=part.num_rows * dim)
                offsets = pa.array(np.arange(0, len(sums) + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(sums, pa.float64()))], names=["k", "v"])

    # terms are counted within their row, so that one vector a text is shuffled and added, not a row a term
    codes = texts.select(F.col(key).alias("k"), F.transform(T.ordered_terms(F.col(text)), coded).alias("c"))
    each = codes.mapInArrow(run, f"k {texts.schema[key].dataType.simpleString()}, v array<double>")
    sums = each.groupBy(F.col("k").alias(key)).agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(dim)]).alias("v"))
    return sums.select(key, V.unit(F.col("v")).alias("e"))
