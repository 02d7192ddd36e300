"""Documents that must not copy passages: 24-character pieces of texts, looked up in the documents' windows.

Pieces are cut from a text without its white space, lower-cased, one after another; a document copies a text if one of them
stands anywhere in it, white space and case aside.  Each key (a question, or none for all texts together) has a filter, an
array of bits of its pieces' hashes; a document's windows are tested against it in its row, and only windows that pass go
to an equality join with the pieces.  Filters have about eight bits a piece, 16,384 words at most; with more pieces more
windows pass, which costs time, not correctness.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmill.operators import slots
from vecmill.session import written

PIECE = 24  # fixed value
LEAST_WORDS, MOST_WORDS = 16, 16_384
COPIED = "a passage was copied"
Editor = Callable[[DataFrame], DataFrame]  # (query_id, round, slot, document) to the same rows with documents edited


def tight(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def pieces(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, piece), distinct. Texts under 24 characters have none."""
    rows = texts.select(*keys, tight(F.col(text)).alias("s")).where(F.length("s") >= PIECE)
    starts = F.sequence(F.lit(1), F.length("s") - PIECE + 1, F.lit(PIECE))
    return rows.select(*keys, F.explode(F.transform(starts, lambda a: F.substring(F.col("s"), a, F.lit(PIECE)))).alias("piece")).distinct()


def _place(piece: Column, words: Column) -> Column:
    return F.pmod(F.xxhash64(piece), words * 64)


def filters(found: DataFrame, keys: list[str]) -> DataFrame:
    """found: (keys, piece). A row per key that has pieces: (keys, bits array<long>); its length is a power of two."""
    sized = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / 8, F.lit(1.0)))))
    words = F.greatest(F.lit(LEAST_WORDS), F.least(F.lit(MOST_WORDS), sized)).cast("int")
    counts = found.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 0").select(*keys, words.alias("words"))
    rows = found.join(counts, keys) if keys else found.join(F.broadcast(counts), F.lit(True))
    place = _place(F.col("piece"), F.col("words"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    marked = rows.select(*keys, F.shiftright(place, 6).cast("int").alias("i"), one.alias("x"))
    empty = counts.select(*keys, F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("i"), F.lit(0).cast("long").alias("x"))
    dense = marked.unionByName(empty).groupBy(*keys, "i").agg(F.bit_or("x").alias("x"))
    return dense.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("bits")).where(F.size("bits") > 0)


def copied(documents: DataFrame, found: DataFrame, marks: DataFrame, keys: list[str], ids: list[str], text: str = "document") -> DataFrame:
    """The distinct ids of documents (ids, keys, text) that hold a piece of their key; marks: filters(found)."""
    own = list(dict.fromkeys([*ids, *keys]))
    rows = documents.select(*own, tight(F.col(text)).alias("s"))
    rows = rows.join(marks, keys) if keys else rows.join(F.broadcast(marks), F.lit(True))
    bits = F.col("bits")

    def passes(w: Column) -> Column:
        p = _place(w, F.size(bits))
        return F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1

    windows = F.filter(F.regexp_extract_all("s", F.lit(f"(?s)(?=(.{{{PIECE}}}))"), F.lit(1)), passes)
    return rows.select(*own, F.explode(windows).alias("piece")).join(found, [*keys, "piece"], "left_semi").select(*ids).distinct()


def settled(state: DataFrame, after: DataFrame, chosen: DataFrame, found: DataFrame | None = None, marks: DataFrame | None = None, keys: list[str] | None = None, edit: Editor | None = None) -> DataFrame:
    """The states that questions go on with, the slot that was to change, and broken: why a change was rolled back, or null.

    state, after: rows of (query_id, document, ...) before and after a round's change; chosen: (query_id, round, slot).
    edit may rewrite the changed documents before they are checked: by the rules of `slots.document_violation`, and, if
    pieces are given (`pieces`, `filters`), for copied passages.
    """
    if edit is not None:
        edited = edit(after.join(chosen, "query_id").select("query_id", "round", "slot", "document"))
        after = written(after.drop("document").join(edited.select("query_id", "document"), "query_id").select(*state.columns), "edited")
    old = state.select("query_id", F.struct(*state.columns).alias("old"))
    rows = after.select("query_id", F.struct(*state.columns).alias("new")).join(old, "query_id").join(chosen.select("query_id", "slot"), "query_id")
    rule = slots.document_violation(F.col("slot"), F.col("old.document"), F.col("old.document"), F.col("new.document"))
    if found is None:
        rows = rows.withColumn("broken", rule)
    else:
        copies = copied(after.select("query_id", "document"), found, marks, keys, ["query_id"]).withColumn("copies", F.lit(True))
        rows = rows.join(copies, "query_id", "left").withColumn("broken", F.coalesce(rule, F.when(F.col("copies"), COPIED)))
    return rows.select(F.when(F.col("broken").isNull(), F.col("new")).otherwise(F.col("old")).alias("s"), "slot", "broken").select("s.*", "slot", "broken")
