"""Best-fit packing of token sequences (operator 2).

Method. Minimum bin slack: the largest remaining piece opens a bin, a bitset dynamic programme over the lengths
still available finds the fullest combination that fits beside it, and that combination leaves the stock, as
often in a row as the stock allows.  Pieces of one length are interchangeable, so the programme needs only how
many there are of each length: at most `capacity` counts, whatever the size of the corpus.  These counts are all
that reaches the driver.

Scale. Tokenising and cutting is one pass without a shuffle; its narrow rows are written once, numbered by
(length, task) and placed by looking a number up in the plan.  A length that most pieces share is no hot key:
pieces are numbered inside the task that cut them, and only one count per task and length is shuffled.

Edge cases. A null or empty text is the end mark alone.  Repeated rows are packed each.  An empty table gives no
rows.  doc_id may be null or repeated; it is carried, never used as a key.  Texts may be of any length: only what is longer
than a sequence is cut.  Pieces of one length are interchangeable, so ties do not matter.  Other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.llm.bpe import byte_alphabet
from vecmill.session import prepare, table, written

OUT_ROWS = 20_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """A function from text to ids of a byte-level vocabulary file; strings of special tokens are these tokens."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    back = {c: b for b, c in byte_alphabet().items()}
    vocab = spec["model"]["vocab"]
    order = [vocab[a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
    if order != sorted(order):
        raise ValueError("ids of merged tokens must follow the order of the merges")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in s): i for s, i in vocab.items() if s not in special}
    plain = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    marks = re.compile("|".join(map(re.escape, special)) or r"(?!)")

    def encode(text: str) -> list[int]:
        if not marks.search(text):
            return plain(text)
        out, at = [], 0
        for m in marks.finditer(text):
            out += [*plain(text[at : m.start()]), special[m[0]]]
            at = m.end()
        return out + plain(text[at:])

    return encode


def cut_pieces(docs: DataFrame, vocab_path: str, capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """One row per piece, with its number among the pieces of its length in the task that made it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocab_path)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows: list[tuple] = []
            for i in range(len(texts)):
                ids = array("I", encode(texts[i].as_py() or ""))
                ids.append(end_id)
                n, start = len(ids), 0
                size = n % capacity or capacity
                piece = 0
                while start < n:
                    raw = ids[start : start + size].tobytes()
                    rows.append((i, piece, start, size, zlib.crc32(raw), seen[size], raw if keep_ids else None))
                    seen[size] += 1
                    start, size, piece = start + size, capacity, piece + 1
                if len(rows) >= OUT_ROWS or i + 1 == len(texts):
                    at, p, s, n_, c, k, raws = zip(*rows, strict=True)
                    cols = [keys.take(pa.array(at, pa.int64())), pa.array(p, pa.int32()), pa.array(s, pa.int64()), pa.array(n_, pa.int64()), pa.array(c, pa.int64()), pa.array(np.full(len(p), part, np.int32)), pa.array(k, pa.int64())]
                    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"]
                    yield pa.RecordBatch.from_arrays(cols + [pa.array(raws, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)
                    rows = []

    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, place long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fullest(stock: dict[int, int], room: int) -> list[int]:
    """Lengths, with repeats, of the fullest combination from the stock that fits into room; larger ones first."""
    chunks: list[tuple[int, int]] = []  # (length, how many of it at once), so that sums of chunks are all multiples
    steps = [1]
    reach, mask, full = 1, (1 << (room + 1)) - 1, 1 << room
    for length in sorted((x for x in stock if 0 < x <= room), reverse=True):
        left, k = min(stock[length], room // length), 1
        while left:
            k = min(k, left)
            reach |= (reach << (length * k)) & mask
            chunks.append((length, k))
            steps.append(reach)
            left, k = left - k, 2 * k
            if reach & full:
                break
        if reach & full:
            break
    at = reach.bit_length() - 1
    out: list[int] = []
    for (length, k), before in zip(reversed(chunks), reversed(steps[:-1]), strict=True):
        if not (before >> at) & 1:
            out += [length] * k
            at -= length * k
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, how many such bins), by minimum bin slack."""
    stock = {length: n for length, n in counts.items() if n}
    plan = []
    while stock:
        first = max(stock)
        rest = dict(stock)
        rest[first] -= 1
        bin_ = [first, *fullest({k: v for k, v in rest.items() if v}, capacity - first)]
        need = {x: bin_.count(x) for x in set(bin_)}
        times = min(stock[x] // n for x, n in need.items())
        for x, n in need.items():
            stock[x] -= n * times
            if not stock[x]:
                del stock[x]
        plan.append((bin_, times))
    return plan


def lookup(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first numbers of its runs, the sequence of a run's first piece, the offset in the sequence."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for bin_, times in plan:
        offset = 0
        for length in bin_:
            runs.setdefault(length, []).append((used.get(length, 0), base, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        base += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def pack(docs: DataFrame, vocab_path: str, capacity: int = 1024, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """The operator: pieces with sequence_id and offset; with keep_ids also the piece's ids (binary, uint32)."""
    pieces = written(cut_pieces(docs, vocab_path, capacity, end_id, keep_ids), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = lookup(plan_bins(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_task.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    carried = [c for c in pieces.columns if c not in ("part", "place")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            number = batch.column(batch.schema.get_field_index("number")).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length):
                here = np.flatnonzero(length == x)
                first, base, at = places[int(x)]
                run = np.searchsorted(first, number[here], "right") - 1
                sequence[here] = base[run] + number[here] - first[run]
                offset[here] = at[run]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=[*carried, "sequence_id", "offset"])

    numbered = pieces.join(starts, ["length", "part"]).select(*carried, (F.col("place") + F.col("before")).alias("number"))
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in carried) + ", sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
