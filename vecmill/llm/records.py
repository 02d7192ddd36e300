"""Token ids as length-delimited binary records with an offset index (operator 11).

Method. Each document's ids are one record: its payload's length (8 bytes), a masked checksum of the length (4 bytes),
the payload, a masked checksum of the payload (4 bytes), all little-endian.  The checksum is CRC-32C, masked by a
rotation and a constant, so that readers of this common framing can read the files.  The payload is the plain ids, of 2
bytes each if the vocabulary allows it, else of 4.  Beside the record files a Parquet table, the index, tells for each
document its file, its place there and its byte offset; any rows of it, in any order, can be handed to `read_records`,
which seeks, reads neighbours at once, and refuses records whose length or checksums do not hold.

Scale. One shuffle: texts are dealt by ranges of doc_id and sorted within them, and each task writes one file, so file
order and place follow doc_id.  The ids that stand before a document are those of the files before (a sum per file) and
those before it in its file, which follow from its offset.  A task that runs again writes a file of another name; the index
names only files of tasks that Spark has committed, others are deleted.  Files are written and read through Arrow's file
systems (local paths, hdfs and object stores by URI), never through a folder of one machine.

Edge cases. A null or empty text is the end mark alone.  Rows without doc_id come first, rows of one doc_id are
ordered by a hash of their text, equal rows are a record each; however many they are, they are split among files.  Texts
may be of any length.  An empty table has no files and an empty index.  Other columns are not looked at.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecmill.llm.packing import tokenizer
from vecmill.session import prepare, removed, shared_dir, table

AROUND = 16  # bytes of a record besides its payload
READ_BYTES = 4 << 20
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8  # fixed values of the format: CRC-32C, reflected, and its mask
BLOCK = 64


def _zero_byte(crc: np.ndarray, of_byte: np.ndarray) -> np.ndarray:
    """The checksums after one further zero byte."""
    return (crc >> np.uint32(8)) ^ of_byte[crc & np.uint32(255)]


def _moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    return by[0][crc & 255] ^ by[1][crc >> 8 & 255] ^ by[2][crc >> 16 & 255] ^ by[3][crc >> 24]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Checksum (without start value) of a byte; of a byte at each place of a block; and what zero bytes, BLOCK times a
    power of two of them, make of each byte of a checksum."""
    of_byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        of_byte = np.where(of_byte & 1, of_byte >> 1 ^ np.uint32(POLYNOMIAL), of_byte >> 1).astype(np.uint32)
    places = [of_byte]
    for _ in range(BLOCK - 1):
        places.append(_zero_byte(places[-1], of_byte))
    by = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for _ in range(BLOCK):
        by = _zero_byte(by, of_byte)
    powers = [by]
    for _ in range(40):
        powers.append(_moved(powers[-1], powers[-1]))
    return of_byte, np.stack(places[::-1]), powers


def checksums(parts: list[bytes | memoryview]) -> np.ndarray:
    """Masked CRC-32C of each byte string.

    A checksum without start value is linear: those of blocks are found by table and joined in pairs, all strings together.
    """
    of_byte, places, powers = _tables()
    sizes = np.array([len(p) for p in parts], np.int64)
    counts = np.maximum(1, -(-sizes // BLOCK))
    ends = np.cumsum(counts) * BLOCK
    padded = np.zeros(int(counts.sum()) * BLOCK, np.uint8)  # zeros before a string change nothing
    for p, size, end in zip(parts, sizes.tolist(), ends.tolist(), strict=True):
        padded[end - size : end] = np.frombuffer(p, np.uint8)
    long = ends[sizes >= 4] - sizes[sizes >= 4]
    padded[(long[:, None] + np.arange(4)).ravel()] ^= 255  # the start value
    crc = np.bitwise_xor.reduce(places[np.arange(BLOCK), padded.reshape(-1, BLOCK)], axis=1)
    level = 0
    while len(crc) > len(parts):
        odd = counts & 1
        even = np.zeros(int((counts + odd).sum()), np.uint32)
        even[np.arange(len(crc)) + np.repeat(np.cumsum(odd), counts)] = crc
        crc = _moved(even[::2], powers[level]) ^ even[1::2]
        counts, level = (counts + odd) // 2, level + 1
    for i in np.flatnonzero(sizes < 4).tolist():
        x = np.array([0xFFFFFFFF], np.uint32)
        for byte in bytes(parts[i]):
            x = (x >> np.uint32(8)) ^ of_byte[(x ^ np.uint32(byte)) & np.uint32(255)]
        crc[i] = x[0]
    crc = ~crc
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK)


def id_size(vocab_path: str, end_id: int) -> int:
    """Bytes of an id: 2 if all ids of the vocabulary fit, else 4."""
    spec = json.load(open(vocab_path, encoding="utf-8"))
    most = max(end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec["added_tokens"]))
    return 2 if most < 1 << 16 else 4


def write_records(docs: DataFrame, vocab_path: str, path: str, end_id: int = 2) -> DataFrame:
    """Writes path/records/*.rec and path/index in ascending doc_id order, and returns the index as read again:
    doc_id, part (files in order), file, place (of the record in its file), offset, size (bytes of its ids), id_bytes."""
    spark = prepare(docs.sparkSession)
    width, folder = id_size(vocab_path, end_id), f"{path}/records"
    code = {2: "H", 4: "I"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocab_path)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        file, out, offset, place = f"{part:07d}-{uuid.uuid4().hex}.rec", None, 0, 0
        try:
            for batch in batches:
                texts, at = batch.column(1), 0
                while at < len(texts):
                    payloads, held, begin = [], 0, at
                    while at < len(texts) and held < READ_BYTES:
                        ids = array(code, encode(texts[at].as_py() or ""))
                        ids.append(end_id)
                        payloads.append(ids.tobytes())
                        held, at = held + len(payloads[-1]), at + 1
                    sizes = np.array([len(p) for p in payloads], np.int64)
                    heads = [struct.pack("<Q", n) for n in sizes.tolist()]
                    framed = zip(heads, checksums(heads).astype("<u4"), payloads, checksums(payloads).astype("<u4"), strict=True)
                    if out is None:
                        store, root = fs.FileSystem.from_uri(folder)
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(f"{root}/{file}")
                    out.write(b"".join(x for h, hc, p, pc in framed for x in (h, hc.tobytes(), p, pc.tobytes())))
                    ends = offset + np.cumsum(sizes + AROUND)
                    n = at - begin
                    cols = [pa.array(np.full(n, part, np.int32)), pa.array([file] * n, pa.string()), pa.array(place + np.arange(n)), pa.array(ends - sizes - AROUND), pa.array(sizes), pa.array(np.full(n, width, np.int32))]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, n), *cols], names=["doc_id", "part", "file", "place", "offset", "size", "id_bytes"])
                    offset, place = int(ends[-1]), place + n
        finally:
            if out is not None:
                out.close()

    keys = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("at")]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"))
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part int, file string, place long, offset long, size long, id_bytes int"
    dealt.mapInArrow(run, schema).write.parquet(f"{path}/index")
    index = read_index(spark, path, schema)
    _clean(spark, folder, index)
    return index


def read_index(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(f"{path}/index")


def _clean(spark: SparkSession, folder: str, index: DataFrame) -> None:
    """Deletes files of tasks that were lost or ran twice: those that the index does not name."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at):
        named = {r["file"] for r in index.select("file").distinct().toLocalIterator()}  # one for each task
        for status in files.listStatus(at):
            if status.getPath().getName() not in named:
                removed(spark, status.getPath().toString())


def read_records(index: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """The rows of an index, as they are and in the order of each task, with n_tokens and ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers) of the records they name; with keep_ids also ids in that form.

    A record whose length or checksums do not hold is an error.
    """
    folder, columns = f"{path}/records", index.columns
    places = [columns.index(c) for c in ("file", "offset", "size", "id_bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        file, held = None, None
        try:
            for batch in batches:
                names = batch.column(places[0]).to_pylist()
                offset, size, width = (batch.column(i).to_numpy() for i in places[1:])
                n_tokens, crcs, ids = size // np.maximum(width, 1), np.zeros(len(size), np.int64), []
                at = 0
                while at < len(names):
                    end = at + 1
                    while end < len(names) and names[end] == names[at] and offset[end] == offset[end - 1] + size[end - 1] + AROUND and offset[end] - offset[at] < READ_BYTES:
                        end += 1
                    if names[at] != held:
                        if file is not None:
                            file.close()
                        file, held = store.open_input_file(f"{root}/{names[at]}"), names[at]
                    file.seek(int(offset[at]))
                    got = memoryview(file.read(int(offset[end - 1] + size[end - 1] + AROUND - offset[at])))
                    begin = (offset[at:end] - offset[at]).tolist()
                    heads = [got[b : b + 8] for b in begin]
                    payloads = [got[b + 12 : b + 12 + n] for b, n in zip(begin, size[at:end].tolist(), strict=True)]
                    said = [(got[b + 8 : b + 12], got[b + 12 + n : b + 16 + n]) for b, n in zip(begin, size[at:end].tolist(), strict=True)]
                    for i, (h, p, (hs, ps), hc, pc) in enumerate(zip(heads, payloads, said, checksums(heads).tolist(), checksums(payloads).tolist(), strict=True), at):
                        if struct.pack("<QI", size[i], hc) != bytes(h) + bytes(hs) or struct.pack("<I", pc) != bytes(ps):
                            raise ValueError(f"{held}: the record at byte {offset[i]} is damaged")
                        raw = bytes(p) if width[i] == 4 else np.frombuffer(p, "<u2").astype("<u4").tobytes()
                        crcs[i] = zlib.crc32(raw)
                        if keep_ids:
                            ids.append(raw)
                    at = end
                cols = [*batch.columns, pa.array(n_tokens), pa.array(crcs)] + [pa.array(ids, pa.binary())] * keep_ids
                yield pa.RecordBatch.from_arrays(cols, names=[*columns, "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)
        finally:
            if file is not None:
                file.close()

    prepare(index.sparkSession)
    schema = ", ".join(f"`{c}` {index.schema[c].dataType.simpleString()}" for c in columns)
    return index.mapInArrow(run, f"{schema}, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """records with start: how many ids stand before them, in all files in order."""
    ids = F.col("size") / F.col("id_bytes")
    files = index.groupBy("part").agg(F.sum(ids).cast("long").alias("n"))  # a row per file
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    here = ((F.col("offset") - AROUND * F.col("place")) / F.col("id_bytes")).cast("long")
    return records.join(files, "part").withColumn("start", F.col("before") + here).drop("before")


def op11_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for every document, from the files."""
    import public_tokenizers

    path = f"{shared_dir(prepare(spark))}/records-{uuid.uuid4().hex}"
    index = write_records(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return with_starts(read_records(index, path), index).select("doc_id", "start", "n_tokens", "ids_crc32")
