"""Scans of whole texts in Arrow batches: windows whose hash is wanted, and patterns in linear time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

LEAK_BITS = 20  # of a hash: 128 KB of bits


def _window_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, where each text begins and ends in them, and the hash of the 24 from each one on."""
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, points)])
    h = np.concatenate([*points, np.zeros(24, np.uint32)]).astype(np.uint64)
    codes, mixed = h[:-24], lambda a, b: (a * np.uint64(0x9E3779B97F4A7C15)) ^ ((b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F))
    at = lambda x, n: np.concatenate([x[n:], np.zeros(n, np.uint64)])
    eight = h
    for n in (1, 2, 4):
        eight = mixed(eight, at(eight, n))
    place = mixed(mixed(eight, at(eight, 8)), at(eight, 16))[:-24] >> np.uint64(64 - LEAK_BITS)
    return codes, ends, place.astype(np.int64)


def leak_bits(pieces, column):
    """A broadcast array of bytes, a bit for each hash that a piece has; at most 1 << LEAK_BITS rows reach the driver."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                _, ends, place = _window_places(batch.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(place[ends[:-1]]))], names=["p"])

    bits = np.zeros(1 << LEAK_BITS, bool)
    bits[pieces.select(column).mapInArrow(run, "p long").distinct().toArrow()["p"].to_numpy()] = True
    return pieces.sparkSession.sparkContext.broadcast(np.packbits(bits))


def marked_windows(texts, key, bits):
    """(key, piece): the windows of texts (key, s), of 24 characters at least, whose hash has its bit."""
    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                codes, ends, place = _window_places(part.column(1))
                hit = np.flatnonzero((bits.value[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1)
                row = np.searchsorted(ends, hit, "right") - 1
                within = hit + 24 <= ends[row + 1]
                found = [codes[i : i + 24].astype("<u4").tobytes().decode("utf-32-le") for i in hit[within]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row[within])), pa.array(found, pa.string())], names=[key, "piece"])

    return texts.select(key, "s").mapInArrow(run, f"{key} {texts.schema[key].dataType.simpleString()}, piece string")


def matched(texts: DataFrame, key: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """(key, a boolean for each pattern (column, expression)): whether it occurs in the column, by an automaton that reads
    a text once; null where the column is null."""
    columns = sorted({c for c, _ in patterns.values()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pc.match_substring_regex(batch.column(1 + columns.index(c)), p) for c, p in patterns.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=[key, *patterns])

    return texts.select(key, *columns).mapInArrow(run, ", ".join([f"{key} {texts.schema[key].dataType.simpleString()}", *[f"{n} boolean" for n in patterns]]))
