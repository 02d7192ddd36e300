"""Helpers shared by operators: complete groups inside a task, columns carried along, and joins with very frequent keys."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


HOT_KEYS = 2000


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 1024) -> Iterator[pa.Table]:
    """Rows that arrive sorted by their first `keys` columns, as tables of complete groups, of no more than about `rows`
    rows where groups allow it."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        starts = group_starts(columns)
        if held and all(held[-1].column(i)[-1].as_py() == c[0] for i, c in enumerate(columns)):
            starts = starts[1:]  # the batch goes on with the group before
        at = 0
        for border in starts.tolist():
            if n + border - at >= rows:
                yield pa.Table.from_batches([*held, batch.slice(at, border - at)])
                held, n, at = [], 0, border
        if at < batch.num_rows:
            held.append(batch.slice(at))
            n += batch.num_rows - at
    if held:
        yield pa.Table.from_batches(held)


def fitted(sample: DataFrame, fit: Callable[[Iterator[pa.RecordBatch]], object]) -> object:
    """What fit makes of all rows of a bounded sample. One task fits; the driver, which has the least memory, gets the model only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(batches))], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first()["model"])


def group_starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where groups of equal neighbours begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def met(rows: DataFrame, keys: DataFrame, on: list[str], total: int, count: str = "c") -> DataFrame:
    """rows joined with keys, a table with a row per key and how many rows it has (`count`), of `total` rows.

    Keys of more than total / HOT_KEYS rows, at most HOT_KEYS of them, are broadcast, so none makes a large task.
    """
    hot = keys.where(F.col(count) > total / HOT_KEYS)
    names = F.broadcast(hot.select(*on))
    cold = rows.join(names, on, "left_anti").join(keys.where(F.col(count) <= total / HOT_KEYS), on)
    return cold.unionByName(rows.join(F.broadcast(hot), on))


def checked(keep: list[str], made: list[str]) -> list[str]:
    """Columns to carry along; none may have the name of one that the operator makes."""
    clash = {c.lower() for c in keep} & {c.lower() for c in made}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are made here: carry them inside a struct")
    return keep


def text_last(keep: list[str]) -> tuple[list[Column], int]:
    """The columns to hand to a task, with the text among them once, and which of them it is."""
    kept = [F.col(f"`{c}`") for c in keep]
    return (kept, keep.index("text")) if "text" in keep else ([*kept, F.col("text").alias("__text")], len(keep))


def with_columns(df: DataFrame, keep: list[str], made: str) -> StructType:
    """The schema of the columns in `keep`, followed by those of a DDL string."""
    return StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(made).fields])
