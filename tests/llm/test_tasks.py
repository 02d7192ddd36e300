"""The helpers that operators share."""

import numpy as np
import pyarrow as pa
import pytest

from vecmill.llm import tasks
from vecmill.session import scratch, written


@pytest.mark.parametrize("rows", [1, 5, 1000])
@pytest.mark.parametrize("size", [1, 3, 50])
def test_groups_arrive_whole(rows, size):
    rng = np.random.default_rng(rows * 100 + size)
    keys = np.sort(rng.integers(0, 12, 60))
    other = np.where(keys % 3 == 0, 0, np.sort(rng.integers(0, 3, 60)))
    order = np.lexsort((other, keys))
    table = pa.table({"k": keys[order], "o": other[order], "x": np.arange(60)})
    batches = table.to_batches(max_chunksize=size)
    parts = list(tasks.whole_groups(iter([batches[0].slice(0, 0), *batches]), 2, rows))
    assert pa.concat_tables(parts).equals(table)
    seen = set()
    for p in parts:
        groups = set(zip(p["k"].to_pylist(), p["o"].to_pylist(), strict=True))
        assert not groups & seen and p.num_rows
        seen |= groups
    assert list(tasks.whole_groups(iter([]), 1)) == []


@pytest.mark.parametrize("total", [1, 10_000_000])
def test_join_with_frequent_keys(spark, monkeypatch, total):
    monkeypatch.setattr(tasks, "HOT_KEYS", 10)
    rows = spark.createDataFrame([(i % 7 if i % 2 else 3, i) for i in range(100)] + [(None, 1)], "k long, x long")
    keys = rows.where("k is not null and k <> 5").groupBy("k").count().withColumnRenamed("count", "c")
    got = sorted(map(tuple, tasks.met(rows, keys, ["k"], total).select("k", "x", "c").collect()))
    assert got == sorted(map(tuple, rows.join(keys, "k").select("k", "x", "c").collect()))


def test_columns_to_keep():
    assert tasks.checked(["doc_id", "x"], ["y"]) == ["doc_id", "x"]
    with pytest.raises(ValueError):
        tasks.checked(["doc_id", "Kept"], ["kept"])


def test_scratch_tables_go(spark):
    with scratch(spark) as keep:
        df = keep(spark.range(5), "gone")
        out = written(df.where("id > 2"), "stays")
        path = df.inputFiles()[0]
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs) and out.count() == 2
