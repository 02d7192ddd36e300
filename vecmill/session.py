"""Session helpers shared by every query of the package."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()  # applications that have the package


def _zipped() -> bytes:
    """The package's modules as a zip file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join(os.path.basename(PACKAGE), os.path.relpath(path, PACKAGE)))
    return out.getvalue()


def prepare(spark: SparkSession) -> SparkSession:
    """Ship this package to the executors, once per application, through Spark's own file server.

    Where the session has Spark's own limit for batches to Python, 64 MB, it becomes 4 MB: rows are whole texts, and
    workers hold some copies.
    """
    if spark.conf.get(BATCH_BYTES, "64m") in ("64m", "67108864", "67108864b"):
        spark.conf.set(BATCH_BYTES, "4m")
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        folder = os.path.join(SparkFiles.getRootDirectory(), f"vecmill-{uuid.uuid4().hex[:8]}")  # served until the session ends
        os.makedirs(folder)
        path = os.path.join(folder, "vecmill.zip")
        with open(path, "wb") as f:
            f.write(_zipped())
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster, spark.checkpoint.dir; a machine's own folder would be lost with the machine."""
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/vecmill-checkpoints"  # one machine, one process
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """A table as of `written`, and its path."""
    path = scratch_path(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: columns stay prunable and rows stay fixed."""
    return written_at(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of this package from the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator:
    """A function like `written` whose tables are deleted at the end of the block; what outlives it has to be written itself."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        table_, path = written_at(df, name)
        paths.append(path)
        return table_

    try:
        yield keep
    finally:
        for path in paths:
            removed(spark, path)


SPREAD_BYTES = 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of files that has fewer splits than the session has cores, dealt out to all of them.

    Small files and tables of many splits stay as they are, and so do filters and columns, which go through to the scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size >= SPREAD_BYTES and df._jdf.rdd().getNumPartitions() < cores else df


PART_BYTES = 8 << 20


def dealt(df: DataFrame) -> int:
    """In how many parts a table of files has to be dealt so that each has about 8 MB of what the files hold, whatever the
    session's number of partitions; parts that Spark merges by their compressed size may be many times as large in memory."""
    return max(1, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet"))
