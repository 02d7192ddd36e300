"""A table of computed values by key, which runs share: what is there is read, what is missing is computed and added."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.sources.experiments import exists

PREFIX = 2  # hex digits of a key that name its partition: of 256, a lookup of a few keys reads a few


def stored(wanted: DataFrame, path: str, kind: str, prefix: int = PREFIX) -> DataFrame:
    """(key, value) of the cached keys among wanted (key string, in hex, evenly spread); kind is the type of a value.
    prefix is one for all that is done with a table.

    Two runs that work at once may both add a key. Of its values the first run's counts, in every later read.
    """
    spark = wanted.sparkSession
    keys = wanted.where("key is not null").select("key").distinct().withColumn("part", F.substring("key", 1, prefix))
    if not exists(spark, path):
        return keys.select("key", F.lit(None).cast(kind).alias("value")).where(F.lit(False))
    rows = spark.read.schema(f"key string, value {kind}, run string, part string").parquet(path)
    return rows.join(keys, ["part", "key"], "left_semi").groupBy("key").agg(F.min_by("value", "run").alias("value"))


def get_or_compute(wanted: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], kind: str = "array<double>", prefix: int = PREFIX) -> DataFrame:
    """(key, value) of every distinct key of wanted (key, ...).

    compute gets one row of wanted for each key that the table does not have, and returns (key, value).  Its rows are added
    by one append; a run that dies meanwhile leaves whole rows or none, and what is there is found when it is repeated.
    Keys that compute leaves out are not in the result.
    """
    once = wanted.where("key is not null").dropDuplicates(["key"])
    made = compute(once.join(stored(wanted, path, kind, prefix).select("key"), "key", "left_anti"))
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
    rows = made.select("key", F.col("value").cast(kind).alias("value"), F.lit(run).alias("run"), F.substring("key", 1, prefix).alias("part"))
    rows.repartition("part").sortWithinPartitions("part", "key").write.mode("append").partitionBy("part").parquet(path)
    return stored(wanted, path, kind, prefix)
