"""Retrieval over a stream of questions, batch by batch, that can stop and go on.

Ranking windows need all rows of a question, which a stream never has; each micro-batch is therefore an ordinary
batch query.  What was done is known from the results themselves, so a batch that is repeated after a failure adds
nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecmill.operators import search
from vecmill.operators.analytics import remaining


def search_stream(questions: DataFrame, corpus: DataFrame, out: str, checkpoint: str, k: int = 10, then: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """questions: a stream of (query_id, q array<double>), ids of any type. Appends (query_id, doc_id, sim, rk) to a Parquet table at `out`."""
    spark = questions.sparkSession
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(questions, 'query_id')}, doc_id {kind(corpus, 'doc_id')}, sim double, rk int"

    def step(batch: DataFrame, number: int) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(out)
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        new = batch.dropDuplicates(["query_id"])
        if there:
            new = remaining(new, spark.read.schema(schema).parquet(out), "query_id")
        found = search.exact_search(new, corpus, k).select("query_id", "doc_id", "sim", "rk")
        (then(found) if then else found).write.mode("append").parquet(out)

    return questions.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means per type and tumbling window; rows later than the watermark are left out by the stream."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")
