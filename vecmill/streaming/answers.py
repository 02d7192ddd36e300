"""Questions of a stream answered once each, in two sets of files that agree: results, and what a judge reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def answer_stream(questions: DataFrame, answer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, asked: str | None = None, late: str = "1 day", after: Callable[[str, int], None] | None = None) -> StreamingQuery:
    """questions: a stream of (question_id, ...); answer makes of a batch (question_id, hypothesis, ...).

    A question that comes again is known by its id, which the stream's state keeps: for `late` behind the newest one if `asked` names
    the column of its time, else for good.  A batch writes a folder of its own number in each set, in place of what a try
    before it has left there; Spark repeats an unfinished batch with the same number and rows, so a run that is killed
    anywhere leaves each question once in both sets.  `after` is called with a set's name and the batch's number once that is written.
    """
    keyed = questions.withWatermark(asked, late).dropDuplicatesWithinWatermark(["question_id"]) if asked else questions.dropDuplicates(["question_id"])

    def step(batch: DataFrame, number: int) -> None:
        found = answer(batch).persist()
        try:
            for name, rows in (("results", found), ("hypotheses", found.where("hypothesis <> ''").select("question_id", "hypothesis"))):
                rows.write.mode("overwrite").json(f"{out}/{name}/batch={number}")
                if after:
                    after(name, number)
        finally:
            found.unpersist()

    return keyed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_answers(spark: SparkSession, out: str, name: str, schema: str) -> DataFrame:
    """The rows of one set, with the number of their batch."""
    return spark.read.schema(f"{schema}, batch long").json(f"{out}/{name}").where(F.col("batch").isNotNull())
