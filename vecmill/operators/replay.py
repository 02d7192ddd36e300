"""Calls of a model as data: prompts are rows, answers a table that is kept; a run replays them and says what is still open.

Whoever has a model works off the open prompts and appends (key, answer); the next run finds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def call_key(model: Column, prompt: Column) -> Column:
    """What a call is known by: the SHA-256 of model and prompt. Null without a prompt: nothing is asked then."""
    return F.sha2(F.concat(model, F.lit("\x1f"), prompt), 256)


def answered(calls: DataFrame, answers: DataFrame) -> DataFrame:
    """calls (call_key, ...) with the column answer, null where there is none; rows are neither lost nor repeated.

    answers: (call_key, answer). Of several answers to one call the smallest counts, so that a replay gives the same each time.
    """
    once = answers.where("call_key is not null and answer is not null").groupBy("call_key").agg(F.min("answer").alias("answer"))
    return calls.join(once, "call_key", "left")


def unanswered(calls: DataFrame) -> DataFrame:
    """(call_key, prompt): each open call once."""
    return calls.where("answer is null and call_key is not null").groupBy("call_key").agg(F.first("prompt").alias("prompt"))
