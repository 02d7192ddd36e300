"""What an experiment reads and leaves: settings, a dataset of three files, vectors with their contract, results, metrics."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.operators import metrics
from vecmill.sources import files


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_settings(spark: SparkSession, path: str) -> dict[str, Any]:
    """A settings file, JSON or YAML (where that library is there), as a dictionary; anything but a mapping is an error.

    Settings are a page of text for the driver; `settings_rows` makes a table of them.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    try:
        found = json.loads(text)
    except json.JSONDecodeError:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict):
        raise ValueError(f"settings are not a mapping: {path}")
    return found


def settings_rows(spark: SparkSession, settings: dict[str, Any]) -> DataFrame:
    """(key, value): dotted keys and JSON values of nested settings."""

    def flat(x: Any, at: str) -> list[tuple[str, str]]:
        if isinstance(x, dict) and x:
            return [r for k, v in x.items() for r in flat(v, f"{at}.{k}" if at else str(k))]
        return [(at, json.dumps(x, ensure_ascii=False, default=str))]

    return spark.createDataFrame(flat(settings, ""), "key string, value string")


def load_dataset(spark: SparkSession, corpus: str, queries: str, qrels: str, title_mode: str = "concat_space") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus (doc_id, text), queries (query_id, text) and judgements (query_id, doc_id, rel); a missing file is an error."""
    absent = [p for p in (corpus, queries, qrels) if not exists(spark, p)]
    if absent:
        raise FileNotFoundError(f"no such input: {', '.join(absent)}")
    docs = files.read_texts(spark, corpus, title_mode).select(F.col("id").alias("doc_id"), F.col("composed").alias("text"))
    asked = files.read_texts(spark, queries, "text_only").select(F.col("id").alias("query_id"), F.col("composed").alias("text"))
    return docs, asked, files.read_qrels(spark, qrels)


def contract_print(contract: dict[str, Any]) -> str:
    """Sixteen hex digits that name a contract: the SHA-256 of its JSON with sorted keys."""
    import hashlib

    return hashlib.sha256(json.dumps(contract, sort_keys=True, ensure_ascii=False, default=str).encode("utf-8")).hexdigest()[:16]


def write_vectors(vectors: DataFrame, path: str, contract: dict[str, Any]) -> None:
    """Vectors with their ids, and beside them the contract that they were made under."""
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    meta = vectors.sparkSession.createDataFrame([(contract_print(contract), json.dumps(contract, sort_keys=True, ensure_ascii=False, default=str))], "fingerprint string, contract string")
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def read_vectors(spark: SparkSession, path: str, contract: dict[str, Any]) -> DataFrame:
    """The vectors, if they were made under this contract; others are stale, an error."""
    if not exists(spark, f"{path}/meta"):
        raise FileNotFoundError(f"vectors without a contract: {path}")
    found = spark.read.schema("fingerprint string").json(f"{path}/meta").first()
    if found is None or found[0] != contract_print(contract):
        raise ValueError(f"vectors at {path} were made under another contract; encode again")
    return spark.read.parquet(f"{path}/vectors")


def result_lines(hits: DataFrame) -> DataFrame:
    """(query_id, hits): the scores of each query's documents as a map, best first."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rk", F.col("doc_id").cast("string").alias("d"), "sim"))), lambda x: F.struct(x["d"].alias("key"), x["sim"].alias("value")))
    return hits.groupBy("query_id").agg(F.map_from_entries(listed).alias("hits"))


def write_results(hits: DataFrame, path: str) -> None:
    """One JSON line per query."""
    result_lines(hits).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of results with the named columns; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_answers(rows: DataFrame, results: str, hypotheses: str) -> None:
    """rows (question_id, hypothesis, ...) to the end of two sets of JSON lines: all columns, and what a judge reads."""
    rows.write.mode("append").json(results)
    rows.select("question_id", "hypothesis").write.mode("append").json(hypotheses)


def metrics_record(dataset: str, primary: str, computed: DataFrame, claimed: DataFrame | None, n_queries: Column | int) -> DataFrame:
    """One row: dataset, primary metric and value (an error if it was not computed), all metrics, each claim's status, and
    whether all claims hold."""
    value = metrics.primary(computed, primary)
    listed = computed.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.round("value", 4).alias("value"))))).alias("metrics"))
    row = listed.join(F.broadcast(value), F.lit(True))
    if claimed is None:
        checks = computed.sparkSession.range(1).select(F.array().cast("array<string>").alias("claims"), F.lit(True).alias("ok"))
    else:
        judged = metrics.compared(claimed, computed)
        checks = judged.agg(F.array_sort(F.collect_list(F.concat_ws(" ", "status", "metric"))).alias("claims"), F.coalesce(F.bool_and(F.col("status") == "PASS"), F.lit(True)).alias("ok"))
    count = n_queries if isinstance(n_queries, Column) else F.lit(n_queries)
    return row.join(F.broadcast(checks), F.lit(True)).select(F.lit(dataset).alias("dataset"), F.lit(primary).alias("primary"), "primary_value", "metrics", "claims", "ok", count.cast("long").alias("n_queries"))


def write_metrics(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)
