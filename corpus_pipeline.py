"""The corpus pipeline: language, toxicity, near copies, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs; all but the last return the columns of documents, whatever these are named.

1. language: texts without a letter (`und`) and texts that no language clearly wins go.
2. toxicity: documents of a toxic grade go.
3. near copies: of each group of near-duplicate documents (five-word shingles, similarity 0.8) the one with the least
   doc_id stays, of equal ids the one whose text has the least hash.  Rows of one doc_id with unlike texts all stay.
4. repeated passages: bytes covered by a passage of more than 50 words, or by a 400-byte string, that occurs anywhere
   else are cut out; of a character cut in two nothing stays; documents of which only white space is left go.
5. packing: the tokens of what is left in sequences of at most 1024.

Rows without doc_id are judged like others and come last within their group.  Empty tables give empty results in every
stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm import languages, packing, simhash, suffixes, toxicity
from vecmill.session import removed, table, written_at

ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """The text beside all other columns in one struct, so that no name meets that of an operator's column."""
    return docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != "text"]).alias("__row"), "text")


def _columns(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Again the columns of docs."""
    return rows.select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = languages.learn(docs, F.col("doc_id").isNotNull() & ~languages.held_out(), margin=0.3)
    judged = languages.identify(_rows(docs), model, ["__row", "text"])
    return _columns(judged.where((F.col("lang_pred") != languages.UNKNOWN) & ~F.col("ambiguous")), docs)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(docs, toxicity.graded(table(spark, sf_dir, "labels")))
    return _columns(toxicity.grade(_rows(docs), model, ["__row", "text"]).where("grade = 0"), docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.without_copies(docs, width=5, similarity=0.8)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.cut(_rows(docs), keep=["__row"], words=suffixes.PASSAGE_WORDS, characters=True)
    rest = _columns(cut.withColumn("text", F.col("kept").cast("string")).where("n_removed = 0 or text rlike '\\\\S'"), docs)
    if "n_chars" in docs.columns:
        rest = rest.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rest


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", by_language),
    ("toxicity", without_toxic),
    ("near copies", without_near_copies),
    ("repeated passages", without_repeats),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = written_at(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            removed(spark, before)
        before = path
    return docs
