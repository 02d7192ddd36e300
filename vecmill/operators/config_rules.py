"""Checks of experiment settings, a row per setting: errors as an array of codes with details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmill.operators.metrics import metric_name

# Allowed settings and what each family of models needs; the first family that fits counts.
ALLOWED = {
    "title_mode": ["concat_space", "dpr_sep", "text_only"],
    "pooling": ["cls", "cls_pooler", "mean", "eos"],
    "score": ["ip", "cos_sim"],
    "architecture": ["auto", "dpr", "bi_encoder"],
    "index_type": ["flat", "hnsw", "ivf"],
}
FAMILIES = [
    ("dpr", {"architecture": "dpr", "pooling": "cls_pooler", "normalize": False, "score": "ip", "query_prefix": "", "passage_prefix": "", "title_mode": "dpr_sep"}),
    ("contriever", {"pooling": "mean", "normalize": False, "score": "ip", "query_prefix": "", "passage_prefix": ""}),
    ("e5-instruct", {"pooling": "eos", "normalize": True, "score": "cos_sim", "append_eos": True, "passage_prefix": ""}),
    ("e5", {"pooling": "mean", "normalize": True, "score": "cos_sim", "query_prefix": "query: ", "passage_prefix": "passage: "}),
    ("bge-m3", {"pooling": "cls", "normalize": True, "score": "cos_sim"}),
    ("bge", {"pooling": "cls", "normalize": True, "score": "cos_sim", "passage_prefix": ""}),
    ("tas-b", {"pooling": "cls", "normalize": False, "score": "ip", "query_prefix": "", "passage_prefix": ""}),
]
BGE_PREFIXES = ["Represent this sentence for searching relevant passages: ", "为这个句子生成表示以用于检索相关文章：", ""]
REQUIRED = ["benchmark", "dataset", "split", "title_mode", "architecture", "pooling", "normalize", "score", "query_max_length", "doc_max_length", "query_prefix", "passage_prefix", "append_eos", "padding_side", "dtype"]
PATHS = ["corpus_path", "queries_path", "qrels_path"]
COLUMNS = (
    "id int, mode string, benchmark string, dataset string, split string, title_mode string, corpus_path string, queries_path string, qrels_path string, is_symmetric boolean, architecture string, model string, query_model string, doc_model string, "
    "pooling string, normalize boolean, score string, query_max_length int, doc_max_length int, query_prefix string, passage_prefix string, append_eos boolean, padding_side string, dtype string, override boolean, index_type string, main_metric string, k_values array<int>"
)


def named(s: Column) -> dict[str, Column]:
    """Which family the lower-cased names of models fit, in the order in which they are asked."""
    has = lambda x: F.contains(s, F.lit(x))
    any_of = lambda *xs: reduce(lambda a, b: a | b, map(has, xs))
    return {
        "dpr": any_of("dpr-question_encoder", "dpr-ctx_encoder", "facebook-dpr-"),
        "contriever": any_of("facebook/contriever", "/contriever-") | F.endswith(s, F.lit("contriever")),
        "e5-instruct": has("e5-mistral") | (has("e5-") & has("instruct")),
        "e5": any_of("intfloat/e5-", "multilingual-e5", "/e5-small", "/e5-base", "/e5-large") & ~any_of("instruct", "mistral"),
        "bge-m3": has("bge-m3"),
        "bge": has("bge-") & ~has("bge-m3"),
        "tas-b": has("tas-b"),
    }


def family() -> Column:
    s = F.lower(F.concat_ws(" ", F.coalesce("model", F.lit("")), F.coalesce("query_model", F.lit("")), F.coalesce("doc_model", F.lit(""))))
    return F.coalesce(*[F.when(fits, name) for name, fits in named(s).items()])


def with_errors(settings: DataFrame) -> DataFrame:
    """settings with `family` and `errors`, an array of codes in a fixed order."""
    c = F.col
    no = lambda name: F.coalesce(c(name), F.lit("")) == ""
    found: list[Column] = [F.when(c(k).isNull(), f"missing {k}") for k in REQUIRED]
    found += [F.when(F.trim(F.coalesce(c(k), F.lit(""))) == "", f"empty {k}") for k in PATHS]
    found += [F.when(~F.coalesce(c(k).isin(v), F.lit(False)), f"value of {k}") for k, v in ALLOWED.items()]
    two = F.coalesce(c("architecture").isin("dpr", "bi_encoder"), F.lit(False))
    found.append(F.when(two & (no("query_model") | no("doc_model")), "two models needed"))
    found.append(F.when(~two & no("model"), "model needed"))
    found.append(F.when(~F.coalesce(c("normalize"), F.lit(False)) & c("score").eqNullSafe("cos_sim"), "cosine without normalizing"))
    reproduce = F.coalesce(c("mode"), F.lit("reproduce")) == "reproduce"
    found.append(F.when(reproduce & ~c("index_type").eqNullSafe("flat"), "exact index needed"))
    qp, pp = F.coalesce(c("query_prefix"), F.lit("")), F.coalesce(c("passage_prefix"), F.lit(""))
    found.append(F.when(F.coalesce(c("is_symmetric"), F.lit(False)) & (pp != "") & (pp != qp), "symmetric prefixes differ"))
    name = F.coalesce(c("main_metric"), F.lit("nDCG@10"))
    k = F.regexp_extract(name, r"@(\d+)$", 1)
    found.append(F.when(metric_name(name).isNull(), "unknown metric").when(~F.coalesce(F.array_contains("k_values", k.try_cast("int")), F.lit(False)), "k of main metric not computed"))
    own = F.coalesce(c("override"), F.lit(False))
    for label, expected in FAMILIES:
        for field, want in expected.items():
            got = F.coalesce(c(field), F.lit("")) if field.endswith("prefix") else c(field)
            found.append(F.when(~own & c("family").eqNullSafe(label) & ~got.eqNullSafe(F.lit(want)), f"family {label} {field}"))
    found.append(F.when(c("family").isNull() & ~own & reproduce, "unknown family"))
    bge = c("family").eqNullSafe("bge") & ~own
    found.append(F.when(bge & ~qp.isin(BGE_PREFIXES), "bge query prefix"))
    found.append(F.when(bge & reproduce & (qp == ""), "bge query prefix empty"))
    found.append(F.when(c("family").eqNullSafe("e5") & F.coalesce(c("is_symmetric"), F.lit(False)) & ~own & (pp != "query: "), "e5 symmetric prefix"))
    return settings.withColumn("family", family()).withColumn("errors", F.array_compact(F.array(*found)))
