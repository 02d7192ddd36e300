"""Settings checks and fingerprints."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vecmill.operators import config_rules as C
from vecmill.plans.registry import query
from vecmill.plans.texts import lit, sql_list
from vecmill.session import table
from vecmill.sources.files import fingerprint

GOOD = {
    "mode": "reproduce", "benchmark": "beir", "dataset": "scifact", "split": "test", "title_mode": "concat_space", "corpus_path": "c", "queries_path": "q", "qrels_path": "r", "is_symmetric": False,
    "architecture": "auto", "model": "intfloat/e5-base-v2", "query_model": None, "doc_model": None, "pooling": "mean", "normalize": True, "score": "cos_sim", "query_max_length": 512, "doc_max_length": 512,
    "query_prefix": "query: ", "passage_prefix": "passage: ", "append_eos": False, "padding_side": "right", "dtype": "float32", "override": False, "index_type": "flat", "main_metric": "nDCG@10", "k_values": [1, 5, 10],
}
VARIANTS = [
    {}, {"corpus_path": ""}, {"pooling": "max"}, {"normalize": False}, {"index_type": "hnsw"}, {"main_metric": "nDCG@7"}, {"main_metric": "Rank@10"}, {"query_prefix": "query:"}, {"model": "own/model"},
    {"model": "own/model", "override": True}, {"is_symmetric": True}, {"architecture": "dpr", "model": None}, {"dtype": None, "split": None}, {"model": "facebook/contriever", "normalize": False, "score": "ip", "query_prefix": "", "passage_prefix": ""},
    {"model": "BAAI/bge-base-en", "pooling": "cls", "passage_prefix": "", "query_prefix": ""}, {"model": "BAAI/bge-m3", "pooling": "cls"}, {"model": "intfloat/e5-mistral-7b-instruct"}, {"mode": "explore", "model": "own/model", "index_type": "ivf"},
    {"model": "sebastian/tas-b"}, {"model": None, "architecture": "dpr", "query_model": "facebook-dpr-question_encoder", "doc_model": "facebook-dpr-ctx_encoder", "pooling": "cls_pooler", "normalize": False, "score": "ip", "query_prefix": None, "passage_prefix": "", "title_mode": "dpr_sep"},
]
SETTINGS = [{"id": i, **GOOD, **v} for i, v in enumerate(VARIANTS)]


def settings(spark):
    rows = F.from_json(F.lit(json.dumps(SETTINGS, ensure_ascii=False)), f"array<struct<{', '.join(f'`{c.split()[0]}`: {c.split()[1]}' for c in C.COLUMNS.split(', '))}>>")
    return spark.range(1).select(F.explode(rows).alias("s")).select("s.*")


def _value(v, name):
    if isinstance(v, list):
        return str(v)
    if v is None:
        kind = next(c.split()[1] for c in C.COLUMNS.split(", ") if c.split()[0] == name)
        return {"string": "NULL::VARCHAR", "int": "NULL::INT", "boolean": "NULL::BOOLEAN"}.get(kind, "NULL")
    return {True: "true", False: "false"}[v] if isinstance(v, bool) else str(v) if isinstance(v, int) else lit(v)


_NAMES = [c.split()[0] for c in C.COLUMNS.split(", ")]
_TABLE = f"cfg({', '.join(_NAMES)}) AS (VALUES " + ", ".join("(" + ", ".join(_value(s[n], n) for n in _NAMES) + ")" for s in SETTINGS) + ")"


#: The families by the names of their models, as patterns.
NAMED = {
    "dpr": "regexp_matches(s, 'dpr-(question|ctx)_encoder|facebook-dpr-')",
    "contriever": "regexp_matches(s, 'facebook/contriever|contriever$|/contriever-')",
    "e5-instruct": "regexp_matches(s, 'e5-mistral') OR (regexp_matches(s, 'e5-') AND regexp_matches(s, 'instruct'))",
    "e5": "regexp_matches(s, 'intfloat/e5-|multilingual-e5|/e5-(small|base|large)') AND NOT regexp_matches(s, 'instruct|mistral')",
    "bge-m3": "regexp_matches(s, 'bge-m3')",
    "bge": "regexp_matches(s, 'bge-') AND NOT regexp_matches(s, 'bge-m3')",
    "tas-b": "regexp_matches(s, 'tas-b')",
}


def _checked_sql(table: str) -> str:
    """table: the WITH-part cfg. WITH-parts and a select of id, family and errors."""
    e = [f"CASE WHEN {k} IS NULL THEN 'missing {k}' END" for k in C.REQUIRED]
    e += [f"CASE WHEN trim(coalesce({k}, '')) = '' THEN 'empty {k}' END" for k in C.PATHS]
    e += [f"CASE WHEN NOT coalesce(list_contains({sql_list(v)}, {k}), false) THEN 'value of {k}' END" for k, v in C.ALLOWED.items()]
    e += [
        "CASE WHEN architecture IN ('dpr', 'bi_encoder') AND (coalesce(query_model, '') = '' OR coalesce(doc_model, '') = '') THEN 'two models needed' END",
        "CASE WHEN architecture NOT IN ('dpr', 'bi_encoder') AND coalesce(model, '') = '' THEN 'model needed' END",
        "CASE WHEN NOT coalesce(normalize, false) AND score = 'cos_sim' THEN 'cosine without normalizing' END",
        "CASE WHEN mode = 'reproduce' AND index_type <> 'flat' THEN 'exact index needed' END",
        "CASE WHEN is_symmetric AND coalesce(passage_prefix, '') <> '' AND passage_prefix <> coalesce(query_prefix, '') THEN 'symmetric prefixes differ' END",
        r"CASE WHEN NOT regexp_matches(main_metric, '^(nDCG|NDCG|MAP|MRR|Recall|Hit|Accuracy|P)@(\d+)$') THEN 'unknown metric' WHEN NOT list_contains(k_values, regexp_extract(main_metric, '@(\d+)$', 1)::INT) THEN 'k of main metric not computed' END",
    ]
    for label, expected in C.FAMILIES:
        for f, want in expected.items():
            got = f"coalesce({f}, '')" if f.endswith("prefix") else f
            e.append(f"CASE WHEN NOT override AND family = '{label}' AND {got} IS DISTINCT FROM {_value(want, f)} THEN 'family {label} {f}' END")
    e += [
        "CASE WHEN family IS NULL AND NOT override AND mode = 'reproduce' THEN 'unknown family' END",
        f"CASE WHEN family = 'bge' AND NOT override AND NOT list_contains({sql_list(C.BGE_PREFIXES)}, coalesce(query_prefix, '')) THEN 'bge query prefix' END",
        "CASE WHEN family = 'bge' AND NOT override AND mode = 'reproduce' AND coalesce(query_prefix, '') = '' THEN 'bge query prefix empty' END",
        "CASE WHEN family = 'e5' AND is_symmetric AND NOT override AND coalesce(passage_prefix, '') <> 'query: ' THEN 'e5 symmetric prefix' END",
    ]
    whens = " ".join(f"WHEN {test} THEN '{label}'" for label, test in NAMED.items())
    return f"""WITH {table}, n AS (SELECT *, lower(coalesce(model, '') || ' ' || coalesce(query_model, '') || ' ' || coalesce(doc_model, '')) AS s FROM cfg),
f AS (SELECT *, CASE {whens} END AS family FROM n) SELECT id, family, array_to_string(list_filter([{', '.join(e)}], lambda x: x IS NOT NULL), '; ') AS errors FROM f"""


@query("config_errors", _checked_sql(_TABLE))
def config_errors(spark, sf_dir):
    """Every setting of the fixture with its family and all its errors."""
    return C.with_errors(settings(spark)).select("id", "family", F.array_join("errors", "; ").alias("errors"))


_CONTRACT = ["architecture", "model", "query_model", "doc_model", "pooling", "normalize", "score", "query_max_length", "doc_max_length", "query_prefix", "passage_prefix", "append_eos", "padding_side", "dtype"]


@query("config_fingerprint", f"WITH {_TABLE} SELECT id, substr(sha256({' || chr(31) || '.join(f'coalesce({c}::VARCHAR, chr(0))' for c in _CONTRACT)}), 1, 16) AS fingerprint FROM cfg")
def config_fingerprint(spark, sf_dir):
    """The part of a setting that decides whether stored vectors may be used, as a short hash."""
    return settings(spark).select("id", fingerprint([F.col(c) for c in _CONTRACT]).alias("fingerprint"))


# A setting made of each part: a digit of a hash of its key and name chooses each field's value.

_MODELS = ["intfloat/e5-base-v2", "own/model", "facebook/contriever", "BAAI/bge-base-en", "BAAI/bge-m3", "intfloat/e5-mistral-7b-instruct", "sebastian/tas-b", "facebook-dpr-ctx_encoder", "", None]
CHOICES = {
    "mode": ["reproduce", "reproduce", "explore"], "split": ["test", "test", "test", None], "title_mode": ["concat_space", "text_only", "dpr_sep", "title"], "corpus_path": ["c", "c", "c", " ", None], "is_symmetric": [False, False, True],
    "architecture": ["auto", "auto", "dpr", "bi_encoder", "other"], "model": _MODELS, "query_model": [None, "facebook-dpr-question_encoder", ""], "doc_model": [None, "facebook-dpr-ctx_encoder"], "pooling": ["mean", "cls", "eos", "cls_pooler", "max"],
    "normalize": [True, False, True, None], "score": ["cos_sim", "ip", "dot"], "query_max_length": [512, 32, None], "query_prefix": ["query: ", "", *C.BGE_PREFIXES, None], "passage_prefix": ["passage: ", "query: ", "", None],
    "append_eos": [False, True], "dtype": ["float32", "float16", None], "override": [False, False, False, True], "index_type": ["flat", "flat", "hnsw", "ivf"], "main_metric": ["nDCG@10", "Recall@5", "MRR@7", "Rank@10", "P@", "Hit@1"],
}


def _chosen_sql() -> str:
    fields = []
    for n in _NAMES:
        if n == "id":
            fields.append("p_partkey AS id")
        elif n in CHOICES:
            fields.append(f"([{', '.join(_value(v, n) for v in CHOICES[n])}])[1 + ('0x' || substr(h, {list(CHOICES).index(n) + 1}, 1))::INT % {len(CHOICES[n])}] AS {n}")
        else:
            fields.append(f"{_value(GOOD[n], n)} AS {n}")
    return f"cfg AS MATERIALIZED (SELECT {', '.join(fields)} FROM (SELECT p_partkey, md5(p_partkey || '|' || coalesce(p_name, '')) AS h FROM part WHERE p_partkey IS NOT NULL))"


@query("part_settings", f"SELECT x.*, fingerprint FROM ({_checked_sql(_chosen_sql())}) x JOIN (WITH {_chosen_sql()} SELECT id, substr(sha256({' || chr(31) || '.join(f'coalesce({c}::VARCHAR, chr(0))' for c in _CONTRACT)}), 1, 16) AS fingerprint FROM cfg) USING (id)")
def part_settings(spark, sf_dir):
    """Settings of all kinds, one made of each part, with their families, errors and the hash of their contract."""
    h = F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit("|"), F.coalesce("p_name", F.lit(""))))
    rows = table(spark, sf_dir, "part").where("p_partkey is not null").select("p_partkey", h.alias("h"))
    digit = lambda i: F.conv(F.substring("h", i, 1), 16, 10).cast("int")
    fields = [F.col("p_partkey").alias("id")]
    for name, kind in (c.split() for c in C.COLUMNS.split(", ")[1:]):
        known = F.array(*map(F.lit, GOOD[name])) if isinstance(GOOD[name], list) else F.lit(GOOD[name])
        if name in CHOICES:
            known = F.get(F.array(*[F.lit(v).cast(kind) for v in CHOICES[name]]), digit(list(CHOICES).index(name) + 1) % len(CHOICES[name]))
        fields.append(known.cast(kind).alias(name))
    checked = C.with_errors(rows.select(*fields))
    return checked.select("id", "family", F.array_join("errors", "; ").alias("errors"), fingerprint([F.col(c) for c in _CONTRACT]).alias("fingerprint"))
