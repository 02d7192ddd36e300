"""The pipeline's stages on small tables."""

import os

import pytest

import corpus_pipeline as P
from vecmill.session import written

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_on_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.dtypes == docs.dtypes
        docs = out
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] >= counts[4] > 0.4 * counts[0]
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(docs.columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_stages_on_odd_rows(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    row = real.first()
    odd = spark.createDataFrame([(900, None, None, None, None), (901, "", "en", "s", 0), (902, "12345 !!", "en", "s", 8), (None, row["text"], "en", "s", 1), (903, row["text"], "en", "s", 1), (903, row["text"], "en", "s", 1)], SCHEMA)
    docs = real.unionByName(odd)
    for name, stage in P.STAGES:
        docs = written(stage(spark, docs, SF), "stage")
        if name == "language":
            assert docs.where("doc_id in (900, 901, 902)").count() == 0
        if name == "near copies":
            assert docs.where("doc_id = 903").count() == 0
    assert docs.count() > 0


def test_repeated_passages_are_cut(spark):
    shared = "".join(f"passage{i} é" for i in range(60))
    docs = spark.createDataFrame([(1, "own words one " + shared, "en", "s", 1), (2, shared + " other own words", "en", "s", 1), (3, "clean text stays", "en", "s", 1)], SCHEMA)
    got = {r["doc_id"]: r for r in P.without_repeats(spark, docs, "").collect()}
    assert got[1]["text"].strip() == "own words one" and got[2]["text"].strip() == "other own words" and got[3]["text"] == "clean text stays"
    assert got[1]["n_chars"] == len(got[1]["text"])


def test_repeated_passages_of_short_words_are_cut(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    long_, short, tiny = words("ab", 51), words("cd", 50), " ".join("abcdefg"[i * i % 7] + "xyz"[i % 3] * (i % 4 == 1) for i in range(60))
    assert len(long_) < 260
    texts = [f"one {long_} own", f"two\n{long_}\nother", f"three {short} more", f"four {short} less", f"five {long_.replace(' ', '  ')} é", f"six {tiny} end", f"seven {tiny} stop", long_, long_]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["text"].split() for r in P.without_repeats(spark, docs, "").collect()}
    assert got == {0: ["one", "own"], 1: ["two", "other"], 2: texts[2].split(), 3: texts[3].split(), 4: ["five", "é"], 5: ["six", "end"], 6: ["seven", "stop"]}


CLASHING = ["score", "lang_pred", "ambiguous", "grade", "severity", "p_toxic", "n_bytes", "n_removed", "n_spans", "n_passages", "kept", "dkey", "spans", "component_id", "sequence_id", "k", "root", "fp", "row", "rows", "__k", "__n", "__row", "__rep_k", "__rep_id", "__rep_n", "rep_k", "n"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_columns_named_like_those_of_operators(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.dtypes == docs.dtypes
            assert out.where(" or ".join(f"{c} <> concat('{c}', doc_id)" for c in CLASHING)).count() == 0
        docs = out
    assert docs.count() > 0


def test_rows_of_one_id_and_rows_without(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    a, b, c = words("ab", 80), words("cd", 80), words("ef", 80)
    rows = [(5, a, "1"), (5, b, "2"), (5, c, "3"), (7, b, "4"), (7, a + " more", "5"), (None, c, "6"), (None, "alone here", "7"), (9, "twice", "8"), (9, "twice", "9"), (None, "nobody", "10"), (None, "nobody", "11")]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], SCHEMA)
    kept = P.without_near_copies(spark, docs, "").collect()
    assert sorted(r["source"] for r in kept if r["source"] not in ("8", "9", "10", "11")) == ["1", "2", "3", "7"]
    assert sum(r["text"] == "twice" for r in kept) == 1 and sum(r["text"] == "nobody" for r in kept) == 1


def test_characters_cut_in_two_and_characters_of_the_text(spark):
    shared = "é" * 250 + "x" * 30
    docs = spark.createDataFrame([(1, "own � text " + shared, "en", "s", 1), (2, shared[1:] + " � other", "en", "s", 1), (3, "è" + shared[1:], "en", "s", 1)], SCHEMA)
    got = {r["doc_id"]: r["text"] for r in P.without_repeats(spark, docs, "").collect()}
    assert got[1].startswith("own � text ") and got[2] == " � other" and set(got[1][len("own � text "):]) <= {"é"}
