"""Operators 4 and 10: held-out accuracy, defined results for odd rows, and the ordinal model."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecmill.llm import languages, toxicity

SF = "/root/testdata/sf0.01"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@here
def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = languages.op4_languages(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    r = got.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert r[0] > 0.97 and r[1] > 200 and 0 <= r[2] <= r[3] <= 1
    assert got.count() == docs.count()


def test_codewords():
    for k in (1, 2, 3, 6, 7, 40):
        code = languages.codewords(k)
        assert len(np.unique(code, axis=0)) == k
        assert k == 1 or (np.abs(code.sum(0)) < k).all()


def test_language_of_odd_rows(spark):
    words = {"xx": "kala mala tala", "yy": "brzk drzk", "zz": "oui eau"}
    rows = [(i, f"{words[k]} " * (2 + i % 3), k) for i in range(60) for k in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = languages.learn(docs, F.lit(True))
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "kala tala mala"), (4, "kala tala mala"), (None, "brzk"), (6, "é"), (7, "drzk " * 300_000)], "doc_id long, text string")
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in languages.identify(odd, model).collect()]
    by = {}
    for i, lang, score in got:
        by.setdefault(i, []).append((lang, score))
    assert by[1] == by[2] == by[3] == [("und", 0.0)]
    assert [x for x, _ in by[4]] == ["xx", "xx"] and by[None][0][0] == "yy" and by[7][0][0] == "yy" and by[6][0][0] in words
    assert languages.identify(odd.limit(0), model).count() == 0
    assert languages.learn(docs.limit(0), F.lit(True)) is None
    assert {r["lang_pred"] for r in languages.identify(odd, None).collect()} == {"und"}


@here
def test_toxicity_on_rows_it_did_not_learn_from(spark):
    docs = spark.read.parquet(f"/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet(f"/root/testdata/sf0.1/labels.parquet").dropDuplicates(["doc_id"])
    model = toxicity.learn(docs, toxicity.graded(labels.where("doc_id % 3 <> 0")))
    got = toxicity.grade(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id")
    r = got.groupBy("toxic").agg(F.avg((F.col("grade") > 0).cast("int")).alias("flagged")).collect()
    flagged = {x["toxic"]: x["flagged"] for x in r}
    assert flagged[1] > 0.85 and flagged[0] < 0.02


def test_ordinal_thresholds_and_severity():
    rng = np.random.default_rng(1)
    docs, grades = [], []
    for _ in range(600):
        g = int(rng.integers(0, 3))
        words = list(rng.integers(1000, 1200, 30)) + [10 + w for w in range(2 * g)]
        docs.append(np.unique(np.array(words, np.uint64)))
        grades.append(g)
    model = toxicity.fit(docs, np.array(grades))
    assert (np.diff(model.thresholds) >= 0).all() and len(model.thresholds) == 2
    severity = np.array([model.above(d).sum() for d in docs])
    means = [severity[np.array(grades) == g].mean() for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_toxicity_of_odd_rows(spark):
    rows = [(i, "nice day " + ("vile " if i % 2 else "") + f"w{i % 7}", i % 2) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, toxicity.graded(labels))
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "VILE!", 9), (3, "VILE!", 9), (None, "nice", 9)], "doc_id long, text string, severity int")
    got = [(r["doc_id"], r["grade"]) for r in toxicity.grade(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (3, 1), (3, 1), (None, 0)], key=str)
    assert toxicity.grade(odd.limit(0), model).count() == 0
    assert toxicity.learn(docs, toxicity.graded(labels.limit(0))) is None
    assert {r["severity"] for r in toxicity.grade(odd.select("doc_id", "text"), None).collect()} == {0.0}


def test_decoding_against_a_loop_over_codewords():
    rng = np.random.default_rng(3)
    code = languages.codewords(5)
    model = languages.Model(list("abcde"), code, rng.standard_normal((12, code.shape[1])), rng.standard_normal(code.shape[1]), 0.4)
    x = rng.standard_normal((40, 12))
    best, share, near = model.decide(x)
    for i, row in enumerate(x):
        z = [sum(row[k] * model.weights[k, b] for k in range(12)) + model.bias[b] for b in range(code.shape[1])]
        loss = [sum(np.log(1 + np.exp(-z[b] * code[c, b])) for b in range(len(z))) for c in range(5)]
        order = sorted(range(5), key=lambda c: (loss[c], c))
        assert best[i] == order[0] and near[i] == (loss[order[1]] - loss[order[0]] < 0.4)
        assert abs(share[i] - np.exp(-loss[order[0]]) / sum(np.exp(-v) for v in loss)) < 1e-9


def test_ties_between_codewords_go_to_the_first_language():
    code = languages.codewords(3)
    model = languages.Model(list("abc"), code, np.zeros((4, code.shape[1])), np.zeros(code.shape[1]), 0.1)
    best, share, near = model.decide(np.ones((2, 4)))
    assert best.tolist() == [0, 0] and near.all() and np.allclose(share, 1 / 3)


def test_fit_meets_the_conditions_of_its_optimum():
    """At the least of the penalised losses every weight's gradient is the penalty, and no other gradient passes it."""
    rng = np.random.default_rng(2)
    grades = rng.integers(0, 3, 300)
    docs = [np.unique(np.concatenate([rng.integers(1000, 1300, 25), 10 + np.arange(3 * g) + rng.integers(0, 2)])).astype(np.uint64) for g in grades]
    penalty = 2e-3
    model = toxicity.fit(docs, grades, penalty=penalty, steps=4000, tolerance=1e-7)
    vocabulary, counts = np.unique(np.concatenate(docs), return_counts=True)
    vocabulary, counts = vocabulary[counts >= 3], counts[counts >= 3]
    x = np.array([np.isin(vocabulary, d) for d in docs], float) / np.sqrt(counts / len(docs))
    weight = dict(zip(model.vocabulary.tolist(), model.weights.tolist(), strict=True))
    w = np.array([weight.get(v, 0.0) for v in vocabulary.tolist()]) * np.sqrt(counts / len(docs))
    y = (grades[:, None] > np.arange(2)).astype(float)
    share = np.where(grades > 0, 0.5 / (grades > 0).sum(), 0.5 / (grades == 0).sum())
    gap = (1 / (1 + np.exp(model.thresholds[None] - (x @ w)[:, None])) - y) * share[:, None]
    g = x.T @ gap.sum(1)
    assert np.abs(gap.sum(0)).max() < 1e-4
    assert np.abs(g[w == 0]).max() <= penalty * 1.06 and np.abs(g[w != 0] + penalty * np.sign(w[w != 0])).max() < penalty * 0.06


def test_two_grades_have_one_threshold(spark):
    rows = [(i, "nice " + ("vile " if i % 2 else "") + "word " * (200_000 if i == 0 else 1)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, grade int")
    model = toxicity.learn(docs, grades)
    assert len(model.thresholds) == 1
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    assert all(r["severity"] == r["p_toxic"] and r["grade"] == i % 2 for i, r in got.items())
    with pytest.raises(ValueError):
        toxicity.grade(docs.withColumn("grade", F.lit(1)), model, ["doc_id", "grade"])


def test_the_driver_fits_no_model(spark, monkeypatch):
    def here(*_args, **_options):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(languages, "fit", here)
    monkeypatch.setattr(toxicity, "fit", here)
    docs = spark.createDataFrame([(i, f"{'sehr gut und schön' if i % 2 else 'very good and nice'} {i}", "de" if i % 2 else "en", i % 2) for i in range(60)], "doc_id long, text string, lang string, toxic int")
    model = languages.learn(docs, F.lit(True))
    assert model.languages == ["de", "en"]
    again = languages.learn(docs.repartition(7), F.lit(True))
    assert (model.weights == again.weights).all() and (model.bias == again.bias).all()  # whatever order rows come in
    model = toxicity.learn(docs, toxicity.graded(docs))
    assert len(model.vocabulary) and (model.weights == toxicity.learn(docs.repartition(7), toxicity.graded(docs)).weights).all()
