"""Language identification (operator 4).

Method. Error-correcting output codes: every language has a codeword; for each of its bits a binary logistic
classifier over hashed byte n-grams predicts the bit.  Decoding is loss-weighted: the codeword with the least sum of
logistic losses wins, its share among exp(-loss) of all codewords is the score, and a text whose two best codewords
are closer than `margin` in loss is flagged as ambiguous.  Up to six languages get the exhaustive code, more of them
a fixed pseudo-random one.

Scale. Counting n-grams and predicting is one pass without a shuffle.  The classifiers are fitted by one task from
a bounded sample of labelled rows: at most `sample_rows`, shared evenly by languages and chosen by a hash of id and
text.  Whole texts are counted, in training and in prediction.

Edge cases. Null texts and texts without a letter are `und` with score 0.  Without labelled rows all are `und`.
A null doc_id is not held out and not learned from.  Texts may be of any length: n-grams are counted in pieces.  Of equally
near codewords that of the first language in the alphabet wins, and the text is ambiguous.  Rows are independent; repeated
ones stay.  Columns to keep must not be named like those that are made here; inside a struct they may.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.tasks import checked, fitted, text_last, with_columns
from vecmill.session import prepare, table

UNKNOWN = "und"
_PLAIN_LETTER = re.compile("[A-Za-z]")
_BITS = 11
_WEIGHTS = [(0x9E3779B1, 0x85EBCA77), (0xC2B2AE3D, 0x27D4EB2F, 0x165667B1), (0xD3A2646D, 0xFD7046C5, 0xB55A4F09, 0x61C88647)]


def has_letter(text: str | None) -> bool:
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def gram_counts(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 2-, 3- and 4-grams of bytes, of the lower-cased text."""
    data = np.frombuffer(text.lower().encode("utf-8"), np.uint8)
    counts = np.zeros(len(_WEIGHTS) << _BITS, np.float32)
    for k, weights in enumerate(_WEIGHTS):
        n = len(data) - len(weights) + 1
        if n <= 0:
            continue
        for at in range(0, n, 1 << 20):
            m = min(n - at, 1 << 20)
            code = np.zeros(m, np.uint32)
            for i, w in enumerate(weights):
                code += data[at + i : at + i + m] * np.uint32(w)
            counts[k << _BITS : (k + 1) << _BITS] += np.bincount(code >> np.uint32(32 - _BITS), minlength=1 << _BITS)
        counts[k << _BITS : (k + 1) << _BITS] /= n
    return np.sqrt(counts)


def codewords(k: int) -> np.ndarray:
    """k rows of -1 and 1; no column is constant, no two rows are equal."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 6:
        columns = [[1, *(1 if c >> i & 1 else -1 for i in range(k - 1))] for c in range((1 << (k - 1)) - 1)]
        return np.array(columns, float).T
    rng = np.random.default_rng(20240501)
    length = max(15, int(np.ceil(10 * np.log2(k))))
    while True:
        code = rng.choice([-1.0, 1.0], (k, length))
        if len(np.unique(code, axis=0)) == k and (np.abs(code.sum(0)) < k).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    margin: float

    def losses(self, features: np.ndarray) -> np.ndarray:
        """Sum over the bits of the logistic loss that each codeword has, for each row."""
        z = features @ self.weights + self.bias
        return np.logaddexp(0, -z[:, None, :] * self.code[None]).sum(2)

    def decide(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        loss = self.losses(features)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        two = np.sort(loss, 1)[:, :2]
        return loss.argmin(1), share.max(1), (two[:, 1] - two[:, 0] < self.margin) if loss.shape[1] > 1 else np.zeros(len(loss), bool)


def fit(features: np.ndarray, which: np.ndarray, languages: list[str], margin: float, steps: int = 300, ridge: float = 1e-5) -> Model:
    """Accelerated gradient descent on the logistic losses of all bits at once; classes count alike. Centres features in place."""
    code = codewords(len(languages))
    target = code[which]
    share = (1 / np.bincount(which, minlength=len(languages)).clip(1))[which]
    share = (share / share.sum())[:, None]
    centre = features.mean(0)
    x = np.subtract(features, centre, out=features)
    rate = 1.0 / (0.25 * float((share * np.einsum("ij,ij->i", x, x)[:, None]).sum()) + ridge)
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1])
    ahead_w, ahead_b, t = w, b, 1.0
    for _ in range(steps):
        z = x @ ahead_w + ahead_b
        g = -target * share / (1 + np.exp(np.clip(target * z, -50, 50)))
        new_w = ahead_w - rate * (x.T @ g.astype(np.float32) + ridge * ahead_w)
        new_b = ahead_b - 2.0 * g.sum(0)
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w = new_w + np.float32((t - 1) / new_t) * (new_w - w)
        ahead_b = new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return Model(languages, code, w, b - centre @ w, margin)


def _fit_rows(languages: list[str], margin: float, batches: Iterator[pa.RecordBatch]) -> Model | None:
    """batches: (lang, counts as half-precision numbers), in any order."""
    sample = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    if not sample:
        return None
    which = np.array([languages.index(lang) for lang, _ in sample])
    features = np.empty((len(sample), len(_WEIGHTS) << _BITS), np.float32)
    for i, (_, x) in enumerate(sample):
        features[i] = np.frombuffer(x, "<f2")
    del sample
    return fit(features, which, languages, margin)


def learn(docs: DataFrame, labelled, sample_rows: int = 3000, margin: float = 1.0) -> Model | None:
    """Fit on at most sample_rows of the rows where `labelled` holds and text and lang are there."""
    prepare(docs.sparkSession)
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    languages = sorted(counts)
    each = max(1, sample_rows // len(languages))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)
    chance = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, each / counts[k]))])
    chosen = rows.where(place < F.element_at(chance, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for i, lang in enumerate(langs):
                text = texts[i].as_py()
                if has_letter(text):
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([gram_counts(text).astype("<f2").tobytes()], pa.binary())], names=["lang", "x"])

    return fitted(chosen.mapInArrow(run, "lang string, x binary"), partial(_fit_rows, languages, margin))


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The operator: the columns in `keep` (doc_id by default) with lang_pred, score and ambiguous, for each row."""
    prepare(docs.sparkSession)
    keep = checked(keep or ["doc_id"], ["lang_pred", "score", "ambiguous"])
    columns, at_text = text_last(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text)
            n = batch.num_rows
            pred, score, unsure = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            for at in range(0, n, 256):
                held, which = [], []
                for i in range(at, min(at + 256, n)):
                    text = texts[i].as_py()
                    if model is not None and has_letter(text):
                        held.append(gram_counts(text))
                        which.append(i)
                if held:
                    best, share, near = model.decide(np.stack(held))
                    for i, k in zip(which, best.tolist(), strict=True):
                        pred[i] = model.languages[k]
                    score[which], unsure[which] = share, near
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], names=[*keep, "lang_pred", "score", "ambiguous"])

    return docs.select(*columns).mapInArrow(run, with_columns(docs, keep, "lang_pred string, score double, ambiguous boolean"))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous for every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, F.col("doc_id").isNotNull() & ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
