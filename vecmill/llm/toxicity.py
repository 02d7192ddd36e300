"""Toxicity grades (operator 10).

Method. Cumulative-link ordinal regression: P(grade > k) = logistic(w.x - theta_k) with one weight vector for all
ordered thresholds theta_0 <= theta_1 <= ...; x says which words, and which
beginnings of words, a text has.  The output is the expected severity,
the sum of these probabilities.  Weights are fitted by proximal gradient steps with an L1 penalty, so only words that
tell keep a weight; words that training did not see weigh nothing.

Grades. They are those of the labels, of which there may be any number.  Labels that only say toxic or not are two
grades with one threshold, and the expected severity is then the probability of the upper one.

Scale. One pass without a shuffle over whole texts.  Training takes at most `sample_rows` labelled rows, half of them
toxic where there are so many, chosen by a hash of doc_id; their ids (a bounded table) are broadcast, texts are not
shuffled.  One task fits.

Edge cases. A null or empty text has no words: severity is what the thresholds alone give.  Without labels, or with
one grade only, severity is 0.  doc_id may be null or repeated; of repeated ids one text is learned from, that of the
least hash, with the highest grade.  Texts may be of any length: words are found in pieces.  A probability of exactly a
half counts as above.  Columns to keep must not be named like those that are made here; inside a struct they may.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.tasks import checked, fitted, text_last, with_columns
from vecmill.llm.windows import Rolling, mixed
from vecmill.session import prepare, table

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
CHUNK = 1 << 18
PREFIXES = (4, 5, 6)
ROUNDS, JOINING = 40, 1000


def features(text: str | None) -> np.ndarray:
    """64-bit hashes of the words (letters and digits, lower-cased) of a text and of their first 4, 5 and 6 bytes."""
    raw = (text or "").lower().encode("utf-8")
    found = []
    at = 0
    while at < len(raw):
        to = min(at + CHUNK, len(raw))
        while to < len(raw) and _WORD[raw[to]]:
            to += 1  # words are not cut
        data = np.frombuffer(raw, np.uint8)[at:to]
        inside = np.concatenate([[False], _WORD[data], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        if len(edge):
            roll, start, end = Rolling(data, 0), edge[::2], edge[1::2]
            found.append(roll.ranges(start, end))
            for n in PREFIXES:
                longer = start[end - start > n]
                found.append(mixed(roll.ranges(longer, longer + n) + np.uint64(n)))
        at = to
    return np.concatenate(found) if found else np.empty(0, np.uint64)


@dataclass
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def score(self, hashes: np.ndarray) -> float:
        if not len(self.vocabulary) or not len(hashes):
            return 0.0
        at = np.searchsorted(self.vocabulary, hashes).clip(max=len(self.vocabulary) - 1)
        return float(self.weights[np.unique(at[self.vocabulary[at] == hashes])].sum())

    def above(self, hashes: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.score(hashes), -50, 50)))


def _descend(row: np.ndarray, column: np.ndarray, scale: np.ndarray, y: np.ndarray, share: np.ndarray, w: np.ndarray, theta: np.ndarray, penalty: float, steps: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient steps until neither weights nor thresholds move. row, column: where features are."""
    n, v, levels = len(y), len(w), y.shape[1]
    size = np.bincount(row, weights=scale[column] ** 2, minlength=n)
    rate = 1.0 / (0.25 * levels * np.quantile(np.sqrt(size), 0.95) ** 2 + 1e-9)
    ahead_w, ahead_theta, t = w, theta, 1.0
    for _ in range(steps):
        s = np.bincount(row, weights=(ahead_w * scale)[column], minlength=n)
        gap = (1 / (1 + np.exp(np.clip(ahead_theta[None] - s[:, None], -50, 50))) - y) * share[:, None]
        g = np.bincount(column, weights=gap.sum(1)[row], minlength=v) * scale
        new = ahead_w - rate * n * 0.5 * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * n * 0.5 * penalty, 0)
        new_theta = np.maximum.accumulate(ahead_theta + gap.sum(0))
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        moved = max(np.abs(new - w).max(initial=0), np.abs(new_theta - theta).max())
        ahead_w, ahead_theta = new + (t - 1) / new_t * (new - w), new_theta + (t - 1) / new_t * (new_theta - theta)
        w, theta, t = new, new_theta, new_t
        if moved < tolerance:
            break
    return w, theta


def fit(docs: list[np.ndarray], grades: np.ndarray, least_docs: int = 3, penalty: float = 2e-3, steps: int = 300, tolerance: float = 1e-4) -> Model:
    """docs: distinct feature hashes of each; grades: 0..K.

    Only few features get a weight, so steps are taken over those that have one or whose gradient passes the penalty;
    when these rest, all others are looked at, and those that pass it now join them, until none does.
    """
    levels = int(grades.max())
    seen = np.zeros(1 << 24, np.uint8)  # by 24 bits of the hash: an upper bound of how many texts have a feature
    place = lambda d: (d >> np.uint64(40)).astype(np.int64)
    for d in docs:
        at = np.unique(place(d))
        seen[at] += seen[at] < least_docs
    docs = [d[seen[place(d)] >= least_docs] for d in docs]
    flat = np.concatenate(docs) if docs else np.empty(0, np.uint64)
    vocabulary, column, df = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    keep = df >= least_docs
    inside = keep[column]
    row, column, vocabulary = row[inside], (np.cumsum(keep) - 1)[column[inside]], vocabulary[keep]
    n, v = len(docs), len(vocabulary)
    y = (grades[:, None] > np.arange(levels)[None]).astype(float)
    scale = 1 / np.sqrt(np.bincount(column, minlength=v).clip(1) / n)  # rare words may move as fast as frequent ones
    share = np.where(grades > 0, 0.5 / max(1, (grades > 0).sum()), 0.5 / max(1, (grades == 0).sum()))
    w, theta = np.zeros(v), np.log(((1 - y).mean(0) + 1e-3) / (y.mean(0) + 1e-3))
    active, joined = np.zeros(v, bool), np.zeros(v, int)
    for _ in range(ROUNDS):
        s = np.bincount(row, weights=(w * scale)[column], minlength=n)
        gap = (1 / (1 + np.exp(np.clip(theta[None] - s[:, None], -50, 50))) - y) * share[:, None]
        pull = np.abs(np.bincount(column, weights=gap.sum(1)[row], minlength=v) * scale)
        joining = (pull > penalty * 1.05) & ~active
        if not joining.any() and active.any():
            break
        if not joining.any():  # nothing tells the grades apart
            return Model(vocabulary[:0], w[:0], theta)
        if joining.sum() > JOINING:  # those that pull most first
            joining &= pull >= np.partition(pull[joining], -JOINING)[-JOINING]
        joined += joining
        active = (w != 0) | joining | (joined > 1)
        number, some = np.cumsum(active) - 1, active[column]
        w[active], theta = _descend(row[some], number[column[some]], scale[active], y, share, w[active], theta, penalty, steps, tolerance)
    used = w != 0
    return Model(vocabulary[used], (w * scale)[used], theta)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of the labels that have both."""
    return labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("grade"))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Model | None:
    """batches: (grade, distinct feature hashes), in any order."""
    rows = sorted(r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    known = np.array([grade for grade, _ in rows])
    if not len(known) or known.min() == known.max():
        return None
    return fit([np.frombuffer(words, "<u8") for _, words in rows], known)


def learn(docs: DataFrame, grades: DataFrame, sample_rows: int = 4000) -> Model | None:
    """Fit on at most sample_rows rows of grades (doc_id, grade) and the texts of these documents."""
    prepare(docs.sparkSession)
    counts = {r["t"]: r["n"] for r in grades.groupBy((F.col("grade") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    toxic = min(counts[True], sample_rows // 2)
    chance = F.when(F.col("grade") > 0, toxic / counts[True]).otherwise(min(1.0, (sample_rows - toxic) / counts[False]))
    chosen = grades.where(place < chance).groupBy("doc_id").agg(F.max("grade").alias("grade"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([np.unique(features(texts[i].as_py())).astype("<u8").tobytes()], pa.binary())], names=["grade", "words"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("grade").alias("grade"), F.min_by("text", F.xxhash64("text")).alias("text"))
    return fitted(found.select("grade", "text").mapInArrow(run, "grade int, words binary"), _fit_rows)


def grade(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The operator: the columns in `keep` (doc_id by default) with severity, grade and p_toxic, for each row."""
    prepare(docs.sparkSession)
    keep = checked(keep or ["doc_id"], ["severity", "grade", "p_toxic"])
    columns, at_text = text_last(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at_text)
            above = [model.above(features(texts[i].as_py())) if model is not None else np.zeros(1) for i in range(batch.num_rows)]
            severity = [float(p.sum()) for p in above]
            likely = [int((p >= 0.5).sum()) for p in above]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(severity, pa.float64()), pa.array(likely, pa.int32()), pa.array([float(p[0]) for p in above], pa.float64())], names=[*keep, "severity", "grade", "p_toxic"])

    return docs.select(*columns).mapInArrow(run, with_columns(docs, keep, "severity double, grade int, p_toxic double"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, severity, grade, p_toxic and toxic (grade above 0) for every document."""
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, graded(table(spark, sf_dir, "labels")))
    return grade(docs, model).withColumn("toxic", F.col("grade") > 0)
