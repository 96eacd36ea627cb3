"""Quality classifier: Naive Bayes support vectors.

Each text has binary indicators of hashed n-grams in two views: its words (unigrams) and the shapes of its words (up to three in a row;
a shape keeps the kind of each character run and the punctuation itself). Indicators are scaled by their class log-count ratio, rows have
length one, and a linear hinge-loss model is fitted by dual coordinate descent. Margins become probabilities by a logistic curve.

Log-count ratios are counted by Spark over all labelled documents of the training folds, in a table of ``2**BITS`` buckets; the
model is fitted on a bounded sample of them.

Defined results: a null or empty text has no indicator but the bias and gets the score of the bias; without both classes the score is
the share of class 1, or 0.5 without labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import picked, slices, texts_of, words_of
from rankloom.llm.decontaminate import bounded
from rankloom.llm.labelled import MAX_LABELLED, fold, known_labels, labelled_sample

BITS = 18
BUCKETS = 1 << BITS
_LOWER, _UPPER, _DIGIT = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[A-Z]+"), re.compile(rb"[0-9]+")


def shape_of(word: bytes) -> bytes:
    return _DIGIT.sub(b"0", _LOWER.sub(b"a", _UPPER.sub(b"A", word)))


def indicators(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every distinct indicator of some texts, ordered by text."""
    words = words_of(texts)
    if not len(words.ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word_bucket = np.array([xxhash.xxh64_intdigest(w, 1) & (BUCKETS - 1) for w in words.distinct], np.int64)
    shapes, names = pd.factorize(np.array([shape_of(w) for w in words.distinct], object))
    shape_hash = np.array([xxhash.xxh64_intdigest(s, 2) for s in names], np.uint64)
    parts = [words.doc * BUCKETS + word_bucket[words.ids]]
    code = shape_hash[shapes][words.ids]
    rolling = code
    for k in range(3):
        if k:
            rolling = rolling[:-1] * np.uint64(0x9E3779B97F4A7C15) + code[k:]
        inside = words.doc[:len(rolling)] == words.doc[k:]
        parts.append(words.doc[:len(rolling)][inside] * BUCKETS + ((rolling ^ (rolling >> np.uint64(29)))[inside] & np.uint64(BUCKETS - 1)).astype(np.int64))
    keys = np.sort(np.concatenate([pd.unique(p) for p in parts]))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return keys >> BITS, keys & (BUCKETS - 1)


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, ratio included
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, doc: np.ndarray, bucket: np.ndarray, scale: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(doc, weights=scale[bucket] ** 2, minlength=n))
        return np.bincount(doc, weights=self.weights[bucket], minlength=n) / np.maximum(norm, 1e-12) + self.bias


@dataclass
class Scorer:
    model: Model
    ratio: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        doc, bucket = indicators(texts)
        margin = self.model.margins(doc, bucket, self.ratio, len(texts))
        return 1 / (1 + np.exp(-np.clip(self.model.slope * margin + self.model.shift, -30, 30)))


def log_count_ratios(docs: DataFrame, alpha: float = 1.0) -> np.ndarray:
    """log of (share of class 1 / share of class 0) of every bucket, from all rows ``text, label``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for part in slices(batches, "text"):
            label = part.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            doc, bucket = indicators(texts_of(part, "text"))
            counts += np.bincount(label[doc] * BUCKETS + bucket, minlength=2 * BUCKETS).reshape(2, BUCKETS)
        used = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["bucket", "n0", "n1"])

    table = docs.mapInArrow(run, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    counts = np.full((2, BUCKETS), alpha)
    for k, name in enumerate(("n0", "n1")):
        counts[k, table["bucket"]] += table[name]
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine for sparse rows (columns, values of length one)."""
    w, b = np.zeros(size), 0.0
    alpha = np.zeros(len(y))
    rng = np.random.default_rng(seed)
    diagonal = np.array([v @ v for _, v in rows]) + 1.0
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            columns, values = rows[i]
            gradient = y[i] * (values @ w[columns] + b) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[columns] += step * y[i] * values
                b += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, b


def logistic_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve for margins and labels 0, 1, by Newton steps with smoothed targets."""
    n1, n0 = (y > 0.5).sum(), (y <= 0.5).sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + c, -30, 30)))
        d, h = p - target, p * (1 - p) + 1e-9
        grad = np.array([(d * margin).sum() + 1e-3 * a, d.sum()])
        hess = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, c = a - step[0], c - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(c)


def fit(sample: pd.DataFrame, ratio: np.ndarray, cost: float = 1.0) -> Scorer:
    """Fit on rows ``label, buckets``; a fifth of them calibrates the probabilities."""
    y = sample["label"].to_numpy(int)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return Scorer(Model(np.zeros(BUCKETS), 0.0, 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3)))), ratio)
    rows = []
    for buckets in sample["buckets"]:
        values = ratio[buckets]
        rows.append((np.asarray(buckets), values / max(1e-12, float(np.sqrt(values @ values)))))
    held = np.arange(len(y)) % 5 == 0
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held[:] = False
    signs = np.where(y == 1, 1.0, -1.0)
    per_class = len(y) / 2 / np.bincount(y, minlength=2)
    train = np.flatnonzero(~held)
    w, b = dual_coordinate_descent([rows[i] for i in train], signs[train], cost * np.sqrt(per_class[y[train]]), BUCKETS)
    margin = np.array([v @ w[c] + b for c, v in rows])
    check = held if held.any() else ~held
    slope, shift = logistic_curve(margin[check], y[check].astype(float))
    return Scorer(Model(w * ratio, b, slope, shift), ratio)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", skip_fold: tuple[int, int] = (3, 1), max_rows: int = MAX_LABELLED) -> Scorer:
    """Learn from labelled documents outside the fold that is left out."""
    known = known_labels(labels, label).where(fold("doc_id", skip_fold[0]) != skip_fold[1])
    ratio = log_count_ratios(picked(docs, doc_id="doc_id", text="text").join(bounded(known, known.count()), "doc_id").select("text", "label"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, bucket = indicators(texts_of(part, "text"))
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), lists], names=["doc_id", "label", "buckets"])

    sample = labelled_sample(docs, labels, label, max_rows, skip_fold).mapInArrow(run, "doc_id long, label int, buckets array<int>").toPandas()
    return fit(sample.sort_values("doc_id", ignore_index=True), ratio)


def quality_scores(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(texts_of(part, "text")))], names=["doc_id", "score"])

    return picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")
