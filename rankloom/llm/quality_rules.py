"""Quality rules: hard limits, then gradient-boosted trees over document statistics.

The trees are fitted on the driver from the statistics of a bounded sample of labelled documents, then flattened into numpy node arrays
that score a whole batch level by level. Splits on a constrained feature may only move the score in the given direction.

Defined results: null and empty texts have zero statistics and fail the limits; very long texts are read whole; without labels of both
classes the trees are a constant and only the limits decide.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from rankloom.llm.batches import numbered, rows_per_doc, slices, texts_of, words_of
from rankloom.llm.labelled import MAX_LABELLED, labelled_sample

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Features of the trees; +1: the score may not fall as the feature grows, -1: it may not rise.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0,
    "upper_share": 0, "digit_share": 0, "punct_share": -1, "high_share": 0, "line_words": 0, "symbol_words": -1, "stop_share": 0,
}
_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((string.ascii_uppercase, string.digits, string.punctuation), 1):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = 4


def repeated_words(doc: np.ndarray, ids: np.ndarray, n_docs: int, width: int = 3) -> np.ndarray:
    """Words per text that lie in a window of ``width`` words found twice or more in that text."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    code = ids[:n]
    for k in range(1, width):
        code, _ = pd.factorize(code * (int(ids.max()) + 1) + ids[k:n + k])
        code = code.astype(np.int64)
    inside = doc[:n] == doc[width - 1:]
    windows = np.flatnonzero(inside)
    keys, _ = pd.factorize(code[windows] * n_docs + doc[windows])
    again = windows[np.bincount(keys)[keys] > 1]
    marked = np.zeros(len(ids), bool)
    for k in range(width):
        marked[again + k] = True
    return np.bincount(doc[marked], minlength=n_docs)


def statistics(texts: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics and the feature matrix of some texts."""
    words = words_of(texts)
    n = words.n_docs
    chars = np.array([len(t) - sum(t.count(c) for c in " \t\n\v\f\r") for t in texts], np.int64)
    symbols = np.array([sum(t.count(c) for c in SYMBOLS) for t in texts], np.int64)
    dup_lines, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        own = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        lines[i], dup_lines[i] = len(own), len(own) - len(set(own))
    repeat = repeated_words(words.doc, words.ids, n)
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    kinds = _CLASS[np.frombuffer(b"".join(raw), np.uint8)]
    byte_doc = np.repeat(np.arange(n), size)
    share = np.bincount(byte_doc * 5 + kinds, minlength=5 * n).reshape(n, 5) / np.maximum(size, 1)[:, None]
    odd = np.array([sum(w.count(c) for c in (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!!")) > 0 for w in words.distinct], bool) if len(words.distinct) else np.zeros(0, bool)
    short = np.array([len(w) <= 3 for w in words.distinct], bool) if len(words.distinct) else np.zeros(0, bool)
    distinct = np.bincount(pd.unique(words.doc * (len(words.distinct) + 1) + words.ids) // (len(words.distinct) + 1), minlength=n)
    count = np.maximum(words.counts, 1)
    base = dict(zip(BASE, (words.counts, chars, symbols, dup_lines, repeat)))
    matrix = np.column_stack([
        np.log1p(words.counts), chars / count, symbols / np.maximum(chars, 1), dup_lines / np.maximum(lines, 1), repeat / count, distinct / count,
        share[:, 1], share[:, 2], share[:, 3], share[:, 4], words.counts / np.maximum(lines, 1),
        rows_per_doc(odd[words.ids], words.doc, n) / count, rows_per_doc(short[words.ids], words.doc, n) / count])
    return base, matrix


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * base["n_words"])


@dataclass
class Trees:
    """Node arrays of all trees: ``left`` of a leaf is the leaf itself."""

    start: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    left: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))
    depth: int = 0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        total = np.full(len(x), self.start)
        row = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[row, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, directions: list[int], rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64,
              least_weight: float = 5.0, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on histograms, with monotonic constraints."""
    mean = float(np.mean(y)) if len(y) else 0.5
    if len(y) == 0 or mean in (0.0, 1.0):
        return Trees(start=5.0 if mean == 1.0 else -5.0 if len(y) and mean == 0.0 else 0.0)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)])
    out = Trees(start=float(np.log(mean / (1 - mean))), depth=depth)
    feature, cut, left, right, value = [], [], [], [], []
    margin = np.full(len(y), out.start)

    def weight(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return -g / (h + ridge)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            node = len(feature)
            own = float(np.clip(weight(g[rows].sum(), h[rows].sum()), low, high))
            feature.append(0), cut.append(np.inf), left.append(node), right.append(node), value.append(rate * own)
            best = (1e-6, -1, -1)
            if level < depth and len(rows) > 1:
                gs, hs = g[rows].sum(), h[rows].sum()
                for f, direction in enumerate(directions):
                    gl = np.cumsum(np.bincount(code[rows, f], g[rows], len(cuts[f]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(code[rows, f], h[rows], len(cuts[f]) + 1))[:-1]
                    gr, hr = gs - gl, hs - hl
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gs**2 / (hs + ridge)
                    bad = (hl < least_weight) | (hr < least_weight)
                    if direction:
                        wl, wr = np.clip(weight(gl, hl), low, high), np.clip(weight(gr, hr), low, high)
                        bad |= direction * (wr - wl) < 0
                    gain = np.where(bad, -1.0, gain)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
            if best[1] >= 0:
                _, f, k = best
                goes = code[rows, f] <= k
                a, b = rows[goes], rows[~goes]
                bounds = [(low, high), (low, high)]
                if directions[f]:
                    middle = float(np.mean([np.clip(weight(g[r].sum(), h[r].sum()), low, high) for r in (a, b)]))
                    bounds = [(low, middle), (middle, high)] if directions[f] > 0 else [(middle, high), (low, middle)]
                feature[node], cut[node] = f, float(cuts[f][k])
                left[node] = grow(a, level + 1, *bounds[0])
                right[node] = grow(b, level + 1, *bounds[1])
            else:
                margin[rows] += value[node]
            return node

        out.roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
    out.feature, out.cut, out.value = np.array(feature, np.int32), np.array(cut), np.array(value)
    out.left, out.right = np.array(left, np.int32), np.array(right, np.int32)
    return out


def fit_quality_trees(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_LABELLED, **options: object) -> Trees:
    """Fit on the statistics of at most ``2 * max_rows`` labelled documents."""
    names = list(FEATURES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            _, matrix = statistics(texts_of(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("label"), *(pa.array(c) for c in matrix.T)], names=["label", *names])

    sample = labelled_sample(docs, labels, label, max_rows).mapInArrow(run, "label int, " + ", ".join(f"{n} double" for n in names)).toPandas()
    sample = sample.sort_values(list(sample.columns), ignore_index=True)
    return fit_trees(sample[names].to_numpy(float), sample["label"].to_numpy(float), list(FEATURES.values()), **options)


def quality_verdicts(docs: DataFrame, trees: Trees, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the base statistics, ``base_failed``, ``quality_score`` and ``kept``, which replace columns of these names."""
    added = {**dict.fromkeys(BASE, "long"), "base_failed": "boolean", "quality_score": "double", "kept": "boolean"}
    keep = [c for c in docs.columns if c not in added]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            base, matrix = statistics(texts_of(part, text_col))
            failed, score = base_failed(base), trees.score(matrix)
            columns = {**{k: pa.array(v.astype(np.int64)) for k, v in base.items()}, "base_failed": pa.array(failed), "quality_score": pa.array(score),
                       "kept": pa.array(~failed & (score >= threshold))}
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *columns.values()], names=[*keep, *columns])

    schema = docs.select(*keep).schema
    for name, kind in added.items():
        schema = schema.add(name, kind)
    return docs.select(*keep).mapInArrow(run, schema)


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", **options: object) -> DataFrame:
    """The documents that pass, with their columns as they are, whatever their names."""
    inner = numbered(docs)
    scored = quality_verdicts(inner, trees, text_col=f"c{docs.columns.index(text_col)}", **options).where("kept")
    return scored.select(*inner.columns).toDF(*docs.columns)
