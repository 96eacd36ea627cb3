"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window is a word in its place: the text's words, lower-cased, with the space around them. Windows are compressed twice, with a
dictionary of ordinary text and with one that starts with toxic text; the bytes the second saves are the window's gain. Lengths are whole
bytes, too coarse for short words, so windows and dictionaries are written in a context code first: two bytes for each three letters in
a row. A match then needs the same letters in the same context, and one more letter saves two bytes.

- The toxic text is what marks toxic documents: word starts found in a far larger share of toxic than of ordinary documents of the
  labelled sample. The ordinary text is the most frequent words of ordinary documents. Both dictionaries are trained by zstandard;
  where it refuses, for too few samples, the text itself is the dictionary.
- A window that shares no run of two codes with the toxic dictionary cannot gain and is not compressed.
- Thresholds on the gains (how many windows reach each, how large a share, the largest) are calibrated on the labelled sample into a
  probability.

Defined results: a null or empty text has no window and gets the calibrated score of no gain; very long texts are read whole; repeated rows
get equal scores; without both classes among the labels every score is the share of class 1, or 0 without labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import picked, rows_per_doc, slices, texts_of, words_of
from rankloom.llm.labelled import MAX_LABELLED, labelled_sample

LEVEL, MIN_MATCH = 6, 5
TOXIC_BYTES, ORDINARY_BYTES = 2048, 8192
ORDINARY_WORDS = 3000
SHORTEST, LONGEST = 4, 10  # bytes of a word start
CARRIER = b"\n and so it is that \n "  # both dictionaries end with it, so that no window is stored uncompressed
TOP_GAIN = 12


def codes(data: bytes) -> np.ndarray:
    """Two-byte code of each three bytes in a row."""
    a = np.frombuffer(data, np.uint8).astype(np.uint32)
    x = a[:-2] * np.uint32(2654435761) + a[1:-1] * np.uint32(320748517) + a[2:] * np.uint32(2246822519)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2654435769)
    return (x >> np.uint32(16)).astype("<u2")


def coded_words(words: Iterable[bytes]) -> list[bytes]:
    return [codes(b"\n " + w + b" ").tobytes() for w in words]


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on samples, or the end of the samples where they are too few to train on."""
    text = b"".join(samples)[-size:]
    if len(text) >= size:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return text


def word_starts(word: bytes) -> list[bytes]:
    return [word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)]


def toxic_starts(table: dict[bytes, tuple[int, int]], n0: int, n1: int, least: int, ratio: float) -> dict[bytes, int]:
    """Word starts that mark toxic documents, as long as half of the documents of their shortest form allow."""
    marks = lambda p: table[p][1] >= least and (table[p][1] + 0.5) / n1 > ratio * (table[p][0] + 0.5) / n0
    longer: dict[bytes, list[bytes]] = {}
    for p in table:
        longer.setdefault(p[:-1], []).append(p)
    out: dict[bytes, int] = {}
    for p in table:
        if not marks(p) or any(marks(q) for q in word_starts(p[:-1]) if q in table):
            continue
        first = q = p
        while nexts := [x for x in longer.get(q, []) if table[x][1] >= 0.5 * table[first][1]]:
            q = max(nexts, key=lambda x: (table[x][1], x))
        out[q] = table[first][1]
    return out


@dataclass
class Gains:
    """The two dictionaries."""

    toxic: bytes
    ordinary: bytes
    _tools: tuple | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {"toxic": self.toxic, "ordinary": self.ordinary, "_tools": None}

    def tools(self) -> tuple:
        if self._tools is None:
            setting = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_content_size=False)
            carrier = codes(CARRIER).tobytes()
            make = lambda b: zstandard.ZstdCompressor(
                compression_params=setting, dict_data=zstandard.ZstdCompressionDict(b + carrier, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            run = np.frombuffer(self.toxic[:len(self.toxic) // 2 * 2], "<u2").astype(np.uint32)
            off = np.frombuffer(self.toxic[1:1 + (len(self.toxic) - 1) // 2 * 2], "<u2").astype(np.uint32)
            pairs = np.unique(np.concatenate([(r[:-1] << np.uint32(16)) | r[1:] for r in (run, off)]))
            # ordinary text comes last in both, at the same distance
            self._tools = make(self.toxic + self.ordinary), make(self.ordinary), pairs, carrier
        return self._tools

    def of(self, words: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves for each distinct word."""
        gains = np.zeros(len(words), np.int64)
        toxic, ordinary, pairs, carrier = self.tools()
        if not len(words) or not len(pairs):
            return gains
        size = np.fromiter((len(w) + 3 for w in words), np.int64, len(words))
        ends = np.cumsum(size)
        code = codes(b"".join(b"\n " + w + b" " for w in words) + b"\0\0")
        pair = (code[:-1].astype(np.uint32) << np.uint32(16)) | code[1:]
        found = np.flatnonzero(pairs[np.searchsorted(pairs, pair).clip(max=len(pairs) - 1)] == pair)
        owner = np.searchsorted(ends, found, side="right")
        inside = owner < len(words)
        for w in np.unique(owner[inside]):
            start = ends[w] - size[w]
            data = carrier + code[start:ends[w] - 2].tobytes()
            gains[w] = len(ordinary.compress(data)) - len(toxic.compress(data))
        return gains

    def features(self, texts: list[str]) -> np.ndarray:
        words = words_of(texts, lower=True)
        n = words.n_docs
        gain = self.of(words.distinct)[words.ids].clip(0, TOP_GAIN)
        counts = np.bincount(words.doc * (TOP_GAIN + 1) + gain, minlength=n * (TOP_GAIN + 1)).reshape(n, TOP_GAIN + 1)[:, 2:]
        top = np.zeros(n)
        np.maximum.at(top, words.doc, gain)
        size = np.maximum(words.counts, 1)[:, None]
        at_least = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        mean = rows_per_doc(gain, words.doc, n) / size[:, 0]
        return np.column_stack([np.log1p(counts), np.log1p(at_least), 50 * counts / size, top, top >= 6, mean, np.log1p(words.counts)])


@dataclass
class Curve:
    """Logistic regression on scaled features."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    shift: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(((x - self.center) / self.scale) @ self.weights + self.shift, -30, 30)))


def calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 5.0, rounds: int = 40) -> Curve:
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.append(np.full(len(w) - 1, ridge), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Curve(center, scale, w[:-1], float(w[-1]))


@dataclass
class ToxicityModel:
    gains: Gains | None
    curve: Curve | None
    share: float = 0.0

    def score(self, texts: list[str]) -> np.ndarray:
        if self.gains is None or self.curve is None:
            return np.full(len(texts), self.share)
        return self.curve.score(self.gains.features(texts))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", skip_fold: tuple[int, int] = (4, 2), max_rows: int = MAX_LABELLED,
                 least: int = 10, ratio: float = 6.0) -> ToxicityModel:
    """Learn from at most ``2 * max_rows`` labelled documents outside the fold that is left out.

    ``least``: documents of a toxic word start; ``ratio``: how much larger its share among toxic documents is.
    """
    sample = labelled_sample(docs, labels, label, max_rows, skip_fold)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(None, None, 1.0 if n1 else 0.0)
    least = max(4, min(least, n1 // 8))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found: Counter[tuple[bytes, int, bool]] = Counter()
            for text, kind in zip(texts_of(part, "text"), part.column("label").to_pylist()):
                own = set(text.encode().lower().split())
                starts = {s for w in own for s in word_starts(w)}
                found.update((s, kind, False) for s in starts)
                if kind == 0:
                    found.update((w, kind, True) for w in own)
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.bool_()))] + [pa.array([found[k] for k in keys], pa.int64())],
                names=["piece", "label", "whole", "n"])

    found = sample.mapInArrow(count, "piece binary, label int, whole boolean, n long").groupBy("piece", "whole").agg(
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"))
    common = found.where("whole").orderBy(F.desc("n0"), "piece").limit(ORDINARY_WORDS).toPandas()
    starts = found.where(~F.col("whole") & (F.col("n1") >= least // 2)).toPandas()
    table = {bytes(p): (int(a), int(b)) for p, a, b in zip(starts["piece"], starts["n0"], starts["n1"])}
    marked = toxic_starts(table, n0, n1, least, ratio)
    ordinary = coded_words(bytes(p) for p in common["piece"][::-1])
    toxic = coded_words(p for p, _ in sorted(marked.items(), key=lambda x: (x[1], x[0])))
    gains = Gains(trained(toxic, TOXIC_BYTES), trained(ordinary, ORDINARY_BYTES))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            values = pa.array(list(gains.features(texts_of(part, "text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), values], names=["doc_id", "label", "x"])

    rows = sample.mapInArrow(measure, "doc_id long, label int, x array<double>").toPandas().sort_values("doc_id", ignore_index=True)
    return ToxicityModel(gains, calibrated(np.array(rows["x"].tolist()), rows["label"].to_numpy(float)))


def toxicity_scores(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(texts_of(part, "text")))], names=["doc_id", "score"])

    return picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, score double")
