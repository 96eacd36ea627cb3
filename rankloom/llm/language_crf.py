"""Language identification by a linear-chain conditional random field over the words of a text.

Every word with a letter gets a label, so code-switched text is labelled word by word: emissions come from affixes, byte n-grams and a
lexicon, transitions are learned, labels are scored by forward-backward. The language of a text is the label with the
largest sum of marginals, its score their mean.

Training takes runs of words of a bounded sample of documents with a known language; runs of different documents are spliced, so that
sequences switch language, and the conditional likelihood is raised by AdaGrad. For scoring, words are cut into blocks: products of
transition matrices per block, a scan over the blocks of each text, then forward and backward inside all blocks at once; this is exact
for any length.

Defined results: ``und`` with score 0 for a null text or one without a letter, and for every text if nothing could be learned.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import picked, slices, texts_of
from rankloom.llm.labelled import fold, sampled

UND = "und"
RUN = 24
BLOCK = 32
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_LETTER = re.compile(rb"[a-z\x80-\xff]")
_GRAM = 1 << 16
_BINS = (0.02, 0.2, 0.6, 0.95)


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, distinct word of each word, distinct words) of the lower-case words that have a letter."""
    split = [t.lower().encode().split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for ws in split for w in ws]
    ids, distinct = pd.factorize(flat)
    good = np.array([_LETTER.search(w) is not None for w in distinct], bool)
    keep = good[ids] if len(ids) else np.zeros(0, bool)
    return np.repeat(np.arange(len(texts)), counts)[keep], ids[keep], distinct


def has_letter(text: str) -> bool:
    return re.search("[A-Za-z]", text) is not None or any(c.isalpha() for c in text)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint32(15))
    x = x * np.uint32(2246822519)
    return x ^ (x >> np.uint32(13))


@dataclass
class Features:
    """Hashed features of distinct words: pairs of (feature, word)."""

    lexicon: dict[bytes, list[int]]  # word to lexicon features
    unknown: int

    @property
    def size(self) -> int:
        return self.unknown + 1

    def of(self, words: Iterable[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        words = [w.strip(PUNCTUATION) for w in words]
        n = len(words)
        size = np.fromiter((len(w) + 2 for w in words), np.int64, n)
        a = np.frombuffer(b"".join(b"^" + w + b"$" for w in words) + b"\0\0", np.uint8).astype(np.uint32)
        ends = np.cumsum(size)
        starts = ends - size
        owner = np.repeat(np.arange(n), size)
        two, three = a[:-2] * np.uint32(256) + a[1:-1], _mix(a[:-2] * np.uint32(65536) + a[1:-1] * np.uint32(256) + a[2:])
        place = np.arange(len(owner)) - starts[owner]
        out = []
        for value, width, base in ((two, 2, 0), (three, 3, 1)):
            fits = place <= size[owner] - width
            out.append((base * _GRAM + (value[fits] & np.uint32(_GRAM - 1)).astype(np.int64), owner[fits]))
        for width in (4, 5):
            long = np.flatnonzero(size >= width)
            for side, first in enumerate((starts[long], ends[long] - width)):
                code = np.full(len(long), 17 * width + side, np.uint32)
                for k in range(width):
                    code = code * np.uint32(16777619) ^ a[first + k]
                out.append((2 * _GRAM + (_mix(code) & np.uint32(_GRAM - 1)).astype(np.int64), long))
        known = [self.lexicon.get(w, (self.unknown,)) for w in words]
        many = np.fromiter(map(len, known), np.int64, n)
        out.append((np.fromiter((f for fs in known for f in fs), np.int64, int(many.sum())), np.repeat(np.arange(n), many)))
        return out

    def emissions(self, words: Iterable[bytes], weights: np.ndarray) -> np.ndarray:
        parts, n = self.of(words), len(words)
        out = np.zeros((n, weights.shape[1]))
        for feature, owner in parts:
            for k in range(weights.shape[1]):
                out[:, k] += np.bincount(owner, weights=weights[feature, k], minlength=n)
        return out


def marginals(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Posterior label shares of each word. ``first`` marks the first word of a chain; a chain starts from even shares."""
    n, k = emission.shape
    if not n:
        return np.zeros((0, k))
    step = np.exp(transition - transition.max())
    x = np.exp(emission - emission.max(1, keepdims=True))
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    blocks = -(-size // block)
    block_start = np.cumsum(blocks) - blocks
    chain = np.repeat(np.arange(len(start)), size)
    place = np.arange(n) - start[chain]
    row, column = block_start[chain] + place // block, place % block
    total = int(blocks.sum())
    grid, used = np.ones((total, block, k)), np.zeros((total, block), bool)
    grid[row, column], used[row, column] = x, True

    def scaled(v: np.ndarray) -> np.ndarray:
        return v / v.reshape(len(v), -1).sum(1).reshape(-1, *[1] * (v.ndim - 1))

    through = np.broadcast_to(np.eye(k), (total, k, k)).copy()  # of a whole block
    for t in range(block):
        moved = scaled((through.reshape(-1, k) @ step).reshape(total, k, k) * grid[:, t, None, :])
        through = np.where(used[:, t, None, None], moved, through)
    enter, leave = np.empty((total, k)), np.empty((total, k))
    order = np.argsort(-blocks, kind="stable")
    sorted_blocks = blocks[order]
    alive = lambda j: order[:np.searchsorted(-sorted_blocks, -j, side="left")]  # noqa: E731  chains of more than j blocks
    vector = np.full((len(start), k), 1 / k)
    longest = int(blocks.max())
    for j in range(longest):
        c = alive(j)
        b = block_start[c] + j
        enter[b] = vector[c]
        vector[c] = scaled(np.einsum("ni,nij->nj", vector[c], through[b]))
    vector = np.full((len(start), k), 1 / k)
    for j in range(longest - 1, -1, -1):
        c = alive(j)
        b = block_start[c] + j
        leave[b] = vector[c]
        vector[c] = scaled(np.einsum("nij,nj->ni", through[b], vector[c]))
    ahead, forward = enter, np.empty((total, block, k))
    for t in range(block):
        ahead = np.where(used[:, t, None], scaled((ahead @ step) * grid[:, t]), ahead)
        forward[:, t] = ahead
    back = leave
    for t in range(block - 1, -1, -1):
        forward[:, t] *= back
        back = np.where(used[:, t, None], scaled((back * grid[:, t]) @ step.T), back)
    out = forward[row, column]
    return out / out.sum(1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    features: Features
    weights: np.ndarray
    transition: np.ndarray

    def word_labels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, label shares) of every word with a letter."""
        doc, ids, distinct = letter_words(texts)
        if not len(doc):
            return doc, np.zeros((0, len(self.languages)))
        emission = self.features.emissions(distinct, self.weights)
        first = np.append(True, doc[1:] != doc[:-1])
        return doc, marginals(emission[ids], first, self.transition)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.languages:
            return [UND] * n, np.zeros(n)
        doc, shares = self.word_labels(texts)
        words = np.bincount(doc, minlength=n)
        mean = np.column_stack([np.bincount(doc, weights=s, minlength=n) for s in shares.T]) / np.maximum(words, 1)[:, None]
        best = mean.argmax(1)
        known = np.array([w > 0 and has_letter(t) for w, t in zip(words, texts)], bool)
        return [self.languages[b] if k else UND for b, k in zip(best, known)], np.where(known, mean[np.arange(n), best].clip(0, 1), 0.0)


def spliced(runs: pd.DataFrame, rng: np.random.Generator, length: int = 48) -> list[tuple[list[bytes], list[int]]]:
    """Training sequences of whole runs and of parts of runs, in random order, so that languages change inside a sequence."""
    pieces = []
    for words, label in zip(runs["words"], runs["label"]):
        words = [bytes(w) for w in words]
        cut = int(rng.integers(3, RUN)) if rng.random() < 0.5 else len(words)
        pieces += [(p, label) for p in (words[:cut], words[cut:]) if p]
    out: list[tuple[list[bytes], list[int]]] = []
    words, labels = [], []
    for i in rng.permutation(len(pieces)):
        words, labels = words + pieces[i][0], labels + [pieces[i][1]] * len(pieces[i][0])
        if len(words) >= length:
            out.append((words[:length], labels[:length]))
            words, labels = words[length:], labels[length:]
    if words:
        out.append((words, labels))
    return out


def fit_crf(sequences: list[tuple[list[bytes], list[int]]], features: Features, n_labels: int, rounds: int = 3, batch: int = 64, rate: float = 0.3,
            ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features and log-transitions that raise the conditional likelihood of the label sequences."""
    weights, transition = np.zeros((features.size, n_labels)), np.zeros((n_labels, n_labels))
    seen_w, seen_t = np.full(weights.shape, 1e-6), np.full(transition.shape, 1e-6)
    rng = np.random.default_rng(1)
    for _ in range(rounds):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), batch):
            part = [sequences[i] for i in order[at:at + batch]]
            words = [w for ws, _ in part for w in ws]
            labels = np.array([x for _, ls in part for x in ls])
            size = np.array([len(ws) for ws, _ in part])
            first = np.zeros(len(words), bool)
            first[np.cumsum(size) - size] = True
            pairs = features.of(words)
            emission = np.zeros((len(words), n_labels))
            for feature, owner in pairs:
                np.add.at(emission, owner, weights[feature])
            shares = marginals(emission, first, transition)
            error = -shares
            error[np.arange(len(words)), labels] += 1
            touched = np.unique(np.concatenate([f for f, _ in pairs]))
            slot = np.zeros(features.size, np.int64)
            slot[touched] = np.arange(len(touched))
            gradient = np.zeros((len(touched), n_labels))
            for feature, owner in pairs:
                np.add.at(gradient, slot[feature], error[owner])
            gradient = gradient / len(part) - ridge * weights[touched]
            seen_w[touched] += gradient**2
            weights[touched] += rate * gradient / np.sqrt(seen_w[touched])
            # expected transitions, from the marginals of neighbours through the pair posterior
            inside = np.flatnonzero(~first)
            expected = pair_shares(emission, first, transition)[inside].sum(0)
            observed = np.zeros_like(transition)
            np.add.at(observed, (labels[inside - 1], labels[inside]), 1)
            gradient_t = (observed - expected) / len(part) - 1e-3 * transition
            seen_t += gradient_t**2
            transition += rate * gradient_t / np.sqrt(seen_t)
    return weights, transition


def pair_shares(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Posterior of (label before, label) for each word, by forward-backward word by word over chains side by side."""
    n, k = emission.shape
    step = np.exp(transition - transition.max())
    x = np.exp(emission - emission.max(1, keepdims=True))
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    forward, back = np.empty((n, k)), np.ones((n, k))
    for t in range(int(size.max())):
        at = start[size > t] + t
        before = np.full((len(at), k), 1 / k) if t == 0 else forward[at - 1]
        v = (before @ step) * x[at]
        forward[at] = v / v.sum(1, keepdims=True)
    for t in range(int(size.max()) - 2, -1, -1):
        at = start[size > t + 1] + t
        v = (back[at + 1] * x[at + 1]) @ step.T
        back[at] = v / v.sum(1, keepdims=True)
    out = np.zeros((n, k, k))
    inside = np.flatnonzero(~first)
    out[inside] = forward[inside - 1][:, :, None] * step[None] * (x[inside] * back[inside])[:, None, :]
    out[inside] /= out[inside].sum((1, 2), keepdims=True)
    return out


def lexicon_of(counts: pd.DataFrame, n_labels: int) -> Features:
    """Lexicon features (label, bin of the word's share in that label) from rows ``word, label, n``."""
    table: dict[bytes, np.ndarray] = {}
    for word, label, n in zip(counts["word"], counts["label"], counts["n"]):
        table.setdefault(bytes(word), np.zeros(n_labels))[label] += n
    base = 3 * _GRAM
    bins = len(_BINS) + 1
    lexicon = {w: [base + k * bins + int(b) for k, b in enumerate(np.searchsorted(_BINS, v / v.sum()))] for w, v in table.items()}
    return Features(lexicon, base + n_labels * bins)


def fit_languages(docs: DataFrame, skip_fold: tuple[int, int] = (4, 2), max_docs: int = 4000, max_runs: int = 3000, max_lexicon: int = 40_000) -> LanguageModel:
    """Learn from ``doc_id, text, lang``, outside the fold that is left out.

    Bounds: about ``max_docs`` documents, ``max_runs`` runs of words for each language, ``max_lexicon`` lexicon entries.
    """
    docs = picked(docs, doc_id="doc_id", text="text", lang="lang")
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", skip_fold[0]) != skip_fold[1]))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], lexicon_of(pd.DataFrame({"word": [], "label": [], "n": []}), 1), np.zeros((0, 0)), np.zeros((0, 0)))
    each = max(50, max_docs // len(languages))
    share = F.coalesce(*[F.when(F.col("lang") == k, sampled(each, n, "doc_id", seed=3)) for k, n in sizes.items()])
    label = F.coalesce(*[F.when(F.col("lang") == k, F.lit(i)) for i, k in enumerate(languages)])
    sample = known.where(share).select("doc_id", "text", label.alias("label"))

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            doc, ids, distinct = letter_words(texts_of(part, "text"))
            label = part.column("label").to_numpy(zero_copy_only=False)
            names = part.column("doc_id").to_numpy(zero_copy_only=False)
            rows = []
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
            for i in range(part.num_rows):
                own = distinct[ids[ends[i]:ends[i + 1]]].tolist()
                rows += [(names[i], at, int(label[i]), own[at:at + RUN]) for at in range(0, len(own), RUN)]
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary())))], names=["doc_id", "at", "label", "words"])

    rows = sample.mapInArrow(runs, "doc_id long, at long, label int, words array<binary>")
    # runs with small hashes, rather more than wanted; the smallest are picked from them
    numbers = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    few = F.coalesce(*[F.when(F.col("label") == k, sampled(2 * max_runs, n, "doc_id", "at", seed=5)) for k, n in numbers.items()], F.lit(False))
    chosen = rows.where(few).select("doc_id", "at", "label", "words", F.xxhash64("doc_id", "at", F.lit(5)).alias("h")).toPandas()
    chosen = chosen.sort_values(["h", "doc_id", "at"]).groupby("label", sort=False).head(max_runs).drop(columns="h")
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word", "label").agg(F.count("*").alias("n"))
    counts = counts.where("n > 2").orderBy(F.desc("n"), "word", "label").limit(max_lexicon).toPandas()
    chosen = chosen.sort_values(["doc_id", "at"], ignore_index=True)
    counts["word"] = [bytes(w).strip(PUNCTUATION) for w in counts["word"]]
    features = lexicon_of(counts, len(languages))
    weights, transition = fit_crf(spliced(chosen, np.random.default_rng(0)), features, len(languages))
    return LanguageModel(languages, features, weights, transition)


def predicted_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            names, score = shared.value.predict(texts_of(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def labelled_words(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, labels``: the language of each word with a letter, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.languages, object)
        for part in slices(batches, "text"):
            doc, shares = shared.value.word_labels(texts_of(part, "text"))
            ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
            best = names[shares.argmax(1)] if len(doc) else np.zeros(0, object)
            lists = pa.array([best[a:b].tolist() for a, b in zip(ends, ends[1:])], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], names=["doc_id", "labels"])

    return picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, labels array<string>")
