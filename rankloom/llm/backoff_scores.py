"""Language-model scoring: stupid backoff over word pairs, with count tables partitioned by hash.

The model is counted over the very documents it scores, so a document's own counts are left out of its score. For a word w after c:

    (n(c w) - own(c w)) / (n(c .) - own(c .))          if another document has the pair
    ALPHA * max(n(w) - own(w), 1) / N                   otherwise

The first word follows a start mark. A document's score is the mean logarithm over its words.

1. Word counts: words are hashed (48 bits), counted per slice of text and summed by Spark. The most frequent words, a fixed number of
   them, are numbered and broadcast with their counts; all others are joined by hash.
2. Pairs: each slice is exploded into its pairs per document with their counts; the rows of a slice for one bucket travel as one row of array
   columns, sorted by the first word. The bucket is a hash of the first word; frequent first words of very many pairs
   are spread by the second word too, their totals being known from step 1. Pairs are counted per bucket and joined to the rows there.
3. Pairs of no other document go on to the bucket of their word and are joined to the word counts, unless the word is a frequent one.
4. The sums of a bucket go, as rows of arrays too, to the bucket of their documents and are added up there.

The number of buckets grows with the number of words, so that a bucket's size does not. A pair has one row per document at most.

Defined results: a text without words (null, empty, white space) has zero words and a null score; rows that share an id are one document;
rows without an id count in the model and are not scored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import picked, slices, texts_of, words_of
from rankloom.llm.simhash_groups import stored

ALPHA = 0.4
BUCKET_WORDS = 2_500_000
PAIR_SLICE = 8 << 20
MASK = (1 << 48) - 1
LEAST = 1 << 24  # of a hash; numbers of frequent words are below
START = LEAST  # the start mark in place of a hash
NO_ID = -(2**63)
FREQUENT = 100_000  # words that are broadcast
SLICE_DOCS = 30_000  # documents of a slice, which are numbered by small integers
# a word is three small integers, of which two are zero or nearly so for frequent words; a document is its place in ``docs``
ENTRY = "w0 array<smallint>, w1 array<smallint>, w2 array<smallint>, doc array<smallint>, m array<int>, own array<int>, docs array<long>"
PAIRS = f"bucket int, c0 array<smallint>, c1 array<smallint>, c2 array<smallint>, own_first array<int>, {ENTRY}"
SUMS = "bucket int, docs array<long>, sums array<double>, words array<long>"
LEFT = f"bucket int, {ENTRY}, sum_docs array<long>, sums array<double>, words array<long>"


def word_hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.array([max(xxhash.xxh64_intdigest(w, 5) & MASK, LEAST + 1) for w in words], np.uint64)


def bucket_of(first: np.ndarray, second: np.ndarray | int, buckets: int) -> np.ndarray:
    x = (first + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(second, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0x94D049BB133111EB) >> np.uint64(33)).astype(np.int64) % buckets


def split48(h: np.ndarray) -> list[np.ndarray]:
    return [(h >> np.uint64(16 * k)).astype(np.uint16).view(np.int16) for k in range(3)]


def joined48(*parts: np.ndarray) -> np.ndarray:
    return sum((p.view(np.uint16).astype(np.uint64) << np.uint64(16 * k) for k, p in enumerate(parts)), np.uint64(0))


@dataclass
class Frequent:
    """The most frequent words: their hashes in order, the number each got, and by number the occurrences and those with a word after."""

    hashes: np.ndarray
    numbers: np.ndarray
    n: np.ndarray
    n_first: np.ndarray

    def numbered(self, h: np.ndarray) -> np.ndarray:
        """Hashes with those of frequent words replaced by their numbers, which are smaller than any hash."""
        at = np.searchsorted(self.hashes, h).clip(max=len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], h)


def frequent_words(counts: DataFrame, most: int) -> Frequent:
    top = counts.orderBy(F.desc("n"), "word").limit(most).toPandas()
    h = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return Frequent(h[order], order.astype(np.uint64), top["n"].to_numpy(np.int64), (top["n"] - top["n_last"]).to_numpy(np.int64))


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n, n_last`` for the hash of every word of ``text``: occurrences, and those that end a text. The start mark begins each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PAIR_SLICE):
            words = words_of(texts_of(part, "text"))
            h = np.append(word_hashes(words.distinct), np.uint64(START))
            ends = np.cumsum(words.counts)[words.counts > 0] - 1
            n = np.append(np.bincount(words.ids, minlength=len(words.distinct)), len(ends))
            last = np.append(np.bincount(words.ids[ends], minlength=len(words.distinct)), 0)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(last)], names=["word", "n", "n_last"])

    counts = docs.select("text").mapInArrow(run, "word long, n long, n_last long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_last").alias("n_last"))


def lists(values: np.ndarray, cuts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values))


def pair_blocks(docs: DataFrame, buckets: int, shared: Broadcast, wide_from: int) -> DataFrame:
    """The pairs of each slice of text, one row per bucket. Pairs of frequent first words with over ``wide_from`` pairs are dealt by both words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent: Frequent = shared.value
        short = (b.slice(at, SLICE_DOCS) for b in batches for at in range(0, b.num_rows, SLICE_DOCS))
        for part in slices(short, "text", PAIR_SLICE):
            words = words_of(texts_of(part, "text"))
            if not len(words.ids):
                continue
            names = part.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
            local, names = pd.factorize(names)
            n, v = len(names), len(words.distinct)
            h = frequent.numbered(np.append(word_hashes(words.distinct), np.uint64(START)))
            begins = np.append(True, words.doc[1:] != words.doc[:-1])
            first = np.where(begins, v, np.append(v, words.ids[:-1]))
            doc = local[words.doc].astype(np.int64)
            key, m = np.unique((first * (v + 1) + words.ids) * n + doc, return_counts=True)
            doc, pair = key % n, key // n
            first, second = pair // (v + 1), pair % (v + 1)

            def own(word: np.ndarray, doc: np.ndarray = doc, m: np.ndarray = m, n: int = n) -> np.ndarray:
                at, _ = pd.factorize(word * n + doc)
                return np.bincount(at, weights=m)[at].astype(np.int32)

            known = h < LEAST
            wide = np.zeros(len(h), bool)
            wide[known] = frequent.n_first[h[known].astype(np.int64)] > wide_from
            bucket = bucket_of(h[first], np.where(wide[first], h[second], 0), buckets)
            order = np.argsort(bucket, kind="stable")
            used, at = np.unique(bucket[order], return_index=True)
            cuts = np.append(at, len(order))
            rows = {"bucket": pa.array(used.astype(np.int32))} | {f"c{k}": lists(x, cuts) for k, x in enumerate(split48(h[first][order]))}
            rows |= {"own_first": lists(own(first)[order], cuts)} | {f"w{k}": lists(x, cuts) for k, x in enumerate(split48(h[second][order]))}
            # documents of a row are numbered by themselves, so that a row carries the ids of its own documents only
            numbers, ids = [], []
            for a, b in zip(cuts, cuts[1:]):
                number, own_docs = pd.factorize(doc[order[a:b]])
                numbers.append(number.astype(np.int16))
                ids.append(names[own_docs])
            rows |= {"doc": lists(np.concatenate(numbers), cuts), "m": lists(m[order].astype(np.int32), cuts), "own": lists(own(second)[order], cuts),
                     "docs": lists(np.concatenate(ids), np.cumsum([0, *map(len, ids)]))}
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    return docs.select("doc_id", "text").mapInArrow(run, PAIRS)


def flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column, and how many each row has."""
    chunks = [c for c in table.column(name).chunks if len(c)]
    if not chunks:
        return np.zeros(0, table.schema.field(name).type.value_type.to_pandas_dtype()), np.zeros(0, np.int64)
    return (np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]),
            np.concatenate([np.diff(c.offsets.to_numpy()) for c in chunks]).astype(np.int64))


def column(table: pa.Table, name: str) -> np.ndarray:
    return flat(table, name)[0]


def documents(table: pa.Table) -> np.ndarray:
    """Document id of each entry of block rows."""
    (doc, many), (ids, own) = flat(table, "doc"), flat(table, "docs")
    return ids[doc.astype(np.int64) + np.repeat(np.cumsum(own) - own, many)]


def per_document(doc: np.ndarray, sums: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, ids = pd.factorize(doc)
    return ids, np.bincount(at, weights=sums, minlength=len(ids)).astype(float), np.bincount(at, weights=words, minlength=len(ids)).astype(np.int64)


def pair_join(table: pa.Table, frequent: Frequent, buckets: int, total: int, alpha: float) -> pa.Table:
    """Count the pairs of a bucket and join the counts to its rows: sums of documents, and the pairs left over by word bucket."""
    first, second = (joined48(*[column(table, f"{x}{k}") for k in range(3)]) for x in "cw")
    m, own, own_first, doc = column(table, "m"), column(table, "own"), column(table, "own_first"), documents(table)
    pair, _ = pd.factorize(first * np.uint64(0x9E3779B97F4A7C15) ^ (second + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    n = np.bincount(pair, weights=m)[pair]
    group, names = pd.factorize(first)
    sizes = np.bincount(group, weights=m)
    known = names < LEAST
    sizes[known] = frequent.n_first[names[known].astype(np.int64)]
    seen, common = n > m, second < LEAST
    value = np.zeros(len(m))
    value[seen] = m[seen] * (np.log(n[seen] - m[seen]) - np.log(sizes[group[seen]] - own_first[seen]))
    back = common & ~seen
    value[back] = word_terms(frequent.n[second[back].astype(np.int64)], m[back], own[back], total, alpha)
    done = seen | common
    ids, sums, words = per_document(doc[done], value[done], m[done])
    left = np.flatnonzero(~done)
    bucket = bucket_of(second[left], 0, buckets)
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    cuts = np.append(at, len(order))
    order = left[order]
    # rows of at most SLICE_DOCS documents
    cuts = np.unique(np.concatenate([cuts, np.arange(0, len(order), SLICE_DOCS)])).astype(np.int64) if len(order) else cuts
    used = bucket_of(second[order[cuts[:-1]]], 0, buckets) if len(order) else used
    docs = [pd.factorize(doc[order[a:b]]) for a, b in zip(cuts, cuts[1:])]
    ends = np.append(cuts, len(order))  # the last row has sums only
    tail = np.append(np.zeros(len(cuts), np.int64), len(ids))
    here = int(table.column("bucket")[0].as_py())
    numbers, names_ = ([x[k] for x in docs] for k in range(2))
    columns = {"bucket": pa.array([*used.tolist(), here], pa.int32())} | {f"w{k}": lists(x, ends) for k, x in enumerate(split48(second[order]))}
    columns |= {"doc": lists(np.concatenate([np.zeros(0, np.int16), *numbers]).astype(np.int16), ends), "m": lists(m[order], ends), "own": lists(own[order], ends),
                "docs": lists(np.concatenate([np.zeros(0, np.int64), *names_]).astype(np.int64), np.cumsum([0, *map(len, names_), 0])),
                "sum_docs": lists(ids, tail), "sums": lists(sums, tail), "words": lists(words, tail)}
    return pa.table(columns)


def word_terms(n: np.ndarray, m: np.ndarray, own: np.ndarray, total: int, alpha: float) -> np.ndarray:
    """Logarithms for pairs that no other document has."""
    return m * (np.log(alpha) + np.log(np.maximum(n - own, 1)) - np.log(total))


def word_join(blocks: pa.Table, counts: pa.Table, buckets: int, total: int, alpha: float) -> pa.Table:
    """Join the pairs left over to the counts of their words; sums per document of the bucket, one row for each bucket of documents."""
    word = joined48(*[column(blocks, f"w{k}") for k in range(3)]).astype(np.int64)
    m, own, doc = column(blocks, "m"), column(blocks, "own"), documents(blocks)
    names, n = counts.column("word").to_numpy(), counts.column("n").to_numpy()
    order = np.argsort(names)
    at = order[np.searchsorted(names, word, sorter=order)] if len(word) else np.zeros(0, np.int64)
    value = word_terms(n[at], m, own, total, alpha) if len(word) else np.zeros(0)
    ids, sums, words = per_document(np.concatenate([doc, column(blocks, "sum_docs")]), np.concatenate([value, column(blocks, "sums")]),
                                    np.concatenate([m, column(blocks, "words")]))
    bucket = bucket_of(ids.view(np.uint64), 0, buckets)
    order = np.argsort(bucket, kind="stable")
    used, at = np.unique(bucket[order], return_index=True)
    cuts = np.append(at, len(order))
    return pa.table({"bucket": pa.array(used, pa.int32()), "docs": lists(ids[order], cuts), "sums": lists(sums[order], cuts), "words": lists(words[order], cuts)})


def add_up(blocks: pa.Table) -> pa.Table:
    """The sums of each document of a bucket."""
    ids, sums, words = per_document(column(blocks, "docs"), column(blocks, "sums"), column(blocks, "words"))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "log_score": pa.array(sums, pa.float64()), "n_words": pa.array(words, pa.int64())})


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, bucket_words: int = BUCKET_WORDS, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, log_score, score`` of every document with an id."""
    texts = picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    counts = stored(word_counts(texts), "word-counts")
    total = counts.where(F.col("word") != START).agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // bucket_words))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(counts, frequent))
    # a first word of more than a quarter of a bucket is dealt by both words
    pairs = pair_blocks(texts, buckets, shared, total // (4 * buckets))
    left = pairs.groupBy("bucket").applyInArrow(lambda t: pair_join(t, shared.value, buckets, total, alpha), LEFT)

    def bucket(word: pd.Series) -> pd.Series:
        return pd.Series(bucket_of(word.to_numpy(np.int64).view(np.uint64), 0, buckets).astype(np.int32))

    keyed = counts.withColumn("bucket", F.pandas_udf(bucket, "int")("word"))
    parts = left.groupBy("bucket").cogroup(keyed.groupBy("bucket")).applyInArrow(lambda a, b: word_join(a, b, buckets, total, alpha), SUMS)
    sums = parts.groupBy("bucket").applyInArrow(add_up, "doc_id long, log_score double, n_words long")
    zero = texts.select("doc_id", F.lit(0.0).alias("log_score"), F.lit(0).cast("long").alias("n_words")).where(F.col("doc_id").isNotNull())
    rows = sums.where(F.col("doc_id") != NO_ID).unionByName(zero).groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("log_score").alias("log_score"))
    return rows.select("doc_id", "n_words", "log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).alias("score"))
