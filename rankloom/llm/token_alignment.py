"""Alignment of two tokenizers over a corpus: groups of tokens that end together, and how often each pair of token ids is linked.

The tokens of a text by tokenizer A (byte-level BPE) and B (sentence pieces) are laid over its bytes. Offsets where both end cut them into groups;
tokens whose byte ranges overlap are linked. Each stretch between neighbouring ends of either side is exactly one link.

1. A text is encoded once; its groups are digested and its links counted per distinct pair (Arrow function, no shuffle). The result is stored.
2. **Identity map.** For each A id the B id with the same bytes is known beforehand. A group of one A and one B token that the map holds is
   counted in a vector as long as the vocabulary of A. Only pairs of all other groups become rows of the shuffle that adds up pair counts,
   added up per task beforehand.
3. Totals of identity pairs and the highest count of each B id are vectors as long as the vocabularies. Pairs with at least a ``FREQUENT``-th of
   all links, thus ``FREQUENT`` pairs at most, are looked up in the task as well. Links of rarer pairs are joined with their counts;
   no such pair has more than a ``FREQUENT``-th of the links, so no key is hot.

Defined results: a text that is null or empty, or whose tokens of either side do not give back the space and the text byte by byte, has no tokens and
zeros everywhere; repeated rows each count, and each have their own row; null ids stay; an empty table gives an empty result; long texts are encoded
whole and take some hundred bytes a token while they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import picked, slices
from rankloom.llm.pack_two_fit import TextTokenizer
from rankloom.llm.simhash_groups import stored

FREQUENT = 1 << 20
HELD_PAIRS = 1 << 20


def ids_array(lists: list[list[int]]) -> np.ndarray:
    out = np.empty(sum(map(len, lists)), np.int64)
    at = 0
    for ids in lists:
        out[at:at + len(ids)] = ids
        at += len(ids)
    return out


@dataclass
class TokenizerPair:
    """Both tokenizers with the bytes of their tokens, made once in each Python worker from the two file names."""

    path_a: str
    path_b: str

    def __reduce__(self):
        return tokenizer_pair, (self.path_a, self.path_b)  # tasks get the names only

    @cached_property
    def a(self):
        return TextTokenizer(self.path_a).fast

    @cached_property
    def b(self):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path_b)

    @cached_property
    def bytes_a(self) -> list[bytes]:
        known = {self.a._mergeable_ranks[t]: t for t in self.a._mergeable_ranks}
        return [known.get(i, b"") for i in range(max(known) + 1)]

    @cached_property
    def bytes_b(self) -> list[bytes]:
        out = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        return out

    @cached_property
    def identity(self) -> np.ndarray:
        """The B id with the same bytes as each A id, or -1; of several the first that is not a single-byte fallback."""
        of: dict[bytes, int] = {}
        for i in sorted(range(len(self.bytes_b)), key=lambda i: (self.b.is_byte(i), i)):
            if not (self.b.is_control(i) or self.b.is_unknown(i)):
                of.setdefault(self.bytes_b[i], i)
        return np.array([of.get(t, -1) if t else -1 for t in self.bytes_a], np.int64)

    @cached_property
    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))

    @cached_property
    def names(self) -> list[np.ndarray]:
        """Decimal ids followed by what may follow them: A inside and at the end of its side of a group, B likewise."""
        out = []
        for size, mark in ((len(self.bytes_a), b","), (len(self.bytes_a), b"|"), (len(self.bytes_b), b","), (len(self.bytes_b), b";")):
            column = np.empty(size, object)
            column[:] = [b"%d%s" % (i, mark) for i in range(size)]
            out.append(column)
        return out

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides, text after text, and the number of tokens of each text; both 0 where the bytes do not agree."""
        rows_a: list[list[int]] = []
        rows_b: list[list[int]] = []
        for text in texts:
            ids_a: list[int] = []
            ids_b: list[int] = []
            if text:
                ids_a, ids_b = self.a.encode_ordinary(" " + text), self.b.encode(text)
                raw = b" " + text.encode()
                if b"".join([self.bytes_a[i] for i in ids_a]) != raw or b"".join([self.bytes_b[i] for i in ids_b]) != raw:
                    ids_a, ids_b = [], []
            rows_a.append(ids_a)
            rows_b.append(ids_b)
        return ids_array(rows_a), ids_array(rows_b), np.array([len(r) for r in rows_a], np.int64), np.array([len(r) for r in rows_b], np.int64)


@lru_cache(maxsize=2)
def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    return TokenizerPair(path_a, path_b)


@dataclass
class Aligned:
    """Groups and links of several texts laid end to end."""

    n_groups: np.ndarray
    n_links: np.ndarray
    digests: list[str]
    link_doc: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    alone: np.ndarray  # links that are a group of one A and one B token


def align(pair: TokenizerPair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> Aligned:
    docs = len(n_a)
    end_a, end_b = np.cumsum(pair.lengths[0][a]), np.cumsum(pair.lengths[1][b])
    ends = np.union1d(end_a, end_b)
    at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)  # tokens that hold the byte before each end
    both = (end_a[at_a] == ends) & (end_b[at_b] == ends) if len(ends) else np.empty(0, bool)
    alone = both & np.r_[True, both[:-1]][:len(both)]
    doc_a, doc_b = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
    link_doc = doc_a[at_a]
    common = ends[both]
    group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
    last_a, last_b = np.searchsorted(group_a, np.arange(len(common)), "right"), np.searchsorted(group_b, np.arange(len(common)), "right")
    # in the digest a group's A tokens stand before its B tokens
    place_a = np.arange(len(a)) + np.r_[0, last_b][group_a]
    place_b = np.arange(len(b)) + last_a[group_b]
    text = np.empty(len(a) + len(b), object)
    a_ends, b_ends = np.zeros(len(a), bool), np.zeros(len(b), bool)
    a_ends[last_a - 1] = b_ends[last_b - 1] = True
    for ids, place, closing, inner, end in ((a, place_a, a_ends, *pair.names[:2]), (b, place_b, b_ends, *pair.names[2:])):
        text[place] = inner[ids]
        text[place[closing]] = end[ids[closing]]
    bounds = np.r_[0, np.cumsum(n_a + n_b)]
    cells = text.tolist()
    digests = [hashlib.sha256(b"".join(cells[x:y])[:-1]).hexdigest() if y > x else "" for x, y in zip(bounds.tolist(), bounds[1:].tolist())]
    return Aligned(np.bincount(link_doc[both], minlength=docs), np.bincount(link_doc, minlength=docs), digests, link_doc, a[at_a], b[at_b], alone)


def per_text(doc: np.ndarray, key: np.ndarray, width: int, docs: int) -> tuple[list[bytes], list[bytes]]:
    """Distinct keys (below ``width``) of each text and their counts, as bytes."""
    both, n = np.unique(doc * width + key, return_counts=True)
    bounds = np.searchsorted(both, np.arange(docs + 1) * width)
    keys, n = both % width, n.astype(np.int32)
    return [keys[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], [n[x:y].tobytes() for x, y in zip(bounds, bounds[1:])]


def aligned_texts(docs: DataFrame, pair: TokenizerPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256`` and, as bytes, the distinct identity ids and other pairs of each text with their counts."""
    kinds = [pa.int64()] * 5 + [pa.string()] + [pa.binary()] * 4
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "same_n", "other", "other_n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = len(pair.bytes_a), len(pair.bytes_b)
        for part in slices(batches, "text", 1 << 20):
            a, b, n_a, n_b = pair.encoded(part.column("text").to_pylist())
            found = align(pair, a, b, n_a, n_b)
            plain = found.alone & (pair.identity[found.link_a] == found.link_b)
            rest = ~plain
            same = per_text(found.link_doc[plain], found.link_a[plain], size_a, len(n_a))
            other = per_text(found.link_doc[rest], found.link_a[rest] * size_b + found.link_b[rest], size_a * size_b, len(n_a))
            columns = [part.column("doc_id"), n_a, n_b, found.n_groups, found.n_links, found.digests, *same, *other]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same binary, same_n binary, other binary, other_n binary"
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())


def cells_of(batch: pa.RecordBatch, keys: str, counts: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, counts and row in the batch of all cells of two byte columns."""
    blocks = batch.column(keys).to_pylist()
    k = np.frombuffer(b"".join(blocks), np.int64)
    n = np.frombuffer(b"".join(batch.column(counts).to_pylist()), np.int32).astype(np.int64)
    return k, n, np.repeat(np.arange(len(blocks)), [len(x) // 8 for x in blocks])


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
    return code[first], np.add.reduceat(n, first) if len(code) else n


def pair_counts(aligned: DataFrame, pair: TokenizerPair) -> DataFrame:
    """``code, n, is_best``: how many links of the corpus hold each pair (code: A id times the size of B plus B id); best: no pair of its B id has more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(pair.bytes_a), np.int64)
        codes, counts, held = [], [], 0
        for batch in batches:
            ids, n, _ = cells_of(batch, "same", "same_n")
            vector += np.bincount(ids, weights=n, minlength=len(vector)).astype(np.int64)
            code, n, _ = cells_of(batch, "other", "other_n")
            codes, counts, held = [*codes, code], [*counts, n], held + len(code)
            if held > 4 * HELD_PAIRS:
                code, n = summed(codes, counts)
                if len(code) > HELD_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])
                    code, n = code[:0], n[:0]
                codes, counts, held = [code], [n], len(code)
        ids = np.flatnonzero(vector)
        code, n = summed([*codes, ids * len(pair.bytes_b) + pair.identity[ids]], [*counts, vector[ids]])
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], names=["code", "n"])

    totals = stored(aligned.select("same", "same_n", "other", "other_n").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pair-totals")
    b_id = F.col("code") % len(pair.bytes_b)
    best = totals.groupBy(b_id.alias("b_id")).agg(F.max("n").alias("most"))  # the vocabulary of B at most
    return totals.withColumn("b_id", b_id).join(F.broadcast(best), "b_id").select("code", "n", (F.col("n") == F.col("most")).alias("is_best"))


def sorted_arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = counts.select("code", "n", "is_best").toPandas().sort_values("code")
    return tuple(rows[c].to_numpy(t) for c, t in (("code", np.int64), ("n", np.int64), ("is_best", bool)))


def link_sums(aligned: DataFrame, counts: DataFrame, pair: TokenizerPair, frequent: int = FREQUENT) -> DataFrame:
    """``row, n_best, count_sum`` over the links of each text. ``aligned`` and ``counts`` are stored tables."""
    spark = aligned.sparkSession
    size_b = len(pair.bytes_b)
    mapped = np.flatnonzero(pair.identity >= 0)
    codes = spark.createDataFrame(pd.DataFrame({"code": mapped * size_b + pair.identity[mapped]}))  # the vocabulary of A at most
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = sorted_arrays(counts.where(F.col("n") * F.lit(frequent).cast("decimal(38,0)") >= F.lit(total).cast("decimal(38,0)")))
    by_code = sorted_arrays(counts.join(F.broadcast(codes), "code"))
    vectors = np.zeros((2, len(pair.identity)), np.int64)
    vectors[:, by_code[0] // size_b] = by_code[1], by_code[2]
    shared = spark.sparkContext.broadcast((common, vectors))

    def known(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(shared.value[0][0], code), max(0, len(shared.value[0][0]) - 1))
        return at, (shared.value[0][0][at] == code) if len(shared.value[0][0]) else np.zeros(len(code), bool)

    def lookup(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            ids, n, row = cells_of(batch, "same", "same_n")
            np.add.at(sums[0], row, n * shared.value[1][0][ids])
            np.add.at(sums[1], row, n * shared.value[1][1][ids])
            code, n, row = cells_of(batch, "other", "other_n")
            at, hit = known(code)
            at, n, row = at[hit], n[hit], row[hit]
            np.add.at(sums[0], row, n * shared.value[0][1][at])
            np.add.at(sums[1], row, n * shared.value[0][2][at])
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sums[1]), pa.array(sums[0])], names=["row", "n_best", "count_sum"])

    def seldom(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, n, row = cells_of(batch, "other", "other_n")
            rest = ~known(code)[1]
            rows = batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(rows[row[rest]]), pa.array(code[rest]), pa.array(n[rest])], names=["row", "code", "m"])

    near = aligned.select("row", "same", "same_n", "other", "other_n").mapInArrow(lookup, "row long, n_best long, count_sum long")
    rare = aligned.select("row", "other", "other_n").mapInArrow(seldom, "row long, code long, m long").join(counts, "code").select(
        "row", F.when(F.col("is_best"), F.col("m")).otherwise(0).alias("n_best"), (F.col("m") * F.col("n")).alias("count_sum"))
    return near.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Per text ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and the table of ``pair_counts``."""
    pair = tokenizer_pair(path_a, path_b)
    aligned = stored(aligned_texts(docs, pair, id_col, text_col), "aligned")
    counts = stored(pair_counts(aligned, pair), "pair-counts")
    sums = link_sums(aligned, counts, pair, frequent)
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row").join(sums, "row").drop("row"), counts
