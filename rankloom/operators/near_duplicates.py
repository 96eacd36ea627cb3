"""Near-duplicate texts by 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions.text import hamming, similarity
from rankloom.operators.skew import salted_join

BUCKET_ROWS = 20_000
VOTES = 100_000
SLICE_WORDS = 200_000


def word_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Record batches cut to about ``SLICE_WORDS`` entries of their lists ``words``; one longer list is a slice of its own."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column("words")).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + SLICE_WORDS, "right")))
            yield batch.slice(start, end - start)
            start = end


def fingerprints(docs: DataFrame, text: Column, key: str = "url") -> DataFrame:
    """Fingerprint per document (``key``, ``fp``): the sign of the vote of all its tokens for each bit.

    Tokens are voted on inside their row (Arrow function, no shuffle): the first 64 bits of a token's md5 are taken once per slice of
    a batch, of ``SLICE_WORDS`` tokens or one longer text, so that memory does not grow with the batch.
    Documents without a token have no fingerprint. Each row is a document of its own.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]{3,})"), F.lit(1))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in word_slices(batches):
            counts = pc.list_value_length(part.column("words")).to_numpy()
            found = part.column("words").flatten().dictionary_encode()
            digests = b"".join([md5(w.encode(), usedforsecurity=False).digest()[:8] for w in found.dictionary.to_pylist()])
            bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
            index, out, at = found.indices.to_numpy(), np.zeros(len(counts), np.int64), 0
            for i, n in enumerate(counts.tolist()):
                if n:
                    ones = np.zeros(64, np.int64)
                    for k in range(at, at + n, VOTES):  # a long text some tokens at a time
                        ones += bits[index[k:min(k + VOTES, at + n)]].sum(axis=0, dtype=np.int64)
                    out[i] = np.packbits(2 * ones > n).view(">i8")[0]
                at += n
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(out)], names=[key, "fp"])

    rows = docs.select(key, F.coalesce(words, F.array().cast("array<string>")).alias("words"))
    return rows.mapInArrow(vote, docs.select(key).schema.add("fp", "long")).where("fp <> 0")


def groups(prints: DataFrame, key: str = "url") -> DataFrame:
    """Distinct fingerprints with their first document and size."""
    return prints.groupBy("fp").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("members"))


def exact_duplicates(prints: DataFrame, key: str = "url") -> DataFrame:
    """Documents with the fingerprint of an earlier one, each tied to the first of its group.

    One row per copy: a group of many copies gives no pairs among the copies.
    """
    shared = groups(prints, key).where("members > 1")
    rows = salted_join(prints, shared, ["fp"], F.col(key))
    return rows.where(F.col(key) != F.col("first")).select(F.col("first").alias("url_a"), F.col(key).alias("url_b"), "fp", "members")


def block_masks(distance: int) -> list[int]:
    """Bit masks such that two fingerprints within the distance agree on at least one of them.

    The 64 bits are cut into ``distance + 3`` blocks. At most ``distance`` blocks can differ, so some three
    blocks agree; every choice of three gives one mask of 30 bits or more (for a distance of 3).
    """
    n = distance + 3
    edges = [round(i * 64 / n) for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [a | b | c for a, b, c in combinations(blocks, 3)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def candidate_pairs(distinct: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs of distinct fingerprints that agree on a mask, each pair once (``fp_a < fp_b``).

    Candidates meet in a join on (mask, masked bits); a pair that agrees on several masks is kept only for the
    first of them, which spares a second shuffle to remove repeats. A crowded bucket is split: its left rows are dealt to
    parts of at most ``BUCKET_ROWS`` rows and its right rows copied to each. Both sides are shuffled: each fingerprint stands
    in them once per mask, which is more than the driver can hold.
    """
    masks = block_masks(distance)
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(masks)])
    keyed = distinct.select("fp", F.explode(bands).alias("k")).select("fp", "k.band", "k.bits")
    left = keyed.select(F.col("fp").alias("fp_a"), "band", "bits")
    right = keyed.select(F.col("fp").alias("fp_b"), "band", "bits")
    pairs = salted_join(left, right, ["band", "bits"], F.col("fp_a"), hot_rows=BUCKET_ROWS, shuffled=True).where("fp_a < fp_b")
    agree = F.array(*[F.col("fp_a").bitwiseXOR(F.col("fp_b")).bitwiseAND(F.lit(m)) == 0 for m in masks])
    return pairs.where(F.array_position(agree, F.lit(True)) == F.col("band") + 1).select("fp_a", "fp_b")


def near_pairs(prints: DataFrame, distance: int = 3, key: str = "url") -> DataFrame:
    """Pairs of different fingerprints within the distance, named by the first document of each group."""
    distinct = groups(prints, key)
    close = candidate_pairs(distinct.select("fp"), distance).where(hamming(F.col("fp_a"), F.col("fp_b")) <= distance)
    a = distinct.select(F.col("fp").alias("fp_a"), F.col("first").alias("_a"), F.col("members").alias("_na"))
    b = distinct.select(F.col("fp").alias("fp_b"), F.col("first").alias("_b"), F.col("members").alias("_nb"))
    rows = close.join(a, "fp_a").join(b, "fp_b")
    swapped = F.col("_a") > F.col("_b")
    d = hamming(F.col("fp_a"), F.col("fp_b"))
    return rows.select(
        F.least("_a", "_b").alias("url_a"), F.greatest("_a", "_b").alias("url_b"),
        F.when(swapped, F.col("_nb")).otherwise(F.col("_na")).alias("members_a"),
        F.when(swapped, F.col("_na")).otherwise(F.col("_nb")).alias("members_b"),
        d.alias("hamming_distance"), similarity(F.col("fp_a"), F.col("fp_b")).alias("similarity"),
        F.when(d <= 1, "exact").when(d <= 3, "near_duplicate").otherwise("similar").alias("risk_level"),
    )


def duplicate_summary(prints: DataFrame, near: DataFrame) -> DataFrame:
    """Documents, document pairs with equal prints and pairs of near prints, counted from group sizes.

    The pairs themselves are never formed: n members give n(n-1)/2 pairs, two close groups give the product of sizes.
    """
    equal = groups(prints).agg(
        F.sum("members").alias("documents"), F.sum(F.col("members") * (F.col("members") - 1) / 2).cast("bigint").alias("equal_pairs"))
    product = F.col("members_a") * F.col("members_b")
    zero = F.lit(0).cast("bigint")
    close = near.agg(
        F.sum(F.when(F.col("risk_level") == "exact", product)).alias("equal_pairs"),
        F.sum(F.when(F.col("risk_level") == "near_duplicate", product)).alias("near_duplicates"))
    parts = equal.withColumn("near_duplicates", zero).unionByName(close.withColumn("documents", zero))
    out = parts.agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in ("documents", "equal_pairs", "near_duplicates")])
    return out.select("documents", (F.col("equal_pairs") + F.col("near_duplicates")).alias("duplicate_pairs"),
                      F.col("equal_pairs").alias("exact_duplicates"), "near_duplicates")
