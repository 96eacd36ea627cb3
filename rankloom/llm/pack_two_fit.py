"""Best-two-fit packing of tokenised documents into sequences of bounded length.

1. Documents are tokenised and cut into pieces (Arrow function, no shuffle).
2. Pieces of full length are sequences of their own. For the others only their *number per length* matters to the packing, a table
   of at most ``capacity - 1`` rows however many documents there are; it is aggregated by Spark and packed on the driver.
   A bin is filled greedily (largest length that fits); then its smallest document is replaced by two unpacked ones that fit the
   widened gap more tightly. A filled bin is a pattern of lengths, used as often as the remaining counts allow at once.
3. The packing is a table of rank ranges per length. Pieces get their rank among those of the same length by counts per (length,
   bucket), so a length that holds most pieces is still spread over tasks, and look their place up by a join on (length, rank).

Defined results: null and empty texts are one piece with the end token alone; ties between pieces of one length go by id; repeated rows are packed
each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.batches import picked, slices
from rankloom.llm.simhash_groups import stored

CAPACITY = 1024
END_ID = 2
CACHE_ENTRIES = 200_000
BUCKET_ROWS = 200_000
# White space that a cut at single spaces would tokenise otherwise: a space inside or at the end of a run of white space.
ODD_SPACE = re.compile(r"\s \s|\s $")


class TextTokenizer:
    """Ids of a byte-level BPE tokenizer file.

    A piece "space + word" is tokenised the same wherever it stands, so ids are kept per piece. New pieces are encoded with the
    file's own vocabulary by tiktoken, which gives the same ids several times faster; texts with special tokens or odd runs of
    spaces go through ``tokenizers`` whole.
    """

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in visible)}
        self.special = [t["content"] for t in content["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in content["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: of byte-level BPE files
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def packed_ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special) or ODD_SPACE.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        first, *rest = text.split(" ")
        out = []
        for piece in ([first] if first else []) + [" " + w for w in rest]:
            ids = known.get(piece)
            if ids is None:
                ids = known[piece] = np.array(self.fast.encode_ordinary(piece), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``input_ids``. Only the first piece of a cut document may be shorter."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = TextTokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for part in slices(batches, "text"):
            rows: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = tokenizer.packed_ids(text or "") + end
                total = len(ids) // 4
                start, length = 0, total % capacity or min(total, capacity)
                piece = 0
                while start < total:
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), np.frombuffer(own, "<i4") if keep_ids else None))
                    start, length, piece = start + length, capacity, piece + 1
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:5])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                arrays.append(pa.array(columns[5], pa.list_(pa.int32())))
                names.append("input_ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", input_ids array<int>" if keep_ids else "")
    return picked(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, schema)


def two_fit_patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Bins as (lengths, how many bins of this kind), for a number of pieces per length."""
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    out: list[tuple[list[int], int]] = []

    def largest(limit: int, used: dict[int, int]) -> int | None:
        """The largest length up to ``limit`` of which a piece is left."""
        k = bisect_right(lengths, limit) - 1
        while k >= 0 and left[lengths[k]] - used.get(lengths[k], 0) <= 0:
            k -= 1
        return lengths[k] if k >= 0 else None

    def best_two(limit: int, used: dict[int, int]) -> tuple[int, int] | None:
        """Two lengths left with the largest sum up to ``limit``."""
        have = [n for n in lengths if n < limit and left[n] - used.get(n, 0) > 0]
        best, pair = 0, None
        a, b = 0, len(have) - 1
        while a <= b:
            total = have[a] + have[b]
            if total > limit:
                b -= 1
                continue
            if total > best and (a != b or left[have[a]] - used.get(have[a], 0) > 1):
                best, pair = total, (have[a], have[b])
            a += 1
        return pair

    while lengths:
        used: dict[int, int] = {}
        bin_: list[int] = []
        gap = capacity
        while (n := largest(gap, used)) is not None:
            bin_.append(n)
            used[n] = used.get(n, 0) + 1
            gap -= n
        while gap > 0 and len(bin_) > 1:
            smallest = min(bin_)
            used[smallest] -= 1
            pair = best_two(gap + smallest, used)
            if pair is None or sum(pair) <= smallest:
                used[smallest] += 1
                break
            bin_.remove(smallest)
            bin_ += pair
            for n in pair:
                used[n] = used.get(n, 0) + 1
            gap += smallest - sum(pair)
        times = min(left[n] // k for n, k in used.items() if k)
        out.append((sorted(bin_, reverse=True), times))
        for n, k in used.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n] > 0]
    return out


def slot_ranges(patterns: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int]]:
    """``length, rank_from, rank_to, sequence_from, offset``: pieces of a length with these ranks go to these sequences."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            rank = taken.get(n, 0)
            out.append((n, rank, rank + times, sequence, offset))
            taken[n] = rank + times
            offset += n
        sequence += times
    return out


def ranked(pieces: DataFrame, buckets: int) -> DataFrame:
    """Add ``rank``, from 0, among the pieces of one length, without gathering a length in one task."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return dealt.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("own")).drop("bucket", "own", "first")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces; ``pieces`` is read several times."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    full = counts.pop(capacity, 0)
    ranges = slot_ranges([*([([capacity], full)] if full else []), *two_fit_patterns(counts, capacity)])
    schema = "length long, rank_from long, rank_to long, sequence_from long, offset long"
    slots = spark.createDataFrame(ranges, schema)  # bounded: patterns end lengths, and there are at most ``capacity`` lengths
    buckets = max(1, (full + sum(counts.values())) // BUCKET_ROWS)
    rows = ranked(pieces, 1 + 8 * buckets)
    fits = (rows["length"] == slots["length"]) & (rows["rank"] >= slots["rank_from"]) & (rows["rank"] < slots["rank_to"])
    return rows.join(F.broadcast(slots), fits).select(
        *(rows[c] for c in pieces.columns), (slots["sequence_from"] + rows["rank"] - slots["rank_from"]).alias("sequence_id"), slots["offset"])


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
                   text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place: ``doc_id, piece, start, length, ids_crc32[, input_ids], sequence_id, offset``."""
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    return place_pieces(pieces, capacity)


def packed_sequences(placed: DataFrame) -> DataFrame:
    """``sequence_id, input_ids, doc_starts`` from placed pieces with ids; a sequence holds at most ``capacity`` ids."""
    cells = F.array_sort(F.collect_list(F.struct("offset", "input_ids")))
    return placed.groupBy("sequence_id").agg(cells.alias("cells")).select(
        "sequence_id", F.flatten("cells.input_ids").alias("input_ids"), F.col("cells.offset").alias("doc_starts"))
