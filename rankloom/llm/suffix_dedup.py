"""Removal of long repeated strings: suffix arrays over buckets of text, by deep-shallow sorting.

A byte goes when a string of ``length`` bytes that covers it also starts in a document with a smaller id. All strings of that length in the whole
corpus are looked at, none are stored one by one:

1. **Slices.** Texts are written once as compressed slices of some megabytes, which later passes read. A slice sends each bucket one row, so that
   the rows that travel stay few.
2. **Anchors.** Each string is dealt by its anchor, the ``GRAM`` bytes in it with the smallest hash (the leftmost of equals). The anchor depends on
   the string alone, so equal strings have equal anchors. Of each slice the hashes of its anchors go to their bucket, as short sorted codes,
   and a bit for each comes back: does another document have that anchor? Where none has, no string with it occurs twice.
3. **Contexts.** Neighbouring strings mostly share an anchor and travel together as one context of ``length`` bytes and a few more. Only
   contexts with a shared anchor travel; of equal contexts in a slice those of the smallest id, the others are repeats already.
4. **Suffix array of a bucket.** The suffixes that start at the strings of a bucket are sorted to ``SHALLOW`` bytes by multikey quicksort, eight
   bytes to a key; groups that are still together are ordered by blind tries, built level by level for all groups at once: the members skip to the
   first byte where any of them differs and branch on it. Contexts equal to one of a smaller id are repeats as a whole and need no sort; strings with
   different anchors, or the anchor elsewhere, start in different groups. Groups together at ``length`` bytes are equal strings; the smallest id in it keeps them.
   A bucket that would be too large (anchors with very many contexts) is dealt string by string instead, by a hash of the whole string, so
   that only equal strings must meet, and of these one a slice and document.
5. Repeats go back to their slice and are cut out there.

Defined results: null and empty texts have no bytes and the hash of nothing; texts shorter than ``length`` stay; rows without an id neither lose bytes
nor make others lose any; rows of one id do not repeat each other; an empty table gives an empty result; long texts are handled whole, in one
task each, which takes about sixty bytes of memory a byte.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import picked, slices
from rankloom.llm.simhash_groups import stored

LENGTH = 50
GRAM = 24  # bytes of an anchor; 16 in strings of under 40 bytes
SHALLOW = 16
PART_BYTES = 16 << 20
LARGE_BYTES = 64 << 20  # of contexts; larger buckets are dealt string by string
SLICE_BYTES = 8 << 20
PIECE = 1 << 16  # positions hashed at a time
HELD = 1 << 18  # contexts held as bytes at a time
CODE_BITS = 28
CHUNK = 1 << 20
MIX = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
BLOCK = {"part": pa.int32(), "sub": pa.int32(), "slice": pa.int64(), **{k: pa.binary() for k in ("text", "n", "anchor", "owner", "start", "docs", "numbers")}}
BLOCK_ROWS = ", ".join(f"{k} {({pa.int32(): 'int', pa.int64(): 'long'}).get(t, 'binary')}" for k, t in BLOCK.items())
SPANS_OF_SLICE = -1  # ``sub`` of rows that have spans found within a slice
SPANS = ("slice", "number", "lo", "hi")


def words_at(raw: bytes, order: str) -> np.ndarray:
    """The eight bytes from each position on as an integer; ``raw`` must not be shorter."""
    return np.ndarray((len(raw) - 7,), f"{order}u8", buffer=raw, strides=(1,))


def gram_of(length: int) -> int:
    return GRAM if length >= 40 else 16


def gram_hashes(words: np.ndarray, at: np.ndarray | slice, gram: int) -> np.ndarray:
    """Hashes of the ``gram`` bytes (16 or 24) from some places on. ``words``: the eight bytes from each place on."""
    first, second = words[at], words[8:][at]
    x = (first * MIX[0]) ^ ((second ^ (first >> np.uint64(29))) * MIX[1])
    if gram > 16:
        x = (x ^ (x >> np.uint64(31)) ^ words[16:][at]) * MIX[0]
    x = (x ^ (x >> np.uint64(32))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def contexts(raw: bytes, ends: np.ndarray, length: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``first, n, anchor, hash`` of each context: strings ``first .. first + n - 1`` share the anchor at ``anchor``. Texts end at ``ends``; some may be left out."""
    gram, none = gram_of(length), tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    valid = np.zeros(max(0, len(raw) - length + 1), bool)  # strings that lie in one text
    begins = np.r_[0, ends[:-1]]
    long_ = ends - begins >= length
    if known is not None:
        long_ &= known
    for x, y in zip(begins[long_].tolist(), ends[long_].tolist()):
        valid[x:y - length + 1] = True
    words, found, before, last = words_at(raw.ljust(8, b"\0"), "<"), [], 0, (-2, -1)
    for a in range(0, len(valid), PIECE):
        b = min(a + PIECE, len(valid))
        inside = np.flatnonzero(valid[a:b])
        if not len(inside):
            continue
        stop = b + length - gram
        hashes = gram_hashes(words, slice(a, stop), gram)
        places = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(stop - a, dtype=np.uint64)
        anchor = (sliding_min(places, length - gram + 1)[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.r_[(a + inside[0], a + anchor[0]) != (last[0] + 1, last[1]), (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)])
        found.append((a + inside[new], before + new, a + anchor[new], hashes[anchor[new]]))
        before, last = before + len(inside), (a + int(inside[-1]), a + int(anchor[-1]))
    if not found:
        return none
    first, number, anchor, hashes = (np.concatenate(x) for x in zip(*found))
    return first, np.diff(np.r_[number, before]), anchor, hashes


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


@cache
def compressor(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def packed(values: np.ndarray | bytes, level: int = 3) -> bytes:
    return compressor(level).compress(values.tobytes() if isinstance(values, np.ndarray) else values)


def unpacked(cell: bytes, kind: object) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), kind)


def text_slices(docs: DataFrame) -> DataFrame:
    """``slice, ids, sizes, raw`` from ``doc_id, text``: the texts of a slice end to end, compressed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", SLICE_BYTES):
            texts = [(t or "").encode() for t in piece.column("text").to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([piece.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([packed(sizes)], pa.binary()),
                                              pa.array([packed(b"".join(texts), 6)], pa.binary())], names=["ids", "sizes", "raw"])

    return docs.mapInArrow(run, "ids array<long>, sizes binary, raw binary").select(F.monotonically_increasing_id().alias("slice"), "*")


class Slice:
    """The contexts of a slice; ``repeat`` marks those that equal one of a smaller id in the slice."""

    def __init__(self, row: dict, length: int) -> None:
        self.id, self.ids = row["slice"], row["ids"]
        self.raw, self.sizes = unpacked(row["raw"], np.uint8).tobytes(), unpacked(row["sizes"], np.int32).astype(np.int64)
        self.ends = np.cumsum(self.sizes)
        self.known = np.array([i is not None for i in self.ids], bool)
        self.docs = np.array([0 if i is None else i for i in self.ids], np.int64)
        self.first, self.n, self.anchor, self.hashes = contexts(self.raw, self.ends, length, self.known)
        self.owner = np.searchsorted(self.ends, self.first, "right")
        self.start = self.first - (self.ends - self.sizes)[self.owner]
        self.stop = self.first + self.n + length - 1
        self.repeat = np.zeros(len(self.first), bool)
        order = of_several(np.argsort(self.hashes), self.hashes, self.docs[self.owner])
        for own in np.split(order, few_at_a_time(runs(self.hashes[order]), HELD)):  # whole anchors, so that the order of equal hashes does not matter
            self.repeat[own] = of_larger_id(self.cells(own), self.docs[self.owner[own]])

    def cells(self, own: np.ndarray) -> list[bytes]:
        return [self.raw[a:b] for a, b in zip(self.first[own].tolist(), self.stop[own].tolist())]


def few_at_a_time(begins: np.ndarray, most: int) -> np.ndarray:
    """Those of the places where groups begin that cut them into about ``most`` members each."""
    return begins[1:][np.diff(begins // most) > 0]


def of_larger_id(cells: list[bytes], docs: np.ndarray) -> np.ndarray:
    """Whether an equal cell has a smaller id."""
    kind = pd.factorize(np.array([*cells, None], object)[:-1])[0]
    least = np.full(len(kind), np.iinfo(np.int64).max)
    np.minimum.at(least, kind, docs)
    return docs > least[kind]


def runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """One row after the other, so that one slice at a time is unpacked."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def coded(source: Slice, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts to send and their keys, bucket and short code of the anchor, in order of these."""
    sent = np.flatnonzero(~source.repeat)
    hashes = source.hashes[sent]  # the bits above the code are small in anchors, which have the smallest hashes
    key = part_of(hashes, parts) << CODE_BITS | (hashes >> np.uint64(32)).astype(np.int64) & (1 << CODE_BITS) - 1
    order = np.argsort(key)
    return sent[order], key[order]


def anchor_codes(part: Slice, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per bucket the distinct anchors of a slice by a short code: ``part, codes, how many contexts, in several documents``."""
    sent, key = coded(part, parts)
    doc, begins = part.docs[part.owner[sent]], runs(key)
    if not len(begins):
        return
    several = np.minimum.reduceat(doc, begins) < np.maximum.reduceat(doc, begins)
    number, key = np.diff(np.r_[begins, len(doc)]), key[begins]
    cuts = [*runs(key >> CODE_BITS).tolist(), len(key)]
    for x, y in zip(cuts, cuts[1:]):
        yield int(key[x] >> CODE_BITS), key[x:y] & (1 << CODE_BITS) - 1, number[x:y], several[x:y]


def sent_anchors(cut: DataFrame, parts: int, length: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            rows = [(p, row["slice"], packed(np.diff(codes, prepend=0).astype(np.uint32)), packed(np.minimum(number, 2**31 - 1).astype(np.int32)), np.packbits(several).tobytes())
                    for p, codes, number, several in anchor_codes(Slice(row, length), parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                                 names=["part", "slice", "codes", "number", "several"])

    return cut.mapInArrow(run, "part int, slice long, codes binary, number binary, several binary")


def shared_anchors(sent: DataFrame, length: int, large: int) -> DataFrame:
    """``slice, part, mask, subs``: a bit for each anchor that the slice sent, and how many ways the bucket is to be dealt string by string (0: not)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        codes = [np.cumsum(unpacked(c, np.uint32).astype(np.int64)) for c in group["codes"]]
        number = np.concatenate([unpacked(c, np.int32) for c in group["number"]]).astype(np.int64)
        several = np.concatenate([np.unpackbits(np.frombuffer(c, np.uint8))[:len(k)] for c, k in zip(group["several"], codes)])
        _, at, slices_ = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
        shared = (slices_[at] > 1) | (np.bincount(at, weights=several)[at] > 0)
        size = int(number[shared].sum()) * (length + 16)
        bounds = np.cumsum([0, *map(len, codes)])
        masks = [np.packbits(shared[x:y]).tobytes() for x, y in zip(bounds, bounds[1:])]
        subs = 0 if size <= large else -(-size * 16 // large)
        return pd.DataFrame({"slice": group["slice"], "part": group["part"], "mask": masks, "subs": np.int32(subs)})

    return sent.groupBy("part").applyInPandas(run, "slice long, part int, mask binary, subs int")


def blocks(part: np.ndarray, sub: np.ndarray, cells: list[bytes], n: np.ndarray, anchor: np.ndarray, owner: np.ndarray, start: np.ndarray, source: Slice) -> pa.RecordBatch:
    """One row per bucket: its contexts with the strings in each, the anchor's place, the document (by number) and the place there."""
    key = part * (int(sub.max()) + 1) + sub
    order = np.argsort(key, kind="stable")  # neighbours in a text stand together, which packs better
    key = key[order]
    cuts = [*runs(key).tolist(), len(order)]
    rows: dict[str, list] = {k: [] for k in BLOCK}
    for x, y in zip(cuts, cuts[1:]):
        at = order[x:y]
        own, number = np.unique(owner[at], return_inverse=True)
        cell = (int(part[at[0]]), int(sub[at[0]]), source.id, packed(b"".join([cells[i] for i in at.tolist()])), packed(n[at].astype(np.uint8)),
                packed(anchor[at].astype(np.uint8)), packed(number.astype(np.int32)), packed(start[at].astype(np.int32)), packed(source.docs[own]), packed(own.astype(np.int32)))
        for k, v in zip(BLOCK, cell):
            rows[k].append(v)
    return pa.RecordBatch.from_arrays([pa.array(v, BLOCK[k]) for k, v in rows.items()], names=list(BLOCK))


def sent_contexts(cut: DataFrame, parts: int, length: int) -> DataFrame:
    """Blocks of the contexts with shared anchors, and the spans of contexts that repeat others of their slice. ``cut``: slices with ``masks``, an array of
    ``part, mask, subs``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for row in rows_of(batches):
            source = Slice(row, length)
            own = np.flatnonzero(source.repeat)
            if len(own):
                spans = spans_of(np.zeros(len(own), np.int64), source.owner[own], source.start[own], source.n[own] + length - 1)
                part = xxhash.xxh64_intdigest(source.id.to_bytes(8, "little"), 11) % parts
                cell = {"part": part, "sub": SPANS_OF_SLICE, "slice": source.id, "text": packed_spans(spans)}
                yield pa.RecordBatch.from_arrays([pa.array([cell.get(k, b"")], t) for k, t in BLOCK.items()], names=list(BLOCK))
            sent, key = coded(source, parts)
            begins, subs, shared = runs(key), np.zeros(parts, np.int64), []
            codes = np.bincount(key[begins] >> CODE_BITS, minlength=parts)
            for m in sorted(row["masks"] or [], key=lambda m: m["part"]):
                subs[m["part"]] = m["subs"]
                shared.append(np.unpackbits(np.frombuffer(m["mask"], np.uint8))[:codes[m["part"]]] > 0)
            if not shared:
                continue
            chosen = np.zeros(len(source.first), bool)
            chosen[sent] = np.repeat(np.concatenate(shared), np.diff(np.r_[begins, len(key)]))
            sent = np.flatnonzero(chosen)
            part = part_of(source.hashes[sent], parts)
            alone = subs[part] > 0
            whole, apart = sent[~alone], sent[alone]
            if len(whole):
                yield blocks(part[~alone], np.zeros(len(whole), np.int64), source.cells(whole), source.n[whole],
                             source.anchor[whole] - source.first[whole], source.owner[whole], source.start[whole], source)
            if len(apart):
                which, part = np.repeat(apart, source.n[apart]), np.repeat(part[alone], source.n[apart])
                step = np.arange(len(which)) - np.repeat(np.cumsum(source.n[apart]) - source.n[apart], source.n[apart])
                cells = [source.raw[x:x + length] for x in (source.first[which] + step).tolist()]
                sub = np.array([1 + xxhash.xxh64_intdigest(c, 11) % int(k) for c, k in zip(cells, subs[part])], np.int64)
                yield blocks(part, sub, cells, np.ones(len(which), np.int64), source.anchor[which] - source.first[which] - step, source.owner[which],
                             source.start[which] + step, source)

    return cut.mapInArrow(run, BLOCK_ROWS)


def packed_spans(spans: pd.DataFrame) -> bytes:
    return packed(spans[list(SPANS[1:])].to_numpy(np.int64).astype(np.int32).T.copy())


def spans_of(slice_: np.ndarray, number: np.ndarray, place: np.ndarray, width: np.ndarray) -> pd.DataFrame:
    """Spans ``place .. place + width`` in order of document and place, those that touch as one."""
    end = place + width
    fresh = np.r_[True, (slice_[1:] != slice_[:-1]) | (number[1:] != number[:-1]) | (place[1:] > end[:-1]) | (place[1:] < place[:-1])][:len(place)]
    first = np.flatnonzero(fresh)
    last = np.maximum.reduceat(end, first) if len(first) else end
    return pd.DataFrame({"slice": slice_[first], "number": number[first], "lo": place[first], "hi": last})


class Bucket:
    """The contexts of several blocks, one after the other."""

    def __init__(self, rows: pd.DataFrame, length: int) -> None:
        read = lambda k, t: np.concatenate([unpacked(c, t) for c in rows[k]]).astype(np.int64)
        self.raw = b"".join([unpacked(c, np.uint8).tobytes() for c in rows["text"]])
        self.n, self.anchor, self.place = read("n", np.uint8), read("anchor", np.uint8), read("start", np.int32)
        owners = [unpacked(c, np.int32) for c in rows["owner"]]
        docs = [unpacked(c, np.int64) for c in rows["docs"]]
        before = np.cumsum([0, *map(len, docs)])[:-1]
        owner = np.concatenate(owners).astype(np.int64) + np.repeat(before, [len(o) for o in owners])
        self.doc, self.slice, self.number = np.concatenate(docs)[owner], np.repeat(rows["slice"].to_numpy(np.int64), list(map(len, docs)))[owner], read("numbers", np.int32)[owner]
        self.first = np.cumsum(self.n + length - 1) - (self.n + length - 1)


def regrouped(order: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort the members of each group by ``key`` and cut groups where it changes. Groups are numbered in order."""
    if not len(order):
        return order, group
    by = np.lexsort((key, group))
    order, group, key = order[by], group[by], key[by]
    new = np.r_[True, (group[1:] != group[:-1]) | (key[1:] != key[:-1])]
    return order, np.cumsum(new) - 1


def together(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of groups of two and more."""
    keep = (np.bincount(group) > 1)[group] if len(group) else np.empty(0, bool)
    _, group = np.unique(group[keep], return_inverse=True)
    return order[keep], group


def equal_strings(raw: bytes, starts: np.ndarray, length: int, shallow: int = SHALLOW, known: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of starts (as indexes and group numbers) whose strings of ``length`` bytes are equal: a deep-shallow sort of these suffixes.

    Equal strings have equal values in ``known``.
    """
    padded = raw + bytes(16)
    words, flat = words_at(padded, ">"), np.frombuffer(padded, np.uint8)
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    if known is not None:
        order, group = together(*regrouped(order, group, known))
    # multikey quicksort, a key of eight bytes at a time
    for depth in range(0, shallow, 8):
        order, group = together(*regrouped(order, group, words[starts[order] + depth].astype(np.uint64)))
        if not len(order):
            return
    # blind tries of all groups, a level at a time
    tail = np.uint64(2**64 - 2**(64 - 8 * (length % 8))) if length % 8 else None
    while len(order):
        leads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        mine, lead = starts[order], starts[order[leads]][group]
        common = np.full(len(order), length)
        open_ = np.arange(len(order))
        for depth in range(0, length, 8):
            differ = words[mine[open_] + depth].astype(np.uint64) ^ words[lead[open_] + depth].astype(np.uint64)
            if tail is not None and depth + 8 > length:
                differ &= tail
            stop = differ != 0
            common[open_[stop]] = depth + (differ[stop].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)  # the first byte that differs
            open_ = open_[~stop]
            if not len(open_):
                break
        skip = np.minimum.reduceat(common, leads)
        equal = (skip >= length)[group]
        if equal.any():
            yield order[equal], np.unique(group[equal], return_inverse=True)[1]
        order, skip, group = order[~equal], skip[group][~equal], np.unique(group[~equal], return_inverse=True)[1]
        if len(order):
            order, group = together(*regrouped(order, group, flat[starts[order] + skip]))


def repeats_in(bucket: Bucket, length: int) -> Iterator[pd.DataFrame]:
    """Spans of the strings of a bucket that also start in a document with a smaller id."""
    if not len(bucket.n):
        return
    words = words_at(bucket.raw + bytes(24), "<")
    hashes = gram_hashes(words, bucket.first + bucket.anchor, gram_of(length))
    order = of_several(np.argsort(hashes), hashes, bucket.doc)  # anchors of one document only repeat nothing
    if not len(order):
        return
    begins = runs(hashes[order])
    ends = np.r_[begins[1:], len(order)]
    weight = np.cumsum(bucket.n[order])[ends - 1]  # strings up to the end of each anchor
    cuts = np.flatnonzero(np.r_[np.diff((weight - 1) // CHUNK) != 0, True])
    for lo, hi in zip([0, *ends[cuts[:-1]].tolist()], ends[cuts].tolist()):
        own = order[lo:hi]
        stop = bucket.first[own] + bucket.n[own] + length - 1
        whole = of_larger_id([bucket.raw[a:b] for a, b in zip(bucket.first[own].tolist(), stop.tolist())], bucket.doc[own])
        hit = own[whole]
        if len(hit):
            yield spans_of(bucket.slice[hit], bucket.number[hit], bucket.place[hit], bucket.n[hit] + length - 1)
        own = of_several(own[~whole], hashes, bucket.doc)
        which = np.repeat(own, bucket.n[own])
        step = np.arange(len(which)) - np.repeat(np.cumsum(bucket.n[own]) - bucket.n[own], bucket.n[own])
        starts, doc = bucket.first[which] + step, bucket.doc[which]
        number = np.repeat(np.cumsum(np.r_[False, hashes[own[1:]] != hashes[own[:-1]]])[:len(own)], bucket.n[own])
        repeat = np.zeros(len(which), bool)
        for members, group in equal_strings(bucket.raw, starts, length, known=number * length + bucket.anchor[which] - step):
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, doc[members])
            repeat[members] = doc[members] > least[group]
        hit = np.flatnonzero(repeat)
        if len(hit):
            place = bucket.place[which[hit]] + step[hit]
            yield spans_of(bucket.slice[which[hit]], bucket.number[which[hit]], place, np.full(len(hit), length))


def of_several(order: np.ndarray, hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The contexts in ``order``, which sorts by ``hashes``, whose anchor is in several documents."""
    if not len(order):
        return order
    begins = runs(hashes[order])
    several = np.minimum.reduceat(docs[order], begins) < np.maximum.reduceat(docs[order], begins)
    return order[np.repeat(several, np.diff(np.r_[begins, len(order)]))]


def repeated_spans(cut: DataFrame, parts: int, length: int, large: int) -> DataFrame:
    """``slice, spans``: document (by number) and bytes of spans that repeat documents of smaller ids."""
    masks = shared_anchors(sent_anchors(cut, parts, length), length, large)
    gathered = masks.groupBy("slice").agg(F.collect_list(F.struct("part", "mask", "subs")).alias("masks"))  # a bit for each anchor of a slice

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ready, rest = (group[(group["sub"] == SPANS_OF_SLICE) == x] for x in (True, False))
        rows = list(zip(ready["slice"], ready["text"]))
        if len(rest):
            found = pd.concat([pd.DataFrame(columns=list(SPANS), dtype=np.int64), *repeats_in(Bucket(rest, length), length)])
            rows += [(int(k), packed_spans(own)) for k, own in found.sort_values(["slice", "number", "lo"]).groupby("slice")]
        return pd.DataFrame(rows, columns=["slice", "spans"])

    sent = sent_contexts(cut.join(gathered, "slice"), parts, length)
    return sent.groupBy("part", "sub").applyInPandas(run, "slice long, spans binary")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_text: bool = False,
                    part_bytes: int = PART_BYTES, large: int = LARGE_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row and, if wanted, ``kept`` (bytes)."""
    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = stored(text_slices(rows), "text-slices")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    spans = repeated_spans(cut, max(8, math.ceil(size / part_bytes)), length, large)

    gathered = spans.groupBy("slice").agg(F.collect_list("spans").alias("spans"))  # of one slice

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            raw_all, sizes = unpacked(row["raw"], np.uint8).tobytes(), unpacked(row["sizes"], np.int32).astype(np.int64)
            all_ = np.concatenate([np.empty((0, 3), np.int32), *(unpacked(c, np.int32).reshape(3, -1).T for c in row["spans"] or [])])
            all_ = all_[np.lexsort((all_[:, 1], all_[:, 0]))]
            bounds = np.searchsorted(all_[:, 0], np.arange(len(sizes) + 1))
            out: list[tuple] = []
            for k, (end, size_) in enumerate(zip(np.cumsum(sizes).tolist(), sizes.tolist())):
                raw = raw_all[end - size_:end]
                kept, at, count = [], 0, 0
                for _, lo, hi in all_[bounds[k]:bounds[k + 1]].tolist():
                    if lo > at or not count:
                        kept.append(raw[at:lo])
                        count += 1
                    at = max(at, hi)
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((row["ids"][k], len(raw), len(raw) - len(rest), count, hashlib.sha256(rest).hexdigest(), rest if keep_text else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    found = cut.join(gathered, "slice", "left").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return found if keep_text else found.drop("kept")
