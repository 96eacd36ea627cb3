"""Near-duplicate groups by 64-bit SimHash: tiled exact comparison with numpy.

Fingerprints are compared once per distinct value. The 64 bits are cut into ``radius + 1`` blocks; two fingerprints within the radius
agree on one block at least, so each fingerprint is dealt to one tile per block, by some bits of that block (more bits as
there are more fingerprints, so that tiles keep their size). In a tile the fingerprints are sorted by population count and compared
square by square with exclusive-or and bit counts; squares whose population counts differ by more than the radius are skipped.
A tile over the limit is dealt to pairs of slices by population count, so that no task holds it whole. A tile gives a
link from each member to the first of its local group rather than all pairs; groups across tiles are found by star
contraction with joins.

Defined results: a text without words (null, empty, white space) has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle; repeated rows get equal rows; null ids never are the name of a group unless it has none else.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.batches import numbered, picked, slices, texts_of
from rankloom.session import scratch_path

BITS = 64
FEW = 1000
SQUARE = 1024
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose counted rows are within the limit; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_fingerprints(texts: list[str], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each text over its word shingles, repeats included, as signed 64-bit integers."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(joined, seed))
            counts[i] = 1
            continue
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes += [digest(joined[a:b - 1], seed) for a, b in zip(starts, ends[shingle - 1:])]
        counts[i] = len(words) - shingle + 1
    return majorities(np.array(hashes, np.uint64), counts)


def majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of consecutive runs of ``counts`` hashes, as signed 64-bit integers; zero for a run without hashes."""
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.cumsum(counts[filled]) - counts[filled]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        majority = (2 * ones > counts[filled][:, None]).astype(np.uint8)
        out[filled] = np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """``doc_id, text_key, fp``: fingerprint and a hash of the text for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            fp = text_fingerprints(texts_of(part, "text"), shingle, seed)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(fp)], names=["doc_id", "text_key", "fp"])

    rows = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def local_roots(left: np.ndarray, right: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Join the links (left, right) into the forest ``root``; a root is the smallest index of its tree."""
    while len(left):
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            break
        left, right = left[open_], right[open_]
        np.minimum.at(root, np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_]))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def tile_links(prints: np.ndarray, side: np.ndarray, radius: int, square: int = SQUARE) -> tuple[np.ndarray, np.ndarray]:
    """Links of a tile as (member, first of its group). Members of side 0 are only compared with side 1 where both occur."""
    order = np.argsort(np.bitwise_count(prints), kind="stable")
    prints, side = prints[order], side[order]
    pop = np.bitwise_count(prints).astype(np.int64)
    two = bool(side.any()) and not bool(side.all())
    root = np.arange(len(prints))
    for a in range(0, len(prints), square):
        for b in range(a, len(prints), square):
            if pop[b] - pop[min(a + square, len(prints)) - 1] > radius:
                break  # sorted: all later squares are farther off
            near = np.bitwise_count(prints[a:a + square, None] ^ prints[None, b:b + square]) <= radius
            i, j = np.nonzero(near)
            i, j = i + a, j + b
            keep = i < j
            if two:
                keep &= side[i] != side[j]
            root = local_roots(i[keep], j[keep], root)
    moved = np.flatnonzero(root != np.arange(len(prints)))
    return prints[moved], prints[root[moved]]


def tile_bits(n: int, tile_rows: int, radius: int) -> int:
    """Bits of a block that name its tile, so that a tile has about ``tile_rows`` rows."""
    return max(0, min(BITS // (radius + 1), math.ceil(math.log2(max(1.0, n / tile_rows)))))


def similar_prints(prints: DataFrame, radius: int = 4, tile_rows: int = 2048, tile_limit: int = 16384) -> DataFrame:
    """Links ``a, b`` (a star per local group) between the distinct fingerprints ``fp`` that differ in at most ``radius`` bits."""
    n = prints.count()
    bits = tile_bits(n, tile_rows, radius)
    blocks = radius + 1 if bits else 1
    width = BITS // (radius + 1)
    keys = [F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) for k in range(blocks)]
    rows = prints.select("fp", F.bit_count("fp").cast("int").alias("pop"), F.posexplode(F.array(*keys)).alias("block", "key"))
    sizes = rows.groupBy("block", "key", "pop").count()
    crowded = (
        sizes.withColumn("total", F.sum("count").over(Window.partitionBy("block", "key")))
        .where(F.col("total") > tile_limit)
        .groupBy("block", "key")
        .agg(F.collect_list(F.struct(F.col("pop").alias("p"), F.ceil(F.col("count") / tile_limit).cast("int").alias("n"))).alias("cuts"))
    )
    r = F.lit(radius)
    mine = F.col("pop") * 1_000_000 + F.pmod(F.xxhash64("fp"), F.filter("cuts", lambda c: c["p"] == F.col("pop"))[0]["n"].cast("long"))
    near = F.flatten(F.transform(
        F.filter("cuts", lambda c: F.abs(c["p"] - F.col("pop")) <= r),
        lambda c: F.transform(F.sequence(F.lit(0), c["n"] - 1), lambda s: c["p"].cast("long") * 1_000_000 + s)))
    dealt = (
        rows.join(crowded, ["block", "key"], "left")
        .withColumn("slice", F.when(F.col("cuts").isNull(), F.lit(0).cast("long")).otherwise(mine))
        .withColumn("other", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(near)))
        .select("fp", "block", "key", F.least("slice", "other").alias("lo"), F.greatest("slice", "other").alias("hi"),
                (F.col("slice") > F.col("other")).cast("int").alias("side"))
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = tile_links(group["fp"].to_numpy(np.int64).view(np.uint64), group["side"].to_numpy(), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("block", "key", "lo", "hi").applyInPandas(run, "a long, b long")


def star_rounds(links: DataFrame, name: str = "stars") -> DataFrame:
    """``node, root`` of every node in ``links`` (a, b): alternating large and small stars until nothing moves."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u != v").distinct(), name)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4,
                          tile_rows: int = 2048) -> DataFrame:
    """``doc_id, text_key, fp, root, component_id`` for each row of ``docs``; ``root`` is the fingerprint that stands for the group."""
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    distinct = stored_distinct(prints)
    return named_groups(prints, similar_prints(distinct.select("fp"), radius, tile_rows), distinct)


def stored_distinct(prints: DataFrame) -> DataFrame:
    return stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "distinct-prints")


def named_groups(prints: DataFrame, links: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """``doc_id, text_key, fp, root, component_id`` of ``prints`` whose ``fp`` are tied by ``links`` (a, b)."""
    distinct = stored_distinct(prints) if distinct is None else distinct
    roots = star_rounds(links).withColumnRenamed("node", "fp")
    linked = distinct.join(roots, "fp")
    named = linked.groupBy("root").agg(F.min("first_id").alias("group_id")).join(linked.select("fp", "root"), "root").select("fp", "root", "group_id")
    ids = stored(distinct.join(named, "fp", "left").select("fp", "rows", F.coalesce("root", "fp").alias("root"), F.coalesce("group_id", "first_id").alias("component_id")), "group-names")
    # fingerprints with more than a thousandth of the rows, fewer than a thousand of them, are looked up without moving their rows
    total = ids.agg(F.sum("rows")).first()[0] or 0
    often = F.col("rows") > max(1, total // FEW)
    common = prints.join(F.broadcast(ids.where(often).select("fp", F.col("root").alias("_root"), F.col("component_id").alias("_name"), F.lit(True).alias("_often"))), "fp", "left")
    columns = ["doc_id", "text_key", "fp"]
    rest = common.where("_often is null").select(*columns).join(ids.where(~often).select("fp", "root", "component_id"), "fp")
    return common.where("_often").select(*columns, F.col("_root").alias("root"), F.col("_name").alias("component_id")).unionByName(rest.select(*columns, "root", "component_id"))


def hex_print(column: str) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """One row of each group stays, with all its columns: that of the smallest id; of rows alike in id and text, one."""
    return first_of_groups(docs, near_duplicate_groups(docs, id_col, text_col, **options), id_col, text_col)


def first_of_groups(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each of ``groups`` keeps one.

    A group is known by its ``root``, so that groups without an id, or with one smallest id by chance, keep a row each. The rows that stay or those that go, whichever
    are fewer, are looked up; texts are dealt only where these are too many to be sent to all tasks.
    """
    null_id = F.lit(-(2**63))
    key = {"_k1": F.coalesce("doc_id", null_id), "_k2": F.col("text_key")}
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("best"))
    chosen = best.select("best.doc_id", "best.text_key").select(*[c.alias(k) for k, c in key.items()]).distinct().withColumn("_stays", F.lit(True))
    alike = groups.groupBy(*[c.alias(k) for k, c in key.items()]).agg(F.count("*").alias("_rows"))
    fates = stored(alike.join(chosen, list(key), "left").withColumn("_stays", F.coalesce("_stays", F.lit(False))), "fates")
    going, staying, repeated = (int(x or 0) for x in fates.agg(*[F.sum(F.when(c, 1)) for c in (~F.col("_stays"), F.col("_stays"), F.col("_stays") & (F.col("_rows") > 1))]).first())
    inner = numbered(docs)
    own_id, own_text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    keyed = inner.withColumns({"_k1": F.coalesce(F.col(own_id).cast("long"), null_id), "_k2": F.xxhash64(own_text)})
    if going + repeated <= staying:
        listed, how, once = fates.where(~F.col("_stays") | (F.col("_rows") > 1)), "left", F.col("_rows").isNull()
    else:
        listed, how, once = fates.where("_stays"), "inner", F.col("_rows") == 1
    found = keyed.join(bounded(listed, min(going + repeated, staying)), list(key), how)
    kept = found.where(once).select(*inner.columns)
    if repeated:
        one = Window.partitionBy(*key).orderBy(F.lit(1))
        kept = kept.union(found.where("_stays and _rows > 1").withColumn("_n", F.row_number().over(one)).where("_n = 1").select(*inner.columns))
    return kept.toDF(*docs.columns)
