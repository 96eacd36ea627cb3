"""Prefix trie over conversations: totals of all subtrees by a depth-band rollup.

1. **Rebuilt conversations.** Turns are numbered within their conversation; the first turns of a family's first conversation replace
   those of its other members (``rebuilt_turns``). Only hashes and byte lengths of the turns travel, never their texts.
2. **Nodes.** The identity of a prefix is the running exclusive-or of 128-bit hashes of (position, role, text), so a node has the same name
   in all conversations and needs no lookup of its parent. Nodes are one aggregate over (name).
3. **Bands.** Depths are cut into bands of ``height``. A node adds its own figures to its ancestors within its band only (``height`` rows at most).
   The totals of the band roots are then found by the same step on the trie of band roots, whose depth is ``height`` times less, and each
   band root hands its completed total to its ancestors in the band above. A trie of depth d takes log(d) to the base ``height``
   rounds and a node is written at most ``2 * height`` times, however deep the trie is.

Hot keys: a node that most conversations share is summed map-side; a long conversation is numbered in slices of ``SLICE`` turn numbers whose
totals are carried on; the ids that end in one node are joined in slices of ``ID_SLICE`` ids, and only the hash over the slices runs in order.

Defined results: null role or text count as empty; rows without a conversation id are left out; null turns stand first; turns of one number go by role,
then by text, and repeated rows are turns of their own; an empty table has no node at all, not even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.batches import picked
from rankloom.llm.decontaminate import bounded
from rankloom.llm.simhash_groups import stored

HEIGHT = 8
FAMILY = 5
HEADS = 9
SLICE = 1024
ID_SLICE = 1 << 16
FEW = 1000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def name_of(a: Column, b: Column) -> Column:
    return F.struct(a.alias("a"), b.alias("b"))


def turn_rows(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``conv_id, turn, tie, a, b, bytes``: two hashes of role and text; ``tie`` orders the turns of one number."""
    rows = picked(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    hashes = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("bytes")]
    light = rows.select("conv_id", "turn", *hashes)
    # turns of one number are few: only their texts are compared
    shared = stored(light.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select("conv_id", F.col("turn").alias("t")), "tied-turns")
    same = (rows["conv_id"] == shared["conv_id"]) & rows["turn"].eqNullSafe(shared["t"])
    among = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    tied = (rows.join(bounded(shared, shared.count()), same, "left_semi").select("conv_id", "turn", *hashes, F.rank().over(among).alias("tie"))
            .select("conv_id", F.col("turn").alias("t"), "a", "b", "tie").distinct())
    tied = stored(tied, "turn-ties")
    keys = light["turn"].eqNullSafe(tied["t"]) & (light["conv_id"] == tied["conv_id"]) & (light["a"] == tied["a"]) & (light["b"] == tied["b"])
    return light.join(bounded(tied, tied.count()), keys, "left").select(
        light["conv_id"], light["turn"], F.coalesce("tie", F.lit(0)).alias("tie"), light["a"], light["b"], light["bytes"])


def carried(rows: DataFrame, slice_: Column, order: list[Column], totals: dict[str, Column], combine: dict[str, str]) -> DataFrame:
    """Running values per ``conv_id``: those of a slice by a window, those of all slices before it added from a table of slice totals.

    ``totals`` names an aggregate for each value; ``combine`` says how two of them are put together (``+`` or ``^``).
    """
    cut = rows.withColumn("slice", slice_)
    own = Window.partitionBy("conv_id", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = cut.groupBy("conv_id", "slice").agg(*[c.alias(k) for k, c in totals.items()])
    again = {"+": F.sum, "^": F.bit_xor}
    later = per_slice.select("conv_id", "slice", *[again[combine[k]](k).over(before).alias(f"{k}_before") for k in totals])
    later = stored(later.where(" and ".join(f"{k}_before is not null" for k in totals)), "slices-before")
    running = cut.select("*", *[c.over(own).alias(k) for k, c in totals.items()]).join(bounded(later, later.count()), ["conv_id", "slice"], "left")
    zero = F.lit(0).cast("long")
    put = {"+": lambda x, y: x + y, "^": lambda x, y: x.bitwiseXOR(y)}
    return running.withColumns({k: put[combine[k]](F.col(k), F.coalesce(f"{k}_before", zero)) for k in totals}).drop("slice", *[f"{k}_before" for k in totals])


def rebuilt_turns(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """``conv_id`` of all conversations, and ``conv_id, depth, a, b, bytes``: depth counts rebuilt turns from 1.

    The first ``crc32(conv_id) % heads`` turns of a conversation are those of the first of its family (``conv_id - conv_id % family``).
    """
    order = [F.col("turn").asc_nulls_first(), F.col("tie"), F.col("a"), F.col("b")]
    slice_ = F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(2**62)))
    rows = stored(carried(turns, slice_, order, {"place": F.count(F.lit(1))}, {"place": "+"}), "numbered-turns")
    convs = rows.groupBy("conv_id").agg(F.max("place").alias("n")).select(
        "conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("first_id"), (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h"))
    convs = stored(convs, "conversations")
    firsts = convs.select(F.col("conv_id").alias("first_id"), F.col("n").alias("n_first"))
    plan = convs.join(firsts, "first_id", "left").select("conv_id", "first_id", "h", F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken"))
    plan = stored(plan, "rebuilding")
    start = rows.where(F.col("place") < heads).select(F.col("conv_id").alias("first_id"), "place", "a", "b", "bytes")
    shared = plan.where("taken > 0").join(start, "first_id").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "a", "b", "bytes")
    own = rows.join(plan.select("conv_id", "h", "taken"), "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    return plan.select("conv_id"), shared.unionByName(own)


def prefix_paths(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """``conv_id, depth, id, bytes``: the node of each prefix of each conversation, the root included."""
    hashed = turns.select("conv_id", "depth", "bytes", F.xxhash64("depth", "a", "b").alias("x"), F.xxhash64("b", "depth", "a").alias("y"))
    slice_ = F.floor(F.col("depth") / SLICE)
    running = carried(hashed, slice_, [F.col("depth")], {"p": F.bit_xor("x"), "q": F.bit_xor("y")}, {"p": "^", "q": "^"})
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), name_of(F.lit(0).cast("long"), F.lit(0).cast("long")).alias("id"), F.lit(0).cast("long").alias("bytes"))
    return running.select("conv_id", "depth", name_of(F.col("p"), F.col("q")).alias("id"), "bytes").unionByName(roots)


def trie_bands(paths: DataFrame, height: int) -> DataFrame:
    """``id, conv_id, depth, bytes, parent, up, above`` for each node of each conversation.

    ``up`` are the node and its ancestors within its band; ``above`` of a band root are its ancestors in the band above, else it is empty.
    """
    band = F.floor(F.col("depth") / height)
    first = (F.col("depth") % height == 0) & (F.col("depth") > 0)
    # a band root also closes the band above, where its ancestors are
    placed = paths.select("conv_id", "depth", "id", "bytes", F.explode(F.when(first, F.array(band, band - 1)).otherwise(F.array(band))).alias("band"))
    cells = F.array_sort(F.collect_list(F.struct("depth", "id", "bytes")))  # height + 1 at most
    bands = placed.groupBy("conv_id", "band").agg(cells.alias("cells"))
    at = bands.select("conv_id", "band", "cells", F.posexplode("cells").alias("k", "cell"))
    ids = F.transform("cells", lambda c: c["id"])
    closing = F.col("cell.depth") == (F.col("band") + 1) * height
    nothing = F.slice(ids, 1, 0)
    rows = at.select(
        F.col("cell.id").alias("id"), "conv_id", F.col("cell.depth").alias("depth"), F.col("cell.bytes").alias("bytes"),
        F.when(F.col("k") > 0, F.get(ids, F.col("k") - 1)).alias("parent"),
        F.when(closing, nothing).otherwise(F.slice(ids, 1, F.col("k") + 1)).alias("up"), F.when(closing, F.slice(ids, 1, F.col("k"))).otherwise(nothing).alias("above"))
    return rows


def trie_nodes(paths: DataFrame, height: int) -> DataFrame:
    """One row per node: ``id, depth, conv_id`` (smallest member), ``n_convs, bytes, parent, up, above``."""
    longest = lambda c: F.max_by(c, F.size(c))  # noqa: E731  the other row of a band root has an empty array
    return trie_bands(paths, height).groupBy("id").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.sum(F.when(F.size("up") > 0, 1).otherwise(0)).alias("n_convs"),
        F.min("bytes").alias("bytes"), F.max("parent").alias("parent"), longest("up").alias("up"), longest("above").alias("above"))


def band_totals(nodes: DataFrame, paths: DataFrame, values: list[str], height: int) -> DataFrame:
    """``id`` and the sum of ``values`` over the subtree of each node. ``nodes``: ``id, depth, up, above`` and the values."""
    local = nodes.select(F.explode("up").alias("id"), *values)
    roots = nodes.where((F.col("depth") % height == 0) & (F.col("depth") > 0)).select("id", "above")
    roots = stored(roots, "band-roots")
    if roots.isEmpty():
        return local.groupBy("id").agg(*[F.sum(v).alias(v) for v in values])
    local = stored(local.groupBy("id").agg(*[F.sum(v).alias(v) for v in values]), "band-totals")
    # the trie of band roots: their totals so far are their own figures there
    coarse_paths = paths.where(F.col("depth") % height == 0).select("conv_id", F.floor(F.col("depth") / height).alias("depth"), "id", "bytes")
    shape = trie_bands(coarse_paths, height).groupBy("id").agg(
        F.min("depth").alias("depth"), F.max_by("up", F.size("up")).alias("up"), F.max_by("above", F.size("above")).alias("above"))
    coarse = stored(shape.join(local, "id"), "band-trie")
    whole = stored(band_totals(coarse, coarse_paths, values, height), "band-root-totals")
    handed = whole.join(roots, "id").select(F.explode("above").alias("id"), *values)
    # what is handed to a band root is in its completed total already
    inner = stored(local.unionByName(handed).groupBy("id").agg(*[F.sum(v).alias(v) for v in values]), "inner-totals")
    done = whole.select("id", *[F.col(v).alias(f"{v}_done") for v in values])
    return inner.join(done, "id", "left").select("id", *[F.coalesce(f"{v}_done", v).alias(v) for v in values])


def joined_ids(ends: DataFrame) -> DataFrame:
    """``id, ends_sha256`` over the ids that end in a node, ascending and comma-joined: slices of ids are joined apart, then hashed in order."""
    part = F.floor(F.col("conv_id") / ID_SLICE)
    slices = ends.groupBy("id", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple[int, int, str]] = []
            for a, b, ids in zip(*(batch.column(k).to_pylist() for k in ("a", "b", "ids"))):
                if (a, b) == now:
                    state.update(b"," + ids.encode())
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["a", "b", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=["a", "b", "ends_sha256"])

    ordered = slices.select("id.a", "id.b", "part", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "part").select("a", "b", "ids")
    return ordered.mapInArrow(run, "a long, b long, ends_sha256 string").select(name_of(F.col("a"), F.col("b")).alias("id"), "ends_sha256")


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, rows_per_key: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``lookup`` on ``key``; keys with over a thousandth of the rows, under a thousand of them, are broadcast."""
    often = F.col(rows_per_key) > max(1, total // FEW)
    columns = [*rows.columns, *[c for c in lookup.columns if c not in (key, rows_per_key)]]
    common = lookup.where(often).drop(rows_per_key)
    seldom = rows.join(F.broadcast(common.select(key)), key, "left_anti").join(lookup.where(~often).drop(rows_per_key), key, "left")
    return rows.join(F.broadcast(common), key).select(*columns).unionByName(seldom.select(*columns))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      height: int = HEIGHT) -> DataFrame:
    """``id, depth, conv_id, parent, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` for each node."""
    convs, turns = rebuilt_turns(stored(turn_rows(conversations, conv_col, turn_col, role_col, text_col), "turns"))
    paths = stored(prefix_paths(convs, turns), "paths")
    nodes = stored(trie_nodes(paths, height), "trie-nodes")
    children = stored(nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "id"), "children")
    sized = stored(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "sized-nodes")
    valued = sized.select("id", "depth", "up", "above", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
                          ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = band_totals(valued, paths, ["n_leaves", "saved_tokens"], height)
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "id")).alias("last"))
    ends = joined_ids(last.select(F.col("last.id").alias("id"), "conv_id"))
    parents = sized.where("n_children > 0").select(F.col("id").alias("parent"), "n_children", F.col("conv_id").alias("parent_conv_id"))
    rows = looked_up(sized.select("id", "depth", "conv_id", "parent", "n_convs", "n_children"), parents, "parent", "n_children", sized.count())
    return rows.join(totals, "id").join(ends, "id", "left").select(
        "id", "depth", "conv_id", "parent", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
