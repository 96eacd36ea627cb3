"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# A key is hot from this many rows on.
HOT_ROWS = 1_000_000


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """All keys with more than ``hot_rows`` rows and the number of parts to split each into.

    There is at most one such key per ``hot_rows`` rows; Spark broadcasts the list while it is small and shuffles it beyond.
    """
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_key_rows"))
    return counted.where(F.col("_key_rows") > hot_rows).select(*keys, F.ceil(F.col("_key_rows") / hot_rows).cast("int").alias("_parts"))


def salted_join(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    shuffled: bool = False,
) -> DataFrame:
    """Equi join of many ``rows`` with a ``lookup`` of few rows per key.

    Rows of a hot key are spread over several tasks by a hash of ``spread``; the lookup rows of that
    key are copied once per part. Other keys are joined as usual. ``shuffled`` is for a lookup that grows with the input
    and was exploded: Spark's estimate leaves the copies out, so it would be sent through the driver as a broadcast.
    """
    keys = list(keys)
    hot = hot if hot is not None else hot_keys(rows, keys, hot_rows)
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    salted_rows = (
        rows.join(hot, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), parts).cast("int"))
        .drop("_parts")
    )
    salted_lookup = (
        lookup.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )
    if shuffled:
        salted_lookup = salted_lookup.hint("merge")
    return salted_rows.join(salted_lookup, [*keys, "_salt"], how).drop("_salt")


def shared_values(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-empty values of the first of ``keys`` (within the others) found on two rows or more, with their row count."""
    counted = rows.where(F.col(keys[0]) != "").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.where("n_rows > 1")


def with_group_size(
    rows: DataFrame, key: str, spread: Column, hot_rows: int = HOT_ROWS, source: DataFrame | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``n_rows``, the number of rows that share the row's value of ``key`` within the columns ``by`` (null if unshared).

    Counts are aggregated before they are joined back; a value held by very many rows (known from the
    counts) is spread over several tasks. ``source`` may give a cheaper table to count the values in.
    """
    keys = [key, *by]
    shared = shared_values(source if source is not None else rows, keys)
    hot = shared.where(F.col("n_rows") > hot_rows).select(*keys, F.ceil(F.col("n_rows") / hot_rows).cast("int").alias("_parts"))
    return salted_join(rows, shared, keys, spread, how="left", hot=hot)
