"""Helpers for Arrow functions over texts: bounded slices and whole-batch word arrays."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``limit`` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        block = (np.cumsum(sizes) - sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            yield batch.slice(start, end - start)


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns ``c0, c1, ...``, so that no name of a column can clash with those an operator adds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only some columns, by exact name: ``picked(df, text="body")`` has ``text`` from ``body``."""
    return numbered(df).select(*[F.col(f"c{df.columns.index(name)}").alias(alias) for alias, name in columns.items()])


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


@dataclass
class Words:
    """The words of several texts, one after the other, as ids into the distinct words."""

    n_docs: int
    counts: np.ndarray  # words per text
    doc: np.ndarray  # text of each word
    ids: np.ndarray  # distinct word of each word
    distinct: np.ndarray  # bytes objects


def words_of(texts: list[str], lower: bool = False) -> Words:
    """Words are runs of anything but space and U+0009 to U+000D, which is how bytes split."""
    raw = [t.encode() for t in texts]
    split = [r.lower().split() if lower else r.split() for r in raw]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for ws in split for w in ws]
    ids, distinct = pd.factorize(flat)
    return Words(len(texts), counts, np.repeat(np.arange(len(texts)), counts), ids.astype(np.int64), distinct)


def rows_per_doc(values: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Sum of values per text."""
    return np.bincount(doc, weights=values, minlength=n_docs)


def with_columns(batch: pa.RecordBatch, keep: list[str], added: dict[str, pa.Array]) -> pa.RecordBatch:
    """Some columns of a batch followed by new ones."""
    return pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *added.values()], names=[*keep, *added])
