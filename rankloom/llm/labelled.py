"""Bounded, deterministic samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.batches import picked

MAX_LABELLED = 12_000


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def sampled(wanted: int, rows: int, *keys: str, seed: int) -> Column:
    """Whether a row is in a sample of about ``wanted`` of ``rows`` rows, by a 64-bit threshold on a hash of its keys."""
    limit = 2**63 - 1 if wanted >= rows else wanted * 2**64 // rows - 2**63
    return F.xxhash64(*keys, F.lit(seed)) <= F.lit(limit)


def known_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, label``, one row for each id; the larger label of an id that has several."""
    rows = picked(labels, doc_id=id_col, label=label).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    return rows.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_LABELLED, skip_fold: tuple[int, int] | None = None,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, label`` of about ``max_rows`` labelled documents, chosen by a hash of the id.

    ``skip_fold`` (folds, left out) keeps a fold of ids out of the sample. The sample is bounded, so it may be broadcast
    for the join and its features may be collected. Rows with a null id or label are not used.
    """
    rows = known_labels(labels, label, id_col)
    if skip_fold:
        rows = rows.where(fold("doc_id", skip_fold[0]) != skip_fold[1])
    total = rows.count()
    chosen = rows.where(sampled(max_rows, total, "doc_id", seed=7)).limit(2 * max_rows)
    return picked(docs, doc_id=id_col, text=text_col).join(F.broadcast(chosen), "doc_id")
