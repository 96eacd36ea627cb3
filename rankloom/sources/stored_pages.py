"""Stored crawl results: rows with a JSON blob per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rankloom.schema import PAGE_SCHEMA, error_record, normalise_pages

_COLUMNS = ("job_id", "page_url", "title", "status_code", "meta_data", "issues")


def to_stored(pages: DataFrame, job_id: str) -> DataFrame:
    """Rows as they are stored: one JSON blob of all page facts and the issues as JSON."""
    facts = [c for c in PAGE_SCHEMA.fieldNames() if c in pages.columns and c not in ("issues", "url", "title", "status_code")]
    return pages.select(
        F.lit(job_id).alias("job_id"), F.col("url").alias("page_url"), "title", "status_code",
        F.to_json(F.struct(*facts)).alias("meta_data"), F.to_json("issues").alias("issues"))


def from_stored(rows: DataFrame) -> DataFrame:
    """Page records from stored rows; a blob that cannot be read counts as empty, bad issues as no issues."""
    inside = T.StructType([f for f in PAGE_SCHEMA.fields if f.name not in ("issues", "url", "title", "status_code")])
    meta = F.from_json("meta_data", inside, {"mode": "PERMISSIVE"})
    flat = rows.select("job_id", F.col("page_url").alias("url"), "title", "status_code", meta.alias("_m"),
                       F.from_json("issues", "array<string>").alias("issues"))
    return normalise_pages(flat.select("job_id", "url", "title", "status_code", "issues", "_m.*"))


def write_job(pages: DataFrame, path: str, job_id: str) -> None:
    """Append the pages of one job; the job is the partition, so reading one job reads its files only."""
    to_stored(pages, job_id).write.mode("append").partitionBy("job_id").parquet(path)


def read_job(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    rows = spark.read.parquet(path).where(F.col("job_id") == job_id)
    return from_stored(rows.select(*_COLUMNS))


def error_pages(failures: DataFrame) -> DataFrame:
    """Page records of failed fetches (``url``, ``note``): every fact empty, the note as title."""
    return failures.select(*error_record(F.col("url"), F.col("note")))
