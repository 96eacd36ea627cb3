"""Streams of crawled pages and issue statuses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.page_issues import light_issues
from rankloom.session import scratch_path
from rankloom.sources.page_facts import extract_pages

STATUS_KEY = ["project_id", "url", "issue_type"]


def crawl_progress(arrivals: DataFrame) -> DataFrame:
    """Pages crawled, errors and time of the last page per job (``job_id, is_error, arrived_at``).

    ``known``, if there is such a column, is the number of addresses found so far; it gives the pages still queued.
    """
    queued = {"queued": F.greatest(F.max("known") - F.count(F.lit(1)), F.lit(0))} if "known" in arrivals.columns else {}
    elapsed = F.round(F.max("arrived_at").cast("double") - F.min("arrived_at").cast("double"), 3)
    return arrivals.groupBy("job_id").agg(
        elapsed.alias("elapsed_s"), *[c.alias(n) for n, c in queued.items()],
        F.count(F.lit(1)).alias("crawled"), F.count_if(F.col("is_error")).alias("errors"),
        F.min("arrived_at").alias("started_at"), F.max("arrived_at").alias("last_at"))


def ingest(raw: DataFrame) -> DataFrame:
    """Page records with light labels from arriving raw pages; row by row, so any stream of pages will do."""
    return light_issues(extract_pages(raw))


def latest_status(rows: DataFrame) -> DataFrame:
    """Newest status per project, page and issue type; of equal times the larger status."""
    newest = F.max_by(F.struct("status", "updated_at"), F.struct("updated_at", "status"))
    return rows.groupBy(*STATUS_KEY).agg(newest.alias("s")).select(*STATUS_KEY, "s.*")


def upsert_status(batch: DataFrame, path: str, epoch: int) -> None:
    """Append a batch to the status table at ``path`` as its own partition; a batch that runs again writes the same partition."""
    latest_status(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def start_status_upsert(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(lambda batch, epoch: upsert_status(batch, path, epoch)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())


def statuses(spark: SparkSession, path: str, project_id=None) -> DataFrame:
    """The newest row of each key over all batches."""
    rows = latest_status(spark.read.parquet(path))
    return rows.where(F.col("project_id") == project_id) if project_id is not None else rows


def compact_statuses(spark: SparkSession, path: str) -> None:
    """Replace the batches written so far by their newest rows, in the partition of the last batch. Not while a stream writes to the table."""
    last = spark.read.parquet(path).agg(F.max("epoch")).first()[0]
    copy = scratch_path(spark, "statuses")
    statuses(spark, path).withColumn("epoch", F.lit(last)).write.parquet(copy)
    spark.read.parquet(copy).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("epoch").parquet(path)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available and return its output.

    In update mode each batch is written with its number and the newest row counts are read from the last one.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").outputMode("append").start(path).awaitTermination()
    else:
        def save(batch: DataFrame, epoch: int) -> None:
            batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

        writer.outputMode(mode).foreachBatch(save).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path) if mode == "append" else spark.read.option("recursiveFileLookup", True).parquet(path)
