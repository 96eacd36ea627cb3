"""Sitemap files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rankloom.functions.urls import strip_slash

LOC = r"(?i)<loc>\s*(https?://[^\s<]+)\s*</loc>"


def sitemap_urls(files: DataFrame, strip: bool = True, most: int | None = None) -> DataFrame:
    """``sitemap, pos, url``: the addresses of each file (``sitemap``, ``content``) in order, without repeats.

    A file is bounded by the format (50,000 addresses), so repeats are removed inside the row.
    """
    found = F.regexp_extract_all("content", F.lit(LOC), F.lit(1))
    found = F.array_distinct(F.transform(found, lambda u: strip_slash(u)) if strip else found)
    found = F.slice(found, 1, most) if most else found
    rows = files.select("sitemap", F.posexplode(found).alias("pos", "url"))
    return rows.select("sitemap", (F.col("pos") + 1).alias("pos"), "url")


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``sitemap``, ``content``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("sitemap"), F.col("value").alias("content"))


def read_sitemap_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of urlset files with their optional fields."""
    schema = "loc string, lastmod string, changefreq string, priority double"
    return spark.read.format("xml").option("rowTag", "url").schema(schema).load(path).where("loc is not null")
