"""Set operations on issues and keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions import text as TX
from rankloom.operators.skew import salted_join


def issue_diff(snapshots: DataFrame, moments: DataFrame) -> DataFrame:
    """Issues that are new or fixed between two snapshots of each project.

    ``snapshots`` has ``project_id, crawled_at, url, issue``; ``moments`` has ``project_id, newer, older``. Both sides
    are formed in one pass: an (url, issue) seen on one side only is new or fixed.
    """
    two = moments.where("older is not null")
    rows = salted_join(snapshots, two, ["project_id"], F.xxhash64("url", "issue")).where("crawled_at = newer or crawled_at = older")
    seen = rows.groupBy("project_id", "url", "issue").agg(
        F.bool_or(F.col("crawled_at") == F.col("newer")).alias("now"), F.bool_or(F.col("crawled_at") == F.col("older")).alias("then"))
    return seen.where("now <> then").select("project_id", "url", "issue", F.when(F.col("now"), "new").otherwise("fixed").alias("type"))


def keyword_gap(yours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Keywords (``keyword``) of two lists as missing, strong or weak with the gap score."""
    def side(rows: DataFrame, flag: str) -> DataFrame:
        return rows.select(F.lower(F.trim("keyword")).alias("keyword")).where("keyword <> ''").distinct().withColumn(flag, F.lit(True))

    both = side(yours, "you").join(side(theirs, "they"), "keyword", "full_outer")
    kind = F.when(F.col("you").isNull(), "missing").when(F.col("they").isNull(), "strong").otherwise("weak")
    score = F.when(F.col("you").isNull(), 75).when(F.col("they").isNull(), 15).otherwise(40)
    return both.select("keyword", kind.alias("type"), score.alias("gap_score"))


def competitor_gap(site_keywords: DataFrame, target: str, k: int | None = 50) -> DataFrame:
    """Keywords (``site``, ``keyword``) of two competitors or more that the target lacks.

    With a single competitor its own keywords are enough. The best ``k`` by number of competitors, score and text.
    """
    pairs = site_keywords.select("site", F.lower("keyword").alias("keyword")).where("keyword <> ''").distinct()
    n_sites = pairs.where(F.col("site") != target).select("site").distinct().count()
    seen = pairs.where(F.length("keyword") > 3).groupBy("keyword").agg(
        F.count_if(F.col("site") != target).alias("competitor_count"), F.bool_or(F.col("site") == target).alias("own"))
    gaps = seen.where(~F.col("own") & (F.col("competitor_count") >= (2 if n_sites >= 2 else 1)))
    bonus = F.least(10 * F.size(TX.words(F.col("keyword"))), F.lit(30))
    score = F.least(F.col("competitor_count") / F.lit(max(n_sites, 1)) * 70 + bonus, F.lit(100.0))
    out = gaps.select("keyword", "competitor_count", F.round(score, 1).alias("opportunity_score"),
                      TX.search_intent(F.col("keyword")).alias("intent"))
    return out.orderBy(F.desc("competitor_count"), F.desc("opportunity_score"), "keyword").limit(k) if k else out


def page_gap(pages: DataFrame, rivals: DataFrame, considered: int = 10, shown: int = 5) -> DataFrame:
    """Keywords of the competing pages that a page lacks.

    ``pages`` has ``url, keywords, title, h1``; ``rivals`` has ``url`` and ``rival_url``, ``rival_keywords``. Of the
    ``considered`` most used keywords those missing on the page are kept, at most ``shown``.
    """
    terms = rivals.select("url", "rival_url", F.explode(F.array_distinct(F.transform("rival_keywords", F.lower))).alias("keyword"))
    used = terms.groupBy("url", "keyword").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("url").orderBy(F.desc("n"), "keyword")
    top = used.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= considered)
    own = pages.select("url", F.transform("keywords", F.lower).alias("_own"))
    missing = top.join(own, "url").where(~F.array_contains("_own", F.col("keyword")) & (F.length("keyword") > 3))
    kept = missing.withColumn("_m", F.row_number().over(Window.partitionBy("url").orderBy("_r"))).where(F.col("_m") <= shown)
    lists = kept.groupBy("url").agg(F.array_sort(F.collect_list(F.struct("_m", "keyword"))).alias("_l"))
    return lists.select("url", F.transform("_l", lambda x: x["keyword"]).alias("missing_keywords"))


def heading_gap(pages: DataFrame, rivals: DataFrame) -> DataFrame:
    """First heading and title of a competing page for pages that have none (``rival_url``, ``rival_h1``, ``rival_title``)."""
    def first(column: str) -> Column:
        return F.min(F.when(F.col(column) != "", F.struct("rival_url", column)))[column]

    found = rivals.groupBy("url").agg(first("rival_h1").alias("h1"), first("rival_title").alias("title"), F.count(F.lit(1)).alias("competitor_count"))
    rows = pages.select("url", F.trim(F.array_join("h1", " ")).alias("_h1"), F.trim("title").alias("_t")).join(found, "url", "left")
    return rows.select("url", F.when(F.col("_h1") == "", F.coalesce("h1", F.lit(""))).otherwise("").alias("h1_gap"),
                       F.when(F.col("_t") == "", F.coalesce("title", F.lit(""))).otherwise("").alias("title_gap"),
                       F.coalesce("competitor_count", F.lit(0)).alias("competitor_count"))


def merge_keywords(first: Column, second: Column, third: Column, most: int = 15) -> Column:
    """Three keyword lists in order of rank, trimmed, lower case, without repeats."""
    merged = F.transform(F.concat(first, second, third), lambda k: F.lower(F.trim(k)))
    return F.slice(F.array_distinct(F.filter(merged, lambda k: k != "")), 1, most)
