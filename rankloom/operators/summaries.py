"""Site-wide counts: technical summary, status, issues, images, breadcrumbs, redirects, search analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions import text as TX
from rankloom.functions.scores import letter_grade, percent
from rankloom.operators.technical import ranking_score


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def technical_summary(audits: DataFrame) -> DataFrame:
    """One row of averages, grade counts, indexability counts and coverage over the technical audit."""
    real = ~F.col("is_error")
    grades = [_n(real & (F.col("tech_grade") == g)).alias(f"grade_{g.lower()}") for g in "ABCDF"]
    states = [
        _n(real & (F.col("indexability") == s)).alias(s)
        for s in ("indexable", "likely_indexable", "canonical_mismatch", "not_indexable_redirect", "not_indexable_error",
                  "not_indexable_noindex", "unknown")
    ]
    covered = {
        "title": F.col("a_title.present"), "meta": F.col("a_meta.present"), "canonical": F.col("a_canonical.present"),
        "og": F.col("a_og.has_og"), "h1": F.col("a_headings.h1_count") == 1, "https": F.col("a_url.is_https"),
    }
    cover = [_n(real & c).alias(f"_{k}") for k, c in covered.items()]
    row = audits.agg(
        F.count(F.lit(1)).alias("total_pages"), _n(real).alias("real_pages"),
        F.round(F.avg(F.when(real, F.col("tech_score"))), 1).alias("avg_tech_score"),
        *grades, *states, *cover, _n(real & (F.col("a_content.depth") == "thin")).alias("thin_pages"),
    )
    n = F.col("real_pages")
    ok = F.col("indexable") + F.col("likely_indexable")
    return row.select(
        "*", letter_grade(F.coalesce("avg_tech_score", F.lit(0))).alias("site_grade"), ok.alias("indexable_total"),
        percent(ok, n).alias("indexable_pct"), (n - ok).alias("blocked_total"),
        *[percent(F.col(f"_{k}"), n).alias(f"{k}_pct") for k in covered], percent(F.col("thin_pages"), n).alias("thin_pct"),
    ).drop(*[f"_{k}" for k in covered])


def top_labels(rows: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent labels of an array column; ties in alphabetical order."""
    counted = rows.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "label").limit(k)


def label_counts(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(column).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def status_distribution(pages: DataFrame) -> DataFrame:
    code = F.floor(F.col("status_code") / 100)
    bucket = F.when(code.between(2, 5), F.concat(code.cast("string"), F.lit("xx"))).otherwise(
        F.coalesce(F.col("status_code").cast("string"), F.lit("Unknown")))
    return pages.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("pages"))


def https_share(pages: DataFrame) -> DataFrame:
    real = ~F.col("is_error")
    row = pages.agg(
        F.count(F.lit(1)).alias("total_pages"), _n(real).alias("real_pages"),
        _n(real & F.startswith("url", F.lit("https://"))).alias("https_pages"),
    )
    pct = percent(F.col("https_pages"), F.col("real_pages"))
    return row.select("*", pct.alias("https_pct"),
                      F.when(pct == 100, "all_https").when(pct > 0, "partial").otherwise("no_https").alias("status"))


def issue_summary(pages: DataFrame) -> DataFrame:
    """Pages in all, with issues, by priority, and clean; needs ``issues`` and ``priority``."""
    return pages.agg(
        F.count(F.lit(1)).alias("total"), _n(F.size("issues") > 0).alias("with_issues"),
        *[_n(F.col("priority") == p).alias(p.lower()) for p in ("High", "Medium", "Low")],
        _n(F.size("issues") == 0).alias("clean"),
    )


def mixed_content_summary(pages: DataFrame) -> DataFrame:
    n = F.size("mixed_resources")
    return pages.agg(F.count(F.lit(1)).alias("pages_scanned"), _n(n > 0).alias("pages_affected"),
                     F.sum(n).alias("total_resources"))


def image_loading_summary(pages: DataFrame) -> DataFrame:
    row = pages.agg(F.sum("img_total").alias("total_images"), F.sum("img_lazy_count").alias("lazy_count"),
                    F.sum("img_srcset_count").alias("srcset_count"))
    total = F.col("total_images")
    return row.select("*", percent(F.col("lazy_count"), total).alias("lazy_pct"),
                      percent(F.col("srcset_count"), total).alias("srcset_pct"),
                      ((total > 0) & (2 * F.col("lazy_count") < total)).alias("few_lazy"),
                      ((total > 0) & (F.col("srcset_count") < 0.3 * total)).alias("few_srcset"))


def breadcrumb_summary(pages: DataFrame) -> DataFrame:
    source = F.col("breadcrumb_source")
    row = pages.agg(F.count(F.lit(1)).alias("total"), _n(F.col("breadcrumb_detected")).alias("detected"),
                    _n(source == "json_ld").alias("json_ld"), _n(source == "html_nav").alias("html_nav"))
    pct = percent(F.col("detected"), F.col("total"))
    return row.select("*", (F.col("total") - F.col("detected")).alias("without"), pct.alias("coverage_pct"),
                      ((pct < 80) & (F.col("total") > 3)).alias("low_coverage"))


def redirect_chains(pages: DataFrame) -> DataFrame:
    """Pages reached through more than one redirect."""
    return pages.where("redirect_hops > 1").select("url", "redirect_hops")


def issue_rollup(issues: DataFrame) -> DataFrame:
    """Issue counts in all, by severity and by category (``severity``, ``category``) in one pass."""
    rolled = issues.groupingSets([["severity"], ["category"], []], "severity", "category").agg(
        F.count(F.lit(1)).alias("n"), F.grouping("severity").alias("_s"), F.grouping("category").alias("_c"))
    return rolled.select(
        F.when(F.col("_s") == 0, "severity").when(F.col("_c") == 0, "category").otherwise("total").alias("level"),
        F.when(F.col("_s") == 0, F.col("severity")).when(F.col("_c") == 0, F.col("category")).otherwise("").alias("value"), "n")


def intent_distribution(keywords: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Keywords per search intent, over all or per the ``by`` columns."""
    rows = keywords.where("keyword <> ''").withColumn("intent", TX.search_intent(F.col("keyword")))
    intents = ["informational", "commercial", "transactional", "navigational"]
    counts = [_n(F.col("intent") == i).alias(i) for i in intents]
    return rows.groupBy(*by).agg(*counts) if by else rows.agg(*counts)


def cannibalised_keywords(pages: DataFrame, k: int | None = 20, shown: int = 6) -> DataFrame:
    """Keywords used by two or more pages of one site, worst first, each with a few of its pages: ``site, keyword, ...``.

    Pages per keyword are counted after distinct (keyword, url) pairs are formed; the sample is taken as the
    smallest URLs by rank, so a keyword on every page never gathers all of them.
    """
    pairs = (
        pages.where("not is_error and url <> ''").select("site", "url", F.explode("keywords").alias("kw"))
        .where(F.length("kw") > 3).select("site", F.lower("kw").alias("keyword"), "url").distinct()
    )
    counts = pairs.groupBy("site", "keyword").agg(F.count(F.lit(1)).alias("page_count")).where("page_count >= 2")
    worst = counts.orderBy(F.desc("page_count"), "site", "keyword").limit(k) if k else counts
    from pyspark.sql import Window

    order = Window.partitionBy("site", "keyword").orderBy("url")
    kept = pairs.join(F.broadcast(worst.select("site", "keyword")) if k else worst.select("site", "keyword"), ["site", "keyword"], "left_semi")
    first = kept.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shown)
    lists = first.groupBy("site", "keyword").agg(F.array_sort(F.collect_list("url")).alias("pages"))
    risk = F.when(F.col("page_count") >= 4, "High").otherwise("Medium")
    return worst.join(lists, ["site", "keyword"]).select("site", "keyword", "page_count", risk.alias("risk_level"), "pages")


def search_analytics_summary(rows: DataFrame) -> DataFrame:
    """Totals of ``clicks``, ``impressions`` and the unweighted mean ``position``."""
    row = rows.agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"),
                   F.round(F.avg("position"), 1).alias("avg_position"))
    ctr = F.when(F.col("impressions") > 0, F.round(100.0 * F.col("clicks") / F.col("impressions"), 2)).otherwise(0.0)
    return row.select("*", ctr.alias("ctr"))


def top_queries(rows: DataFrame, k: int = 25) -> DataFrame:
    ctr = F.when(F.col("impressions") > 0, F.round(100.0 * F.col("clicks") / F.col("impressions"), 2)).otherwise(0.0)
    return rows.orderBy(F.desc("clicks"), "keyword").limit(k).select(
        "keyword", "clicks", "impressions", ctr.alias("ctr"), F.round("position", 1).alias("position"))


def gap_metrics(gaps: DataFrame) -> DataFrame:
    """Counts of missing, weak and strong keywords, mean gap score and volume bands."""
    kinds = [_n(F.col("type") == t).alias(t) for t in ("missing", "weak", "strong")]
    return gaps.agg(
        F.count(F.lit(1)).alias("total"), *kinds, F.coalesce(F.round(F.avg("gap_score"), 0).cast("int"), F.lit(0)).alias("avg_gap"))


def volume_band(volume: Column) -> Column:
    return F.when(volume.isNull(), "unknown").when(volume < 1000, "low").when(volume < 5000, "medium").otherwise("high")


def executive_summary(pages: DataFrame) -> DataFrame:
    """Pages, pages with issues, pages of high priority and mean ranking score; needs ``issues``, ``priority``."""
    return pages.withColumn("_score", ranking_score()).agg(
        F.count(F.lit(1)).alias("pages"), _n(F.size("issues") > 0).alias("with_issues"),
        _n(F.col("priority") == "High").alias("high_priority"), F.round(F.avg("_score"), 1).alias("avg_score"))
