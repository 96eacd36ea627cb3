"""Page-speed reports (JSON text per page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Audits read from a report.
TIMINGS = {
    "lcp_ms": "largest-contentful-paint", "inp_ms": "total-blocking-time", "cls": "cumulative-layout-shift",
    "fcp_ms": "first-contentful-paint", "ttfb_ms": "server-response-time", "speed_index_ms": "speed-index", "tti_ms": "interactive",
}
PASS_AUDITS = [
    "document-title", "meta-description", "heading-order", "link-text", "crawlable-anchors", "is-crawlable", "robots-txt", "canonical",
    "structured-data", "hreflang", "image-alt", "font-size", "tap-targets", "plugins", "dom-size",
]
_AUDITS = "map<string,struct<score:double,numericValue:double>>"
REPORT = (
    f"struct<lighthouseResult:struct<categories:map<string,struct<score:double>>,audits:{_AUDITS}>,"
    "loadingExperience:struct<overall_category:string>>"
)
_BLOCKING = (
    "struct<lighthouseResult:struct<audits:struct<`render-blocking-resources`:struct<details:struct<items:"
    "array<struct<url:string,totalBytes:bigint,wastedMs:double>>>>>>>"
)


def band(value: Column, good: float, poor: float) -> Column:
    return F.when(value.isNull(), "Unknown").when(value < good, "Good").when(value < poor, "Needs Improvement").otherwise("Poor")


def flatten_reports(reports: DataFrame) -> DataFrame:
    """Scores, timings, status bands and audit scores of each report (``url, strategy, report``)."""
    audits = F.col("r.lighthouseResult.audits")
    categories = F.col("r.lighthouseResult.categories")

    def number(audit: str) -> Column:
        return F.round(F.try_element_at(audits, F.lit(audit))["numericValue"], 1)

    def category(name: str) -> Column:
        return F.round(100.0 * F.coalesce(F.try_element_at(categories, F.lit(name))["score"], F.lit(0.0)), 1)

    rows = reports.select("url", "strategy", F.from_json("report", REPORT).alias("r"))
    flat = rows.select(
        "url", "strategy", category("performance").alias("perf_score"), category("seo").alias("seo_score"),
        *[number(a).alias(c) for c, a in TIMINGS.items()],
        F.coalesce("r.loadingExperience.overall_category", F.lit("UNKNOWN")).alias("field_data"),
        F.map_filter(audits, lambda k, v: k.isin(PASS_AUDITS)).alias("audits"))
    lcp = F.when(F.col("lcp_ms") > 0, F.col("lcp_ms"))
    return flat.withColumns({"lcp_status": band(lcp, 2500, 4000), "cls_status": band(F.col("cls"), 0.1, 0.25)})


def web_vitals(reports: DataFrame) -> DataFrame:
    """``url, lcp_s, cls, inp_s`` in seconds, the interaction delay from its own audit."""
    audits = F.col("r.lighthouseResult.audits")

    def value(name: str) -> Column:
        return F.try_element_at(audits, F.lit(name))["numericValue"]

    rows = reports.select("url", F.from_json("report", REPORT).alias("r"))
    return rows.select(
        "url", (value("largest-contentful-paint") / 1000).alias("lcp_s"), value("cumulative-layout-shift").alias("cls"),
        (value("interaction-to-next-paint") / 1000).alias("inp_s"))


def render_blocking(reports: DataFrame, shown: int = 10) -> tuple[DataFrame, DataFrame]:
    """Blocking resources: the worst of each page, and count and wasted time per page."""
    items = F.from_json("report", _BLOCKING)["lighthouseResult"]["audits"]["render-blocking-resources"]["details"]["items"]
    rows = reports.select("url", F.explode_outer(items).alias("i")).select(
        "url", F.col("i.url").alias("resource"), F.coalesce("i.totalBytes", F.lit(0)).alias("bytes"),
        F.round(F.coalesce("i.wastedMs", F.lit(0.0)), 1).alias("wasted_ms"), F.col("i").isNotNull().alias("_has"))
    order = Window.partitionBy("url").orderBy(F.desc("wasted_ms"), "resource")
    worst = rows.where("_has").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).drop("_has")
    totals = rows.groupBy("url").agg(
        F.count_if(F.col("_has")).alias("count"), F.round(F.sum(F.when(F.col("_has"), F.col("wasted_ms")).otherwise(0.0)), 1).alias("total_wasted_ms"))
    return worst, totals
