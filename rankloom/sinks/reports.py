"""Report tables and the snapshot history."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions.scores import letter_grade
from rankloom.operators import summaries as SU, technical as TE
from rankloom.plans.tables import Tables


def page_report(pages: DataFrame) -> DataFrame:
    """Flat row per page: lists joined, ranking score and grade, priority."""
    out = pages.withColumn("ranking_score", TE.ranking_score())
    return out.select(
        "url", F.col("status_code").alias("status"), "title", F.col("meta_description").alias("meta"), F.array_join("h1", " | ").alias("h1"),
        F.array_join(F.slice("h2", 1, 3), " | ").alias("h2"), "canonical", F.array_join("keywords", ", ").alias("keywords"),
        F.array_join("issues", " | ").alias("issues"), "priority", "competition", "ranking_score", letter_grade(F.col("ranking_score")).alias("grade"))


def issue_detail(pages: DataFrame) -> DataFrame:
    return pages.select("url", "title", "priority", F.explode("issues").alias("issue"))


def technical_report(audits: DataFrame) -> DataFrame:
    """Flat row per page of the technical audit."""
    return audits.select(
        "url", "tech_score", "tech_grade", "indexability", F.col("a_title.status").alias("title"), F.col("a_meta.status").alias("meta"),
        F.col("a_canonical.status").alias("canonical"), F.col("a_headings.h1_status").alias("h1"), F.col("a_og.completeness").alias("open_graph"),
        F.col("a_content.depth").alias("content"), F.col("a_url.depth").alias("url_depth"), F.array_join("all_issues", " | ").alias("issues"))


def full_report(pages: DataFrame) -> dict[str, DataFrame]:
    """Pages, issues, technical audit and executive summary."""
    return {
        "pages": page_report(pages), "issues": issue_detail(pages), "technical": technical_report(TE.audit_pages(pages, parts=[])),
        "summary": SU.executive_summary(pages)}


def technical_tables(pages: DataFrame) -> dict[str, DataFrame]:
    audits = TE.audit_pages(pages, parts=[])
    return {"technical": technical_report(audits), "summary": SU.technical_summary(audits)}


def competitor_tables(benchmark: Mapping[str, DataFrame], speed: DataFrame, pages: DataFrame, gaps: int = 100) -> Tables:
    """Score comparison, keyword gaps, page speed, action plan and crawl errors."""
    first = [F.desc("competitor_count"), F.desc("opportunity_score"), "keyword"]
    return Tables({
        "scores": lambda: benchmark["scores"], "keyword_gaps": lambda: benchmark["keyword_gap"].orderBy(*first).limit(gaps), "page_speed": lambda: speed,
        "actions": lambda: benchmark["actions"],
        "errors": lambda: pages.where("is_error").select("site", "url", "status_code", F.col("title").alias("note"))})


def write_tables(tables: Mapping[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        if kind == "csv":
            writer = writer.option("header", True)
        writer.format(kind).save(f"{folder.rstrip('/')}/{name}")


def snapshot(pages: DataFrame, project: Column, crawled_at: Column, shown: int = 100) -> tuple[DataFrame, DataFrame]:
    """Totals of a crawl and its worst pages; needs ``issues``, ``priority`` and ``score`` on the pages."""
    real = pages.where("not is_error")
    totals = real.agg(
        F.count(F.lit(1)).alias("page_count"), F.count_if(F.size("issues") > 0).alias("issue_count"),
        F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("health_score"))
    worst = real.orderBy("score", "url").limit(shown).select(
        "url", F.substring("title", 1, 100).alias("title"), "score", "issues", "priority")
    stamp = [project.alias("project_id"), crawled_at.alias("crawled_at")]
    return totals.select(*stamp, "*"), worst.select(*stamp, "*")


def append_snapshot(pages: DataFrame, folder: str, project: Column, crawled_at: Column) -> None:
    """Add a snapshot to the history, a partition per project and time of crawl; a job that runs again replaces its own snapshot only."""
    for name, rows in zip(("totals", "pages"), snapshot(pages, project, crawled_at)):
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id", "crawled_at")
        writer.parquet(f"{folder.rstrip('/')}/{name}")
