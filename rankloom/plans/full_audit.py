"""Full audit of a crawl: every layer over one table of labelled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.operators import cross_page as CP, page_issues as PI, site_audit as SA, technical as TE
from rankloom.plans.validation_suite import validate_all
from rankloom.session import cut_lineage
from rankloom.sources.tables import kept


def run_full_audit(pages: DataFrame, sitemap: DataFrame | None = None, vitals: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the audit. The labelled pages and the one row of counts are kept; everything else derives from them."""
    labelled = kept(PI.detect_issues(pages), "audited-pages")
    counts = cut_lineage(SA.audit_counts(labelled))
    scored = TE.with_signal_score(labelled.where("not is_error"))
    final = SA.final_score(counts)
    validation = validate_all(labelled, sitemap)
    cross = validation["cross_page_issues"].groupBy("type", "severity").agg(F.count(F.lit(1)).alias("pages"))
    clusters = SA.cluster_scores(counts)
    level = [
        final.select(F.lit("site").alias("level"), F.lit("site").alias("name"), F.col("site_score").alias("score")),
        clusters.select(F.lit("cluster").alias("level"), F.col("cluster").alias("name"), "score"),
        scored.select(F.lit("page").alias("level"), F.col("url").alias("name"), F.col("page_score").alias("score"))]
    return {
        "scores": level[0].unionByName(level[1]).unionByName(level[2]),
        "page_scores": scored.select("url", "page_score", "grade", "deductions", "why"),
        "technical": TE.with_inbound_links(TE.audit_pages(labelled), CP.link_rows(labelled)),
        "canonical_status": CP.canonical_status(labelled.where("not is_error")),
        "coverage": SA.signal_coverage(counts), "clusters": clusters, "cluster_issues": SA.cluster_issues(counts), "gaps": SA.gap_list(counts),
        "security": SA.security_issues(counts), "hsts": SA.hsts_quality(labelled), "performance": SA.performance_issues(counts),
        "web_vitals": SA.web_vital_status(vitals) if vitals is not None else SA.web_vital_proxies(labelled),
        "final": final, "summary": SA.audit_summary(labelled, counts), "roadmap": SA.roadmap(counts, cross), **{f"validation_{k}": v for k, v in validation.items()}}
