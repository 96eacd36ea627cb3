"""Validation of a crawl: page issues, cross-page issues, duplicate maps and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rankloom.operators import cross_page as CP, page_issues as PI


def cross_page_issues(pages: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """All cross-page issues in one table; columns a check does not fill are null."""
    links = CP.link_rows(pages)
    titles, metas = CP.duplicate_titles(pages), CP.duplicate_descriptions(pages)

    def shared(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(F.lit(kind).alias("type"), F.lit("HIGH").alias("severity"), "url", F.col("key").alias("value"), F.col("n_rows").alias("group_size"))

    canonical = CP.canonical_problems(pages)
    # A loop is reported once, for its first page; a chain for the page nothing points to.
    inner = CP.canonical_targets(pages).select(F.col("nxt").alias("url")).distinct()
    loops = canonical.where("is_head")
    chains = canonical.where("type = 'canonical_chain'").join(inner, "url", "left_anti")
    hreflang = CP.hreflang_not_returned(pages).select(
        F.lit("hreflang_missing_reciprocal").alias("type"), F.lit("HIGH").alias("severity"), F.col("src").alias("source"), F.col("dst").alias("target"), F.col("lang").alias("value"))
    default = CP.hreflang_without_default(pages).select(F.lit("hreflang_missing_xdefault").alias("type"), F.lit("MEDIUM").alias("severity"), "url")
    orphans = CP.orphan_pages(pages).select(F.lit("orphan_page").alias("type"), F.lit("MEDIUM").alias("severity"), "url")
    parts = [
        loops.unionByName(chains).select("type", "severity", "url", F.array_join("path", " ").alias("value"), "hops"), CP.broken_links(links, pages),
        shared(CP.duplicate_content(pages), "duplicate_content"), hreflang, default, CP.pagination_breaks(pages), orphans,
        shared(titles, "duplicate_title"), shared(metas, "duplicate_meta_description")]
    if sitemap is not None:
        parts.append(CP.sitemap_conflicts(pages, sitemap).where("type in ('sitemap_noindex', 'sitemap_missing')"))
    return CP.cross_issue_union(*parts)


def validate_all(pages: DataFrame, sitemap: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the suite: ``page_issues``, ``cross_page_issues``, ``hreflang``, ``titles``, ``descriptions``, ``stats``."""
    page = PI.validate_pages(pages)
    cross = cross_page_issues(pages, sitemap)
    stats = page.agg(F.count(F.lit(1)).alias("pages_analysed"), F.count_if(F.col("issue_count") > 0).alias("pages_with_issues")).unionByName(
        cross.agg(F.count(F.lit(1)).alias("cross_page_count")), allowMissingColumns=True)
    stats = stats.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("pages_analysed", "pages_with_issues", "cross_page_count")])
    return {
        "page_issues": page, "cross_page_issues": cross, "hreflang": CP.hreflang_rows(pages), "titles": CP.duplicate_titles(pages),
        "descriptions": CP.duplicate_descriptions(pages), "stats": stats}
