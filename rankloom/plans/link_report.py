"""Link-graph report of a crawl."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, functions as F

from rankloom.functions import urls as U
from rankloom.operators import cross_page as CP, link_graph as GR, summaries as SU
from rankloom.plans.tables import Tables


def link_report(pages: DataFrame) -> Tables:
    """Graph, ranks, depths and everything derived from them; needs ``issues`` on the pages.

    The graph is built at once; ranks and depths, which take many rounds, with the first table that needs them.
    """
    graph = GR.build_graph(pages.select("url"), CP.link_rows(pages))
    roots = GR.roots_of(graph)
    depths, ranks = cache(lambda: GR.crawl_depth(graph, roots)), cache(lambda: GR.pagerank(graph))
    lists = pages.groupBy(U.node_key(F.col("url")).alias("url")).agg(F.max("issues").alias("issues"))
    scored = cache(lambda: GR.priority_scores(graph, ranks(), depths(), lists.select("url", F.size("issues").alias("issue_count"))))
    totals = graph.nodes.groupBy("site").agg(F.count(F.lit(1)).alias("total_pages"), F.sum("in_count").alias("total_internal_links"))
    return Tables({
        "totals": lambda: totals, "nodes": lambda: graph.nodes.drop("parts"), "edges": lambda: graph.edges.drop("part"), "pagerank": ranks, "depth": depths,
        "depth_distribution": lambda: GR.depth_distribution(depths()), "orphans": lambda: GR.orphans(graph, depths(), roots),
        "silos": lambda: GR.silo_report(graph, ranks()), "top_pages": lambda: GR.top_pages(graph, ranks(), depths()),
        "depth_summary": lambda: GR.depth_summary(depths()), "priority": lambda: scored().select("site", "url", "priority_score"),
        "needs_attention": lambda: GR.needs_attention(scored(), lists), "image_loading": lambda: SU.image_loading_summary(pages),
        "breadcrumbs": lambda: SU.breadcrumb_summary(pages)})
