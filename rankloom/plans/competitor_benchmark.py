"""Benchmark of a target site against its competitors, all in one page table."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, functions as F

from rankloom import lookups as L
from rankloom.functions import urls as U
from rankloom.operators import benchmark as BM, keyword_sets as KS, summaries as SU, text_mining as TM
from rankloom.plans.tables import Tables
from rankloom.sources.tables import kept


def run_benchmark(pages: DataFrame, reports: DataFrame, target: str, year: int, authority: DataFrame | None = None,
                  text=None) -> Tables:
    """Tables of the benchmark. ``pages`` has ``site`` and labels in ``issues``; ``reports`` are flattened page-speed reports.

    Sites with loaded pages are scored from them, others from their report; ``source`` says which. The scores are
    computed and kept with the first table that needs them.
    """
    def site_scores() -> DataFrame:
        speed = reports.select(U.host(F.col("url")).alias("site"), "perf_score", "lcp_ms", "cls")
        crawled = BM.site_scores(pages, speed, authority, year).where("technical is not null").withColumn("source", F.lit("crawl"))
        derived = BM.scores_from_report(reports).withColumn("site", U.host(F.col("url")))
        derived = derived.groupBy("site").agg(*[F.round(F.avg(d), 1).alias(d) for d in L.DIMENSION_WEIGHTS]).withColumn("source", F.lit("report"))
        sites = pages.select("site").unionByName(derived.select("site")).distinct()
        known = crawled.unionByName(derived.join(crawled.select("site"), "site", "left_anti"))
        return kept(BM.with_composite(sites.join(known, "site", "left").withColumn("source", F.coalesce("source", F.lit("no_data")))), "site-scores")

    scores = cache(site_scores)
    keywords = pages.select("site", F.explode("keywords").alias("keyword"))
    text = text if text is not None else TM.page_text()
    return Tables({
        "scores": scores, "matrix": lambda: BM.dimension_matrix(scores()), "actions": lambda: BM.action_list(scores(), target),
        "keyword_gap": lambda: KS.competitor_gap(keywords, target, k=None), "similarity": lambda: TM.site_similarity(pages, text, target),
        "cannibalised": lambda: SU.cannibalised_keywords(pages.where(F.col("site") == target)), "intents": lambda: SU.intent_distribution(keywords, ["site"])})
