"""Internal link graph: build, PageRank, crawl depth, silos and fix-first priority.

A graph may hold the crawls of many sites. Roots, ranks, depths and extremes are those of each site by itself.

The edge table keeps, per edge, the part of its source (``part``): a source with very many out-links is
split into several parts, so that no task has to handle all of them. Edges are kept partitioned and sorted by source and part, so that a
round of PageRank or of the depth search moves the values of the pages and not the edges.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions import urls as U
from rankloom.operators.skew import salted_join
from rankloom.session import cut_lineage

EDGES_PER_PART = 1_000_000
SMALL_SITES = 100_000  # so many rows of numbers are broadcast, more are joined


@dataclass
class LinkGraph:
    nodes: DataFrame  # url, site, silo, in_count, out_count, parts
    edges: DataFrame  # src, dst, n_links, part; kept by the executors, lost parts are made again from the checkpoint

    def release(self) -> None:
        self.edges.unpersist()


def build_graph(urls: DataFrame, links: DataFrame) -> LinkGraph:
    """Graph of the pages in ``urls`` (``url``) and the links between them (``src``, ``dst``, absolute).

    Links to unknown pages and to the page itself are dropped. Repeated links are one edge with a count.
    """
    names = urls.where("url <> ''").select(U.node_key(F.col("url")).alias("url")).distinct()
    merged = (
        links.where(F.rlike("dst", F.lit("(?i)^https?://")))
        .select(U.node_key(F.col("src")).alias("src"), U.node_key(F.col("dst")).alias("dst"))
        .where("src <> dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("n_links"))
    )
    known = salted_join(merged, names.withColumnRenamed("url", "dst"), ["dst"], F.col("src"), "left_semi")
    known = cut_lineage(known)
    out = known.groupBy("src").agg(F.count(F.lit(1)).alias("out_count"))
    wide = (
        out.where(F.col("out_count") > EDGES_PER_PART).select("src", F.ceil(F.col("out_count") / EDGES_PER_PART).cast("int").alias("parts"))
    )
    edges = known.join(wide, "src", "left").select(
        "src", "dst", "n_links", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int").alias("part")
    )
    ins = known.groupBy("dst").agg(F.sum("n_links").alias("in_count"))
    nodes = (
        names.join(ins.withColumnRenamed("dst", "url"), "url", "left")
        .join(out.withColumnRenamed("src", "url"), "url", "left")
        .join(wide.withColumnRenamed("src", "url"), "url", "left")
        .select(
            "url", U.host(F.col("url")).alias("site"), U.silo(F.col("url")).alias("silo"), F.coalesce("in_count", F.lit(0)).alias("in_count"),
            F.coalesce("out_count", F.lit(0)).alias("out_count"), F.coalesce("parts", F.lit(1)).alias("parts"),
        )
    )
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(edges).repartition(parts, "src", "part").sortWithinPartitions("src", "part")
    placed = placed.persist(StorageLevel.MEMORY_AND_DISK)
    placed.count()  # once kept, their partitioning and order are known to the plans of the rounds
    return LinkGraph(cut_lineage(nodes), placed)


def roots_of(graph: LinkGraph) -> DataFrame:
    """The page of each site with most distinct out-links (``url``); ties go to the first URL."""
    best = F.min(F.struct((-F.col("out_count")).alias("n"), "url")).alias("best")
    return graph.nodes.groupBy("site").agg(best).select("best.url")


def _with_site(rows: DataFrame, stats: DataFrame, n_sites: int) -> DataFrame:
    """Join the row of its site to every page; the pages of a large site are spread."""
    if n_sites <= SMALL_SITES:
        return rows.join(F.broadcast(stats), "site")
    return salted_join(rows, stats, ["site"], F.col("url"))


def _push(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the pages in ``values`` (``url``, ``parts``, ...), with the values of their source."""
    copies = values.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return copies.withColumnRenamed("url", "src").join(edges, ["src", "part"])


def pagerank(graph: LinkGraph, damping: float = 0.85, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """PageRank of every page (``url``, ``pagerank``), summing to one on each site.

    Each round is one join with the edges and one sum; the ranks are checkpointed. The rank held by the pages of a site without out-links
    comes back as one row per site, the change of the round (of the site that moved most) as one number.
    """
    sizes = cut_lineage(graph.nodes.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("out_count") == 0).alias("_dead")))
    n_sites = sizes.count()
    if n_sites == 0:
        return graph.nodes.select("url", F.lit(0.0).alias("pagerank"))
    stats = sizes.select("site", "n", (F.col("_dead") / F.col("n")).alias("stuck"))
    ranks = cut_lineage(_with_site(graph.nodes.select("url", "site", "parts", "out_count"), sizes, n_sites).select(
        "url", "site", "parts", "out_count", (F.lit(1.0) / F.col("n")).alias("rank")))
    for _ in range(rounds):
        shares = ranks.where("out_count > 0").select("url", "parts", (F.col("rank") / F.col("out_count")).alias("share"))
        gained = _push(shares, graph.edges).groupBy(F.col("dst").alias("url")).agg(F.sum("share").alias("gain"))
        new = (1.0 - damping + damping * F.col("stuck")) / F.col("n") + damping * F.coalesce("gain", F.lit(0.0))
        moved = cut_lineage(_with_site(ranks.join(gained, "url", "left"), stats, n_sites).select(
            "url", "site", "parts", "out_count", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        held = F.sum(F.when(F.col("out_count") == 0, F.col("rank")).otherwise(0.0))
        found = moved.groupBy("site").agg(F.count(F.lit(1)).alias("n"), held.alias("stuck"), F.sum("change").alias("change"))
        if n_sites <= SMALL_SITES:  # so few rows come back to the driver and save a job a round
            rows = found.collect()
            change = max(r["change"] for r in rows)
            stats = found.sparkSession.createDataFrame([r[:3] for r in rows], "site string, n long, stuck double")
        else:
            found = cut_lineage(found)
            change, stats = found.agg(F.max("change")).head()[0], found.drop("change")
        ranks = moved.drop("change")
        if change < tolerance:
            break
    totals = ranks.groupBy("site").agg(F.sum("rank").alias("total"))
    return _with_site(ranks, totals, n_sites).select("url", (F.col("rank") / F.col("total")).alias("pagerank"))


def crawl_depth(graph: LinkGraph, roots: DataFrame | None = None) -> DataFrame:
    """Clicks from the root of its site (``url``, ``depth``); -1 where no path leads to the page."""
    roots = roots_of(graph) if roots is None else roots
    frontier = cut_lineage(graph.nodes.join(roots.select("url").distinct(), "url").select("url", "parts"))
    reached = frontier.select("url", F.lit(0).alias("depth"))
    level = 0
    while not frontier.isEmpty():
        level += 1
        found = _push(frontier, graph.edges).select(F.col("dst").alias("url")).distinct()
        fresh = found.join(reached, "url", "left_anti")
        frontier = cut_lineage(graph.nodes.join(fresh, "url").select("url", "parts"))
        reached = reached.unionByName(frontier.select("url", F.lit(level).alias("depth")))
        if level % 5 == 0:
            reached = cut_lineage(reached)
    return graph.nodes.select("url").join(reached, "url", "left").select(
        "url", F.coalesce("depth", F.lit(-1)).alias("depth")
    )


def depth_distribution(depths: DataFrame) -> DataFrame:
    """Pages of each depth on each site."""
    return depths.groupBy(U.host(F.col("url")).alias("site"), "depth").agg(F.count(F.lit(1)).alias("pages")).select(
        "site", F.when(F.col("depth") < 0, "unreachable").otherwise(F.concat(F.lit("depth_"), "depth")).alias("label"), "depth", "pages")


def depth_summary(depths: DataFrame) -> DataFrame:
    """One row per site."""
    return depths.groupBy(U.host(F.col("url")).alias("site")).agg(
        F.greatest(F.max("depth"), F.lit(0)).alias("max_depth"),
        F.count_if(F.col("depth") >= 0).alias("reachable"),
        F.count_if(F.col("depth") < 0).alias("unreachable"),
        F.count(F.lit(1)).alias("total"),
    )


def top_of_sites(rows: DataFrame, order: list[Column], n: int, parts: int = 64) -> DataFrame:
    """The first ``n`` rows (``site``, ``url``, ...) of each site with their ``rank``.

    Ranked in two steps, so that no task orders all pages of a large site: within parts of a site, then what is left of them.
    """
    part = F.pmod(F.xxhash64("url"), F.lit(parts))
    inner = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("site", "_part").orderBy(*order)))
    best = inner.where(F.col("rank") <= n).drop("_part")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*order))).where(F.col("rank") <= n)


def orphans(graph: LinkGraph, depths: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Pages without inbound links, the roots excepted."""
    roots = roots_of(graph) if roots is None else roots
    alone = graph.nodes.where("in_count = 0").join(roots.select("url"), "url", "left_anti")
    return alone.join(depths, "url").select("url", "silo", "depth", F.col("out_count").alias("out_links"))


def silo_report(graph: LinkGraph, ranks: DataFrame) -> DataFrame:
    """Pages, rank, inbound links and outbound links to other silos, per site and first path segment.

    Site and silo follow from the URL, so the edges need no join to find those of their ends.
    """
    per_silo = graph.nodes.join(ranks, "url").groupBy("site", "silo").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.sum("pagerank").alias("_rank"),
        F.sum("in_count").alias("total_in_links"),
    )
    src, dst = (F.struct(U.host(F.col(c)).alias("site"), U.silo(F.col(c)).alias("silo")) for c in ("src", "dst"))
    crossing = graph.edges.where(src != dst).groupBy(src.alias("s")).agg(F.sum("n_links").alias("cross_silo_links")).select("s.*", "cross_silo_links")
    return per_silo.join(crossing, ["site", "silo"], "left").select(
        "site", "silo", "page_count", F.round("_rank", 6).alias("total_pagerank"),
        F.round(F.col("_rank") / F.col("page_count"), 6).alias("avg_pagerank"), "total_in_links",
        F.coalesce("cross_silo_links", F.lit(0)).alias("cross_silo_links"),
    )


def top_pages(graph: LinkGraph, ranks: DataFrame, depths: DataFrame, n: int = 20) -> DataFrame:
    """The pages of the highest rank of each site."""
    joined = graph.nodes.join(ranks, "url").join(depths, "url")
    return top_of_sites(joined, [F.desc("pagerank"), F.col("url")], n).select(
        "site", "rank", "url", F.round("pagerank", 6).alias("pagerank"), F.col("in_count").alias("in_links"),
        F.col("out_count").alias("out_links"), "depth", "silo",
    )


def priority_scores(graph: LinkGraph, ranks: DataFrame, depths: DataFrame, issue_counts: DataFrame) -> DataFrame:
    """Fix-first score: mean of shallowness, scaled rank and share of issues, each against the extremes of its site.

    ``issue_counts`` has ``url`` (node form) and ``issue_count``.
    """
    rows = (
        graph.nodes.select("url", "site", "in_count").join(ranks, "url").join(depths, "url")
        .join(issue_counts, "url", "left")
        .withColumn("issue_count", F.coalesce("issue_count", F.lit(0)))
    )
    rows = cut_lineage(rows)
    extremes = cut_lineage(rows.groupBy("site").agg(
        F.max(F.when(F.col("depth") >= 0, F.col("depth"))).alias("_deepest"), F.min("pagerank").alias("_low"), F.max("pagerank").alias("_high"),
        F.max("issue_count").alias("_most")))
    rows = _with_site(rows, extremes, extremes.count())
    nonzero = lambda c: F.when(c != 0, c).otherwise(1)
    shallow = F.when(F.col("depth") < 0, 0.0).otherwise(1.0 - F.col("depth") / nonzero(F.coalesce("_deepest", F.lit(1))))
    scaled = (F.col("pagerank") - F.col("_low")) / nonzero(F.col("_high") - F.col("_low"))
    share = F.col("issue_count") / nonzero(F.col("_most"))
    return rows.withColumn("priority_score", F.round((shallow + scaled + share) / 3.0, 4)).drop("_deepest", "_low", "_high", "_most")


def needs_attention(scored: DataFrame, issues: DataFrame, n: int = 20, shown: int = 5) -> DataFrame:
    """The ``n`` pages of each site to fix first, each with a few of its issues (``url`` in node form, ``issues``)."""
    top = cut_lineage(top_of_sites(scored, [F.desc("priority_score"), F.col("url")], n))
    lists = issues.join(top.select("url"), "url", "left_semi")
    return top.join(lists, "url", "left").select(
        "site", "rank", "url", "priority_score", F.col("depth").alias("crawl_depth"), F.round("pagerank", 6).alias("pagerank"),
        "issue_count", F.slice(F.coalesce("issues", F.array().cast("array<string>")), 1, shown).alias("issues"),
        F.col("in_count").alias("in_links"),
    )
