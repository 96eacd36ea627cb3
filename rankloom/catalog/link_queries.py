"""Queries over the link tables: graph, PageRank, broken links."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import view
from rankloom.catalog.registry import once, query
from rankloom.operators import cross_page as CP, link_graph as GR


V = ("fx_link_nodes", "fx_links")
_GRAPHS: dict[tuple[str, str], tuple] = {}


def links(spark, sf):
    """The link table, kept as a crawl would keep it."""
    return once(spark, sf, "links", lambda: view(spark, sf, "fx_links"))


def link_nodes(spark, sf):
    return once(spark, sf, "link-nodes", lambda: view(spark, sf, "fx_link_nodes"))


def graph(spark, sf):
    return _parts(spark, sf)[0]


def _parts(spark, sf):
    """Graph, depths and ranks, computed once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _GRAPHS:
        g = GR.build_graph(link_nodes(spark, sf), links(spark, sf))
        _GRAPHS[key] = [g, None, None]
    return _GRAPHS[key]


def depths(spark, sf):
    parts = _parts(spark, sf)
    if parts[1] is None:
        parts[1] = GR.crawl_depth(parts[0])
    return parts[1]


def ranks(spark, sf):
    parts = _parts(spark, sf)
    if parts[2] is None:
        parts[2] = GR.pagerank(parts[0])
    return parts[2]


def issue_counts(spark, sf):
    """Issues per page: its broken and redirected links, and its own error status."""
    rows = CP.bad_targets_by_page(links(spark, sf), link_nodes(spark, sf))
    return rows.groupBy(F.col("src").alias("url")).agg(F.sum("n").alias("issue_count"))


def issue_lists(spark, sf):
    rows = CP.bad_targets_by_page(links(spark, sf), link_nodes(spark, sf))
    label = F.concat_ws(" ", "kind", F.col("n").cast("string"))
    return rows.groupBy(F.col("src").alias("url")).agg(F.array_sort(F.collect_list(label)).alias("issues"))


EDGES = """e AS (select src, dst, count(*) as n from fx_links where src <> dst and dst in (select url from fx_link_nodes) group by src, dst)"""
OUT = "o AS (select src, count(*) as n from e group by src)"
ROOT = "r AS (select n.url from fx_link_nodes n left join o on o.src = n.url order by coalesce(o.n, 0) desc, n.url limit 1)"
BFS = """b AS (select url, 0 as depth from r UNION select e.dst, b.depth + 1 from b join e on e.src = b.url where b.depth < 200),
 dep AS (select n.url, cast(coalesce(min(b.depth), -1) as int) as depth from fx_link_nodes n left join b on b.url = n.url group by n.url)"""
PR = """cnt AS (select count(*) as n from fx_link_nodes), nod AS (select n.url, coalesce(o.n, 0) as k from fx_link_nodes n left join o on o.src = n.url),
 pr AS (select 0 as i, url, k, 1.0 / (select n from cnt)::double as rank from nod
  UNION ALL select * from (with cur as (select * from pr), gain as (select e.dst, sum(c.rank / c.k) as g from cur c join e on e.src = c.url group by e.dst),
   dang as (select coalesce(sum(rank), 0) as d from cur where k = 0)
   select c.i + 1, c.url, c.k, (0.15 + 0.85 * (select d from dang)) / (select n from cnt) + 0.85 * coalesce(g.g, 0) from cur c left join gain g on g.dst = c.url where c.i < 50) t),
 fin AS (select url, rank / sum(rank) over () as pagerank from pr where i = 50)"""
ISS = """iss AS (select l.src as url, count(*) as n from fx_links l join fx_link_nodes t on t.url = l.dst where t.status_code >= 400 or t.redirect_hops > 1 group by l.src)"""


@query("gra_01_edges", V, f"WITH {EDGES} select src, dst, n as n_links from e")
def _(spark, sf):
    return graph(spark, sf).edges.select("src", "dst", "n_links")


@query("gra_01_nodes", V, f"""WITH {EDGES}, {OUT}, i AS (select dst, sum(n) as n from e group by dst)
 select n.url, split_part(n.url, '/', 4) as silo, cast(coalesce(i.n, 0) as bigint) as in_count, coalesce(o.n, 0) as out_count from fx_link_nodes n left join o on o.src = n.url left join i on i.dst = n.url""")
def _(spark, sf):
    return graph(spark, sf).nodes.select("url", "silo", "in_count", "out_count")


@query("gra_02_pagerank", V, f"WITH RECURSIVE {EDGES}, {OUT}, {PR} select url, round(pagerank, 4) as pagerank from fin")
def _(spark, sf):
    return ranks(spark, sf).select("url", F.round("pagerank", 4).alias("pagerank"))


@query("gra_03_crawl_depth", V, f"WITH RECURSIVE {EDGES}, {OUT}, {ROOT}, {BFS} select url, depth from dep")
def _(spark, sf):
    return depths(spark, sf)


@query("gra_04_depth_distribution", V, f"WITH RECURSIVE {EDGES}, {OUT}, {ROOT}, {BFS} select split_part(url, '/', 3) as site, case when depth < 0 then 'unreachable' else concat('depth_', depth) end as label, depth, count(*) as pages from dep group by 1, depth")
def _(spark, sf):
    return GR.depth_distribution(depths(spark, sf))


@query("gra_04_depth_summary", V, f"""WITH RECURSIVE {EDGES}, {OUT}, {ROOT}, {BFS} select split_part(url, '/', 3) as site, greatest(max(depth), 0) as max_depth, count(*) filter (depth >= 0) as reachable,
 count(*) filter (depth < 0) as unreachable, count(*) as total from dep group by 1""")
def _(spark, sf):
    return GR.depth_summary(depths(spark, sf))


@query("gra_05_orphans", V, f"""WITH RECURSIVE {EDGES}, {OUT}, {ROOT}, {BFS} select d.url, split_part(d.url, '/', 4) as silo, d.depth, coalesce(o.n, 0) as out_links from dep d left join o on o.src = d.url
 where d.url not in (select dst from e) and d.url not in (select url from r)""")
def _(spark, sf):
    return GR.orphans(graph(spark, sf), depths(spark, sf))


@query("gra_06_silos", V, f"""WITH RECURSIVE {EDGES}, {OUT}, {PR}, i AS (select dst, sum(n) as n from e group by dst),
 s AS (select split_part(f.url, '/', 3) as site, split_part(f.url, '/', 4) as silo, count(*) as page_count, sum(pagerank) as p, cast(sum(coalesce(i.n, 0)) as bigint) as total_in_links from fin f left join i on i.dst = f.url group by 1, 2),
 x AS (select split_part(src, '/', 3) as site, split_part(src, '/', 4) as silo, cast(sum(n) as bigint) as n from e where (split_part(src, '/', 3), split_part(src, '/', 4)) <> (split_part(dst, '/', 3), split_part(dst, '/', 4)) group by 1, 2)
 select s.site, s.silo, page_count, round(p, 4) as total_pagerank, total_in_links, coalesce(x.n, 0) as cross_silo_links from s left join x using (site, silo)""")
def _(spark, sf):
    out = GR.silo_report(graph(spark, sf), ranks(spark, sf))
    return out.select("site", "silo", "page_count", F.round("total_pagerank", 4).alias("total_pagerank"), "total_in_links", "cross_silo_links")


@query("gra_07_top_pages", V, f"""WITH RECURSIVE {EDGES}, {OUT}, {ROOT}, {BFS}, {PR}, i AS (select dst, sum(n) as n from e group by dst)
 select split_part(f.url, '/', 3) as site, f.url, round(f.pagerank, 4) as pagerank, cast(coalesce(i.n, 0) as bigint) as in_links, coalesce(o.n, 0) as out_links, d.depth from fin f join dep d using (url)
 left join i on i.dst = f.url left join o on o.src = f.url qualify row_number() over (partition by split_part(f.url, '/', 3) order by round(f.pagerank, 9) desc, f.url) <= 20""")
def _(spark, sf):
    out = GR.top_pages(graph(spark, sf), ranks(spark, sf).withColumn("pagerank", F.round("pagerank", 9)), depths(spark, sf))
    return out.select("site", "url", F.round("pagerank", 4).alias("pagerank"), "in_links", "out_links", "depth")


PRIO = f"""{EDGES}, {OUT}, {ROOT}, {BFS}, {PR}, {ISS}, j AS (select f.url, f.pagerank, d.depth, coalesce(iss.n, 0) as issue_count from fin f join dep d using (url) left join iss using (url)),
 m AS (select max(case when depth >= 0 then depth end) as dm, min(pagerank) as lo, max(pagerank) as hi, max(issue_count) as im from j),
 p AS (select url, issue_count, depth, ((case when depth < 0 then 0 else 1 - depth / cast(coalesce(nullif(dm, 0), 1) as double) end) + (pagerank - lo) / (hi - lo) + issue_count / cast(coalesce(nullif(im, 0), 1) as double)) / 3 as score from j, m)"""


@query("gra_08_priority", V, f"WITH RECURSIVE {PRIO} select url, issue_count, depth, round(score, 2) as priority_score from p")
def _(spark, sf):
    out = GR.priority_scores(graph(spark, sf), ranks(spark, sf), depths(spark, sf), issue_counts(spark, sf))
    return out.select("url", "issue_count", "depth", F.round("priority_score", 2).alias("priority_score"))


@query("gra_09_needs_attention", V, f"""WITH RECURSIVE {PRIO}, kinds AS (select l.src as url, case when t.status_code >= 400 then 'broken' else 'redirect' end as kind, count(*) as n from fx_links l join fx_link_nodes t on t.url = l.dst
 where t.status_code >= 400 or t.redirect_hops > 1 group by 1, 2), ll AS (select url, string_agg(concat(kind, ' ', n), ', ' order by concat(kind, ' ', n)) as issues from kinds group by url)
 select split_part(p.url, '/', 3) as site, cast(row_number() over (partition by split_part(p.url, '/', 3) order by round(score, 4) desc, p.url) as int) as rank, p.url, round(score, 2) as priority_score, depth as crawl_depth, issue_count, coalesce(issues, '') as issues from p left join ll using (url) qualify rank <= 20""")
def _(spark, sf):
    scored = GR.priority_scores(graph(spark, sf), ranks(spark, sf), depths(spark, sf), issue_counts(spark, sf))
    out = GR.needs_attention(scored, issue_lists(spark, sf))
    return out.select("site", "rank", "url", F.round("priority_score", 2).alias("priority_score"), "crawl_depth", "issue_count", F.array_join("issues", ", ").alias("issues"))


@query("jon_01_broken_links", V, """select 'broken_internal_link' as type, case when t.status_code >= 500 then 'CRITICAL' else 'HIGH' end as severity, l.src as source, l.dst as target, t.status_code as status
 from fx_links l join fx_link_nodes t on t.url = l.dst where t.status_code >= 400""")
def _(spark, sf):
    return CP.broken_links(links(spark, sf), link_nodes(spark, sf))


@query("jon_02_bad_targets_by_page", V, """WITH h AS (select l.src, l.dst, case when t.status_code >= 400 then 'broken' else 'redirect' end as kind from fx_links l join fx_link_nodes t on t.url = l.dst
 where t.status_code >= 400 or t.redirect_hops > 1), k AS (select *, row_number() over (partition by src, kind order by dst) as rn, count(*) over (partition by src, kind) as n from h)
 select src, kind, n, string_agg(dst, ' ' order by dst) as targets from k where rn <= 20 group by src, kind, n""")
def _(spark, sf):
    out = CP.bad_targets_by_page(links(spark, sf), link_nodes(spark, sf))
    return out.select("src", "kind", "n", F.array_join("targets", " ").alias("targets"))


@query("jon_03_widely_linked_dead", V, """select l.dst as url, t.status_code as status, count(distinct l.src) as sources from fx_links l join fx_link_nodes t on t.url = l.dst
 where t.status_code >= 400 group by 1, 2 having count(distinct l.src) > 5""")
def _(spark, sf):
    return CP.widely_linked_dead(links(spark, sf), link_nodes(spark, sf))
