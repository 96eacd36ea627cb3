"""Queries that compare pages, count over the site or shape result views."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import fx_addresses, fx_pages, table
from rankloom.catalog.page_queries import (
    DUP_SQL, INDEX_SQL, LETTER, P, RANKING_CTE, TECH_SCORE, WC, WS, intent_sql,
)
from rankloom.catalog.registry import once, query
from rankloom.operators import cross_page as CP, page_issues as PI, summaries as SU, technical as TE, views as VW

def labelled(spark, sf):
    """Pages with light labels, priority and ranking score, kept as a table."""

    def build():
        pages = PI.detect_issues(fx_pages(spark, sf))
        return pages.withColumn("priority", PI.priority_label(F.col("issues"))).withColumn("score", TE.ranking_score())

    return once(spark, sf, "labelled-pages", build)


LABELS_CTE = f"""rows AS ({DUP_SQL}), pr AS (select p.url, count(r.issue) as n_issues, case when count(r.issue) = 0 then ''
 when count(*) filter (r.issue in ('Broken Page', 'Missing Title')) > 0 then 'High'
 when count(*) filter (r.issue in ('Missing Meta Description', 'Missing H1', 'Duplicate Meta Description', 'Multiple H1 Tags')) > 0 then 'Medium' else 'Low' end as priority,
 list(r.issue order by r.issue) filter (r.issue is not null) as ls from fx_pages p left join rows r using (url) group by p.url), lp AS (select p.*, pr.n_issues, pr.priority, coalesce(pr.ls, []) as ls from fx_pages p join pr using (url))"""

# Canonical walk: pages by stripped URL, their foreign canonical, and the path from each start.
WALK = """cn AS (select rtrim(url, '/') as src, min(rtrim(trim(canonical), '/')) as nxt from fx_pages where rtrim(trim(canonical), '/') <> '' and rtrim(trim(canonical), '/') <> rtrim(url, '/') group by 1),
 kn AS (select distinct rtrim(url, '/') as u from fx_pages),
 w AS (select src as start, [src, nxt] as path, nxt as cur, case when nxt not in (select u from kn) then 'left' when nxt not in (select src from cn) then 'end' else 'open' end as state, 1 as hops from cn
  UNION ALL select w.start, list_append(w.path, c.nxt), c.nxt, case when list_contains(w.path, c.nxt) then 'loop' when c.nxt not in (select u from kn) then 'left' when c.nxt not in (select src from cn) then 'end' else 'open' end, w.hops + 1
   from w join cn c on c.src = w.cur where w.state = 'open' and w.hops < 500)"""


@query("jon_04_canonical_chains_and_loops", P, f"""WITH RECURSIVE {WALK}, d AS (select start, state, case when state = 'left' then path[1:len(path) - 1] else path end as path from w where state <> 'open')
 select case when state = 'loop' then 'canonical_loop' else 'canonical_chain' end as type, case when state = 'loop' then 'CRITICAL' else 'HIGH' end as severity, start as url, cast(len(path) - 1 as int) as hops, array_to_string(path[1:65], ' ') as path
 from d where state = 'loop' or len(path) > 2""")
def _(spark, sf):
    return CP.canonical_problems(fx_addresses(spark, sf)).drop("is_head").withColumn("path", F.array_join("path", " "))


@query("jon_05_canonical_status", P, f"""WITH RECURSIVE {WALK}, d AS (select start, state, len(path) - 1 as n from w where state <> 'open'), e AS (select start, state, n, n - (state = 'loop')::int >= 5 as deep from d)
 select p.url, case when deep then 'too_deep' when e.state = 'loop' then 'loop' when e.state = 'left' then 'broken_target' when e.state = 'end' then 'ok'
 when rtrim(trim(p.canonical), '/') = rtrim(p.url, '/') then 'self' else 'ok' end as status, cast(case when deep then 6 else coalesce(n, 0) + 1 end as int) as length from fx_pages p left join e on e.start = rtrim(p.url, '/')""")
def _(spark, sf):
    return CP.canonical_status(fx_addresses(spark, sf))


@query("jon_06_canonical_bad_target", P, """WITH t AS (select lower(rtrim(url, '/')) as target, bool_or(robots_noindex or contains(lower(robots_meta), 'noindex') or contains(lower(x_robots_tag), 'noindex')) as ni, max(status_code) as st from fx_pages group by 1),
 h AS (select p.url, t.* from fx_pages p join t on t.target = lower(rtrim(p.canonical, '/')) where p.canonical <> '' and lower(rtrim(p.canonical, '/')) <> lower(rtrim(p.url, '/')))
 select url, target, 'canonical_to_noindex' as type from h where ni UNION ALL select url, target, 'canonical_to_error_page' from h where st >= 400""")
def _(spark, sf):
    return CP.canonical_bad_target(fx_addresses(spark, sf))


@query("jon_07_canonical_and_noindex", P, """select rtrim(url, '/') as url, rtrim(canonical, '/') as canonical from fx_pages where canonical <> '' and rtrim(canonical, '/') <> rtrim(url, '/')
 and (robots_noindex or contains(lower(robots_meta), 'noindex') or contains(lower(x_robots_tag), 'noindex'))""")
def _(spark, sf):
    return CP.canonical_and_noindex(fx_addresses(spark, sf))


TAGS = "tg AS (select rtrim(url, '/') as src, t.lang as lang, rtrim(t.href, '/') as dst from (select url, unnest(hreflang_tags) as t from fx_pages) a)"


@query("jon_08_hreflang_not_returned", P, f"WITH {TAGS} select src, lang, dst from tg where src <> dst and dst in (select rtrim(url, '/') from fx_pages) and not exists (select 1 from tg b where b.src = tg.dst and b.dst = tg.src)")
def _(spark, sf):
    return CP.hreflang_not_returned(fx_addresses(spark, sf))


@query("jon_08_hreflang_not_returned_direct", P, f"WITH {TAGS} select src, lang, dst from tg where lang <> 'x-default' and not exists (select 1 from tg b where b.src = tg.dst and b.dst = tg.src)")
def _(spark, sf):
    return CP.hreflang_not_returned(fx_addresses(spark, sf), direct=True)


@query("jon_09_hreflang_not_canonical", P, f"WITH {TAGS} select tg.src, tg.lang, tg.dst, p.c as canonical from tg join (select rtrim(url, '/') as k, min_by(rtrim(canonical, '/'), (status_code, rtrim(canonical, '/'))) as c from fx_pages group by 1) p on p.k = tg.dst where p.c <> '' and p.c <> tg.dst")
def _(spark, sf):
    return CP.hreflang_not_canonical(fx_pages(spark, sf))


@query("jon_10_pagination_breaks", P, """WITH m AS (select rtrim(url, '/') as url, min_by(pagination_prev, (status_code, pagination_prev)) as pagination_prev from fx_pages group by 1), r AS (select rtrim(p.url, '/') as source, rtrim(p.pagination_next, '/') as nxt, rtrim(p.pagination_prev, '/') as prv, n.url as nu, rtrim(n.pagination_prev, '/') as back, v.url as vu from fx_pages p
  left join m n on n.url = rtrim(p.pagination_next, '/') left join m v on v.url = rtrim(p.pagination_prev, '/') where not p.is_error)
 select 'pagination_next_not_crawled' as type, 'HIGH' as severity, source, nxt as target from r where nxt <> '' and nu is null
 UNION ALL select 'pagination_missing_reciprocal', 'HIGH', source, nxt from r where nxt <> '' and nu is not null and back <> source
 UNION ALL select 'pagination_prev_not_crawled', 'MEDIUM', source, prv from r where not (nxt <> '' and nu is null) and prv <> '' and vu is null""")
def _(spark, sf):
    return CP.pagination_breaks(fx_pages(spark, sf))


@query("jon_11_orphan_pages", P, """select rtrim(url, '/') as url from fx_pages where not is_error and rtrim(url, '/') not in (select rtrim(unnest(links), '/') from fx_pages where not is_error)
 and rtrim(url, '/') not in (select rtrim(url, '/') from (select site, url, case when is_error then 0 else len(links) end as n from fx_pages) t qualify row_number() over (partition by site order by n desc, url) = 1)""")
def _(spark, sf):
    return CP.orphan_pages(fx_pages(spark, sf))


def sitemap(spark, sf):
    """Sitemap derived from the pages: every page but those of one section, plus one address per page never crawled."""
    pages = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "#.*$", "").alias("u"))
    listed = F.when(F.col("page_id") % 7 == 3, F.array(F.concat("u", F.lit("/gone")))).otherwise(F.array(F.col("u")))
    return pages.select(F.explode(listed).alias("url"), "page_id")


SITEMAP = "sm AS (select case when page_id % 7 = 3 then concat(u, '/gone') else u end as url, page_id from (select page_id, regexp_replace(url, '#.*$', '') as u from pages) t)"


@query("jon_12_sitemap_conflicts", P, f"""WITH {SITEMAP}, s AS (select distinct rtrim(url, '/') as k from sm), c AS (select rtrim(url, '/') as k, bool_or(robots_noindex or contains(robots_meta, 'noindex')) as ni, bool_or(is_error or status_code >= 400) as er, bool_or(not is_error) as ok from fx_pages group by 1)
 select k as url, 'sitemap_noindex' as type, 'CRITICAL' as severity from s join c using (k) where ni UNION ALL select k, 'sitemap_error_page', 'CRITICAL' from s join c using (k) where er
 UNION ALL select k, 'sitemap_missing', 'MEDIUM' from s left join c using (k) where not coalesce(ok, false) UNION ALL select k, 'not_in_sitemap', 'LOW' from c where k not in (select k from s)""")
def _(spark, sf):
    return CP.sitemap_conflicts(fx_pages(spark, sf), sitemap(spark, sf))


def robots_rules(spark, sf):
    """Disallow rules per site: two per site found in the pages."""
    sites = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site")).distinct()
    rules = F.array(F.struct(F.lit(1).alias("pos"), F.lit("/en/2").alias("path")), F.struct(F.lit(2).alias("pos"), F.lit("/de").alias("path")),
                    F.struct(F.lit(3).alias("pos"), F.when(F.length("site") % 5 == 0, "/").otherwise("/private").alias("path")))
    return sites.select("site", F.explode(rules).alias("r")).select("site", "r.pos", "r.path")


RULES = "ru AS (select site, pos, path from (select distinct regexp_extract(url, '^https?://([^/]+)', 1) as site from pages) s, lateral (values (1, '/en/2'), (2, '/de'), (3, case when length(site) % 5 = 0 then '/' else '/private' end)) v(pos, path))"
_PATH = "coalesce(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ''), '/')"


@query("jon_13_robots_blocked", P, f"""WITH {RULES}, {SITEMAP}, m AS (select p.site, p.url, p.path, ru.path as rule, row_number() over (partition by p.url order by ru.pos) as rn from (select site, url, {_PATH} as path from fx_pages) p join ru on ru.site = p.site and starts_with(p.path, ru.path))
 select site, url, path, rule, lower(rtrim(url, '/')) in (select lower(rtrim(url, '/')) from sm) as in_sitemap from m where rn = 1""")
def _(spark, sf):
    return CP.robots_blocked(fx_pages(spark, sf), robots_rules(spark, sf), sitemap(spark, sf))


@query("jon_17_detail_merge", P, f"WITH {LABELS_CTE} select url, case when n_issues > 0 then 'to fix' else priority end as priority, cast(case when n_issues > 0 then n_issues end as int) as n_fields from lp")
def _(spark, sf):
    rows = labelled(spark, sf)
    details = rows.where(F.size("issues") > 0).select("url", F.lit("to fix").alias("priority"), F.size("issues").alias("n_fields"))
    return VW.merge_details(rows.select("url", "priority"), details)


# --- aggregations -----------------------------------------------------------------------------------------------------

def _dups(key):
    return f"select {key} as key, url, n as n_rows from (select *, count(*) over (partition by site, {key}) as n from fx_pages where not is_error and {key} <> '') t where n > 1"


@query("agg_01_duplicate_titles", P, _dups("lower(trim(title))"))
def _(spark, sf):
    return CP.duplicate_titles(fx_pages(spark, sf))


@query("agg_02_duplicate_descriptions", P, _dups("lower(trim(meta_description))"))
def _(spark, sf):
    return CP.duplicate_descriptions(fx_pages(spark, sf))


@query("agg_03_duplicate_content", ("fx_docs",), f"""WITH b AS (select site, url, regexp_replace(body_text, '^{WS}|{WS}$', '', 'g') as b, len(list_filter(regexp_split_to_array(body_text, '{WS}'), lambda w: w <> '')) as n from fx_docs)
 select url, key, n_rows from (select url, md5(b) as key, count(*) over (partition by site, md5(b)) as n_rows from b where n >= 50) t where n_rows > 1""")
def _(spark, sf):
    from rankloom.catalog.fixtures import fx_docs
    return CP.duplicate_content(fx_docs(spark, sf).withColumn("is_error", F.lit(False)))


def _count(cond, name):
    return f"count(*) filter (not is_error and {cond}) as {name}"


def _pct(cond, name):
    return f"round(cast(100 as double) * count(*) filter (not is_error and {cond}) / greatest(count(*) filter (not is_error), 1), 1) as {name}"


@query("agg_04_technical_summary", P, f"""WITH a AS (select *, {TECH_SCORE} as s, {LETTER.format(TECH_SCORE)} as g, {INDEX_SQL} as ix from fx_pages)
 select count(*) as total_pages, count(*) filter (not is_error) as real_pages, round(avg(s) filter (not is_error), 1) as avg_tech_score, {LETTER.format('round(avg(s) filter (not is_error), 1)')} as site_grade,
 {', '.join(_count(f"g = '{x}'", f'grade_{x.lower()}') for x in 'ABCDF')}, {', '.join(_count(f"ix = '{x}'", x) for x in ('indexable', 'likely_indexable', 'canonical_mismatch', 'not_indexable_redirect', 'not_indexable_error', 'not_indexable_noindex', 'unknown'))},
 {_count("ix in ('indexable', 'likely_indexable')", 'indexable_total')}, {_pct("ix in ('indexable', 'likely_indexable')", 'indexable_pct')}, {_count("ix not in ('indexable', 'likely_indexable')", 'blocked_total')},
 {_pct("trim(title) <> ''", 'title_pct')}, {_pct("trim(meta_description) <> ''", 'meta_pct')}, {_pct("canonical <> ''", 'canonical_pct')}, {_pct("(og_title <> '' or og_description <> '')", 'og_pct')}, {_pct('len(h1) = 1', 'h1_pct')}, {_pct("url like 'https:%'", 'https_pct')},
 {_count(f'{WC} < 300', 'thin_pages')}, {_pct(f'{WC} < 300', 'thin_pct')} from a""")
def _(spark, sf):
    return SU.technical_summary(TE.audit_pages(fx_pages(spark, sf), parts=[]))


@query("agg_05_status_distribution", P, "select concat(status_code // 100, 'xx') as bucket, count(*) as pages from fx_pages group by 1")
def _(spark, sf):
    return SU.status_distribution(fx_pages(spark, sf))


@query("agg_05_https_share", P, """select total_pages, real_pages, https_pages, pct as https_pct, case when pct = 100 then 'all_https' when pct > 0 then 'partial' else 'no_https' end as status from
 (select count(*) as total_pages, count(*) filter (not is_error) as real_pages, count(*) filter (not is_error and url like 'https://%') as https_pages, round(cast(100 as double) * count(*) filter (not is_error and url like 'https://%') / greatest(count(*) filter (not is_error), 1), 1) as pct from fx_pages) t""")
def _(spark, sf):
    return SU.https_share(fx_pages(spark, sf))


@query("agg_06_issue_frequency", P, f"select issue as label, count(*) as n from ({DUP_SQL}) t group by 1 order by n desc, label limit 10")
def _(spark, sf):
    return SU.top_labels(labelled(spark, sf), "issues", 10)


@query("agg_06_issue_summary", P, f"""WITH {LABELS_CTE} select count(*) as total, count(*) filter (n_issues > 0) as with_issues, count(*) filter (priority = 'High') as high,
 count(*) filter (priority = 'Medium') as medium, count(*) filter (priority = 'Low') as low, count(*) filter (n_issues = 0) as clean from lp""")
def _(spark, sf):
    return SU.issue_summary(labelled(spark, sf))


@query("agg_07_keyword_frequency", P, "select label, count(*) as n from (select unnest(keywords) as label from fx_pages) t group by 1 order by n desc, label limit 20")
def _(spark, sf):
    return SU.top_labels(fx_pages(spark, sf), "keywords", 20)


@query("agg_08_mixed_content_summary", P, "select count(*) as pages_scanned, count(*) filter (len(mixed_resources) > 0) as pages_affected, cast(sum(len(mixed_resources)) as bigint) as total_resources from fx_pages")
def _(spark, sf):
    return SU.mixed_content_summary(fx_pages(spark, sf))


@query("agg_09_image_loading", P, """select t as total_images, l as lazy_count, s as srcset_count, round(cast(100 as double) * l / t, 1) as lazy_pct, round(cast(100 as double) * s / t, 1) as srcset_pct, 2 * l < t as few_lazy, s < 0.3 * t as few_srcset from
 (select cast(sum(img_total) as bigint) as t, cast(sum(img_lazy_count) as bigint) as l, cast(sum(img_srcset_count) as bigint) as s from fx_pages) x""")
def _(spark, sf):
    return SU.image_loading_summary(fx_pages(spark, sf))


@query("agg_10_breadcrumbs", P, """select n as total, d as detected, j as json_ld, h as html_nav, n - d as without, round(cast(100 as double) * d / n, 1) as coverage_pct, 100.0 * d / n < 80 and n > 3 as low_coverage from
 (select count(*) as n, count(*) filter (breadcrumb_detected) as d, count(*) filter (breadcrumb_source = 'json_ld') as j, count(*) filter (breadcrumb_source = 'html_nav') as h from fx_pages) t""")
def _(spark, sf):
    return SU.breadcrumb_summary(fx_pages(spark, sf))


@query("agg_11_redirect_chains", P, "select url, redirect_hops from fx_pages where redirect_hops > 1")
def _(spark, sf):
    return SU.redirect_chains(fx_pages(spark, sf))


@query("agg_12_issue_rollup", P, f"""WITH {SITEMAP}, s AS (select distinct rtrim(url, '/') as k from sm), c AS (select rtrim(url, '/') as k, bool_or(robots_noindex or contains(robots_meta, 'noindex')) as ni, bool_or(is_error or status_code >= 400) as er, bool_or(not is_error) as ok from fx_pages group by 1),
 i AS (select 'CRITICAL' as severity, 'sitemap_noindex' as category from s join c using (k) where ni UNION ALL select 'CRITICAL', 'sitemap_error_page' from s join c using (k) where er
 UNION ALL select 'MEDIUM', 'sitemap_missing' from s left join c using (k) where not coalesce(ok, false) UNION ALL select 'LOW', 'not_in_sitemap' from c where k not in (select k from s))
 select 'severity' as level, severity as value, count(*) as n from i group by 2 UNION ALL select 'category', category, count(*) from i group by 2 UNION ALL select 'total', '', count(*) from i""")
def _(spark, sf):
    conflicts = CP.sitemap_conflicts(fx_pages(spark, sf), sitemap(spark, sf))
    return SU.issue_rollup(conflicts.withColumnRenamed("type", "category"))


_KW = "select url, site, lower(unnest(list_concat(keywords, h2))) as keyword from fx_pages"


@query("agg_13_intent_by_site", P, f"""select site, count(*) filter (i = 'informational') as informational, count(*) filter (i = 'commercial') as commercial, count(*) filter (i = 'transactional') as transactional, count(*) filter (i = 'navigational') as navigational
 from (select site, {intent_sql('keyword')} as i from ({_KW}) k where keyword <> '') t group by site""")
def _(spark, sf):
    rows = fx_pages(spark, sf).select("site", F.explode(F.concat("keywords", "h2")).alias("keyword"))
    return SU.intent_distribution(rows, ["site"])


@query("agg_14_cannibalised_keywords", P, """WITH k AS (select distinct site, lower(kw) as keyword, url from (select site, url, unnest(keywords) as kw from fx_pages where not is_error) t where length(kw) > 3),
 c AS (select site, keyword, count(*) as page_count from k group by 1, 2 having count(*) >= 2 order by 3 desc, 1, 2 limit 20), r AS (select k.*, row_number() over (partition by site, keyword order by url) as rn from k)
 select c.site, c.keyword, c.page_count, case when c.page_count >= 4 then 'High' else 'Medium' end as risk_level, string_agg(r.url, ' ' order by r.url) as pages from c join r on r.site = c.site and r.keyword = c.keyword and r.rn <= 6 group by 1, 2, 3, 4""")
def _(spark, sf):
    return SU.cannibalised_keywords(fx_pages(spark, sf)).withColumn("pages", F.array_join("pages", " "))


@query("agg_19_executive_summary", P, f"WITH {RANKING_CTE}, {LABELS_CTE} select count(*) as pages, count(*) filter (n_issues > 0) as with_issues, count(*) filter (priority = 'High') as high_priority, round(avg(r.score), 1) as avg_score from lp join ranked r using (url)")
def _(spark, sf):
    return SU.executive_summary(labelled(spark, sf))


# --- views ------------------------------------------------------------------------------------------------------------

@query("flt_01_real_pages", P, "select url, status_code from fx_pages where not is_error and status_code = 200")
def _(spark, sf):
    return VW.real_pages(fx_pages(spark, sf), only_ok=True).select("url", "status_code")


@query("flt_02_result_filter", P, f"WITH {LABELS_CTE} select url, cast(n_issues as int) as issues from lp where n_issues > 0 and priority = 'Medium'")
def _(spark, sf):
    rows = VW.result_filter(labelled(spark, sf), with_issues=True, priority="Medium")
    return rows.select("url", F.size("issues").alias("issues"))


@query("flt_03_text_search", P, f"select url, {INDEX_SQL} as indexability from fx_pages where contains(lower(concat_ws(' ', url, title, meta_description)), 'the') and {INDEX_SQL} = 'indexable'")
def _(spark, sf):
    rows = fx_pages(spark, sf).withColumn("indexability", TE.indexability())
    return VW.text_search(rows, "The", ["url", "title", "meta_description"], indexability="indexable").select("url", "indexability")


def _any(pattern):
    return f"len(list_filter(ls, lambda i: regexp_matches(i, '(?i){pattern}'))) > 0"


@query("flt_04_cluster_views", P, f"""WITH {LABELS_CTE}, v AS (
 select 'all' as view, * from lp UNION ALL select 'title', * from lp where title = '' or {_any('title')} UNION ALL select 'meta', * from lp where meta_description = '' or {_any('meta')}
 UNION ALL select 'headings', * from lp where {_any('\\bh1\\b|\\bh2\\b|heading')} UNION ALL select 'canonical', * from lp where {_any('canonical')} UNION ALL select 'images', * from lp where {_any('image|alt')}
 UNION ALL select 'content', * from lp where {_any('content|thin|word')} UNION ALL select 'links', * from lp where {_any('\\blink')} UNION ALL select 'status', * from lp where status_code >= 400 or status_code < 200)
 select view, count(*) as pages, count(*) filter (n_issues = 0) as clean, count(*) filter (n_issues > 0) as with_issues, count(*) filter (priority = 'High') as high_priority, cast(round(cast(100 as double) * count(*) filter (n_issues = 0) / count(*), 0) as int) as health from v group by view""")
def _(spark, sf):
    return VW.cluster_views(labelled(spark, sf))


def sitemap_entries(spark, sf):
    pages = fx_pages(spark, sf)
    return pages.select("url", "status_code", F.col("last_modified").alias("lastmod"), F.when(F.size("h2") > 1, "weekly").otherwise("").alias("changefreq"))


@query("flt_05_sitemap_view", P, """select url, concat_ws(',', case when status_code >= 400 then 'Error' when status_code >= 300 then 'Redirect' end, case when last_modified = '' then 'No Lastmod' end, case when len(h2) <= 1 then 'No Changefreq' end) as flags
 from fx_pages where status_code >= 400 and contains(lower(url), 'example')""")
def _(spark, sf):
    return VW.sitemap_rows(sitemap_entries(spark, sf), "4xx", "Example").select("url", F.array_join("flags", ",").alias("flags"))


@query("flt_05_sitemap_kpis", P, """select count(*) as total, count(*) filter (status_code between 200 and 299) as live, count(*) filter (status_code between 300 and 399) as redirects, count(*) filter (status_code >= 400) as errors,
 count(*) filter (last_modified = '') as no_lastmod, cast(round(cast(100 as double) * count(*) filter (status_code between 200 and 299) / count(*), 0) as int) as live_pct from fx_pages""")
def _(spark, sf):
    return VW.sitemap_kpis(sitemap_entries(spark, sf))


@query("flt_06_worth_rewriting", P, f"WITH {LABELS_CTE} select url from lp where not is_error and status_code = 200 and trim(body_text) <> '' and n_issues > 0")
def _(spark, sf):
    return VW.worth_rewriting(labelled(spark, sf)).select("url")


def _status(field):
    whens = " ".join(f"when list_contains(ls, '{label}') then '{s}'" for label, (f, s) in VW.LABEL_FIELDS.items() if f == field)
    return f"case {whens} else 'OK' end"


@query("flt_07_field_rows", P, f"""WITH {LABELS_CTE}, fr AS (select url, 'Title' as field, title as current, {_status('Title')} as status from lp UNION ALL select url, 'Meta Description', meta_description, {_status('Meta Description')} from lp
 UNION ALL select url, 'H1', coalesce(h1[1], ''), {_status('H1')} from lp UNION ALL select url, 'H2', array_to_string(h2[1:2], ' | '), {_status('H2')} from lp UNION ALL select url, 'Canonical', canonical, {_status('Canonical')} from lp UNION ALL select url, 'URL', url, 'OK' from lp)
 select *, case when status = 'OK' then '' when status = 'Missing' and field in ('Title', 'Meta Description', 'H1') then 'High' when field = 'H2' or (field = 'Meta Description' and status like 'Too%') then 'Low' else 'Medium' end as impact from fr""")
def _(spark, sf):
    return VW.field_rows(labelled(spark, sf)).select("url", "field", "current", "status", "impact")


@query("flt_08_optimisation_rows", P, f"""WITH {LABELS_CTE}, f AS (select url, 'Title' as field, {_status('Title')} as status, title as v from lp UNION ALL
 select url, 'Meta Description', {_status('Meta Description').replace("when list_contains(ls, 'Duplicate Meta Description') then 'Duplicate'", "").replace("else 'OK'", "when list_contains(ls, 'Duplicate Meta Description') then 'Duplicate' else 'OK'")}, meta_description from lp
 UNION ALL select url, 'H1', {_status('H1')}, coalesce(h1[1], '') from lp UNION ALL select url, 'H2', {_status('H2')}, coalesce(h2[1], '') from lp UNION ALL select url, 'Canonical', {_status('Canonical')}, canonical from lp)
 select url, field, status, case when v = '' then 'MISSING' else v end as current_value from f where status <> 'OK'""")
def _(spark, sf):
    return VW.optimisation_rows(labelled(spark, sf)).select("url", "field", "status", "current_value")


@query("flt_09_placeholders", P, """select url, case when regexp_matches(v, '\\[.*?\\]|\\{.*?\\}|<[^>]+>|(?i)\\b(insert|your[\\s_-]?brand|your[\\s_-]?keyword|example\\.com|company[\\s_-]?name|placeholder|todo|tbd)\\b') then 'Insufficient data: the proposed value was a placeholder' else v end as value
 from (select url, case when len(h2) = 1 then concat('Guide to [', title, ']') when len(h3) = 0 then concat('About ', site) else title end as v from fx_pages) t""")
def _(spark, sf):
    value = F.when(F.size("h2") == 1, F.concat(F.lit("Guide to ["), "title", F.lit("]"))).when(F.size("h3") == 0, F.concat(F.lit("About "), "site")).otherwise(F.col("title"))
    return fx_pages(spark, sf).select("url", VW.without_placeholder(value).alias("value"))


@query("flt_10_structured_pages", P, "select url, title, meta_description as meta, coalesce(h1[1], '') as h1, array_to_string(h2, '|') as h2, array_to_string(h3, '|') as h3, substr(body_text, 1, 1000) as content_snippet from fx_pages")
def _(spark, sf):
    out = VW.structured_pages(fx_pages(spark, sf))
    return out.select("url", "title", "meta", "h1", F.array_join("h2", "|").alias("h2"), F.array_join("h3", "|").alias("h3"), "content_snippet")


@query("srt_01_sorted", P, f"WITH {LABELS_CTE} select url, array_to_string(list_sort(ls), ',') as labels from lp")
def _(spark, sf):
    rows = labelled(spark, sf).withColumn("issues", F.array_sort("issues"))
    return VW.sorted_by(rows, "issues", ascending=False).select("url", F.array_join("issues", ",").alias("labels"))


@query("srt_02_page_of_results", P, "select url, status_code from fx_pages order by url limit 25 offset 50")
def _(spark, sf):
    return VW.page_of(fx_pages(spark, sf).select("url", "status_code"), ["url"], limit=25, offset=50)


@query("srt_03_snapshot_listing", ("fx_snapshots",), """select project_id, crawled_at, n from (select project_id, crawled_at, count(*) as n from fx_snapshots group by 1, 2) t where contains(cast(project_id as varchar), '1') order by crawled_at desc, project_id limit 30""")
def _(spark, sf):
    from rankloom.catalog.fixtures import view
    snaps = view(spark, sf, "fx_snapshots").groupBy("project_id", "crawled_at").agg(F.count(F.lit(1)).alias("n"))
    return VW.listing(snaps.withColumn("target", F.col("project_id").cast("string")), "1", "target", "crawled_at", 30, "project_id").select("project_id", "crawled_at", "n")
