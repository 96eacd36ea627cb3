"""Queries of the competitor benchmark and the composed jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import lookups as L
from rankloom.catalog.fixtures import fx_pages
from rankloom.catalog.page_queries import P, TECH_SCORE, WC, WS, _sql_list
from rankloom.catalog.registry import once, query
from rankloom.catalog.site_queries import LABELS_CTE, SITEMAP, WALK, labelled, sitemap
from rankloom.catalog.source_queries import speed_reports
from rankloom.operators import benchmark as BM, page_issues as PI
from rankloom.sources import page_speed as SPEED

YEAR = 2026


def scored_pages(spark, sf):
    """Labelled pages with the importance of their keywords: high where the page has three first headings or more words."""
    pages = labelled(spark, sf)
    high = F.when(F.size("h2") >= 3, "HIGH").otherwise("LOW")
    return pages.withColumn("keywords_scored", F.transform("keywords", lambda k: F.struct(k.alias("keyword"), high.alias("importance"))))


def authority(spark, sf):
    return fx_pages(spark, sf).select("site").distinct().where(F.length("site") % 3 != 0).select("site", (F.length("site") % 10).cast("double").alias("authority"))


def speed(spark, sf):
    flat = SPEED.flatten_reports(speed_reports(spark, sf))
    sites = speed_reports(spark, sf).select("url", "site", "k")
    perf = F.when(F.col("k") % 3 == 0, None).otherwise(F.col("perf_score"))
    return flat.join(sites, "url").select("site", perf.alias("perf_score"), "lcp_ms", "cls")


OK = f"{LABELS_CTE}, ok AS (select * from lp where status_code = 200)"
Q = {}
Q["on_page"] = f"""select site, cast(max((case when title <> '' then 15 else 0 end) + (case when length(title) between 50 and 60 then 10 else 0 end) + (case when meta_description <> '' then 15 else 0 end) + (case when length(meta_description) between 120 and 155 then 10 else 0 end)
 + (case when len(h1) > 0 then 15 else 0 end) + (case when len(h2) > 0 then 10 else 0 end) + (case when canonical <> '' then 10 else 0 end) + (case when n_issues = 0 then 15 else 0 end)) as double) as on_page from ok group by site"""
_SENT = "list_filter(regexp_split_to_array(body_text, '[.!?]'), lambda s: regexp_replace(s, '^{WS}|{WS}$', '', 'g') <> '')".replace("{WS}", WS)
_MEAN = f"(coalesce(list_sum(list_transform({_SENT}, lambda s: len(list_filter(regexp_split_to_array(s, '{WS}'), lambda w: w <> '')))), 0) / cast(greatest(len({_SENT}), 1) as double))"
_W = f"(case when body_text <> '' then {WC} else len(list_filter(regexp_split_to_array(concat_ws(' ', title, meta_description, array_to_string(h1, ' '), array_to_string(h2, ' ')), '{WS}'), lambda w: w <> '')) end)"
Q["content"] = f"""select site, round(avg(least(100, (case when w >= 1500 then 30 when w >= 800 then 20 when w >= 300 then 10 when w > 0 then 5 else 0 end) + (case when len(h2) >= 4 then 20 when len(h2) >= 2 then 12 when len(h2) >= 1 then 6 else 0 end)
 + (case when len(h3) >= 3 then 15 when len(h3) >= 1 then 8 else 0 end) + (case when body_text <> '' then (case when m <= 18 then 20 when m <= 25 then 12 else 5 end) + 15 else 0 end))), 1) as content from (select *, {_W} as w, {_MEAN} as m from ok) t group by site"""
_HOSTS, _TLDS = "|".join(d.replace(".", "\\.") for d in L.AUTHORITY_DOMAINS), "|".join(t.replace(".", "\\.") for t in L.AUTHORITY_TLDS)
_TX = "lower(case when body_text <> '' then body_text else title end)"
Q["eeat"] = f"""select w.site, least(round(({' + '.join(f"(case when {c} then {p} else 0 end)" for c, p in (('about', 10), ('contact', 10), ('privacy', 8), ('team', 8), ('https', 8), ('byline', 10), ('author', 10), ('review', 8), ('high', 5), ('cited', 7), ('academic', 8), ('words >= 1000', 8)))})
 + case when length(w.site) % 3 <> 0 then round(cast(length(w.site) % 10 as double) * 1.7, 1) else 0 end, 1), 100) as eeat from
 (select site, bool_or(contains(lower(url), 'about')) as about, bool_or(contains(lower(url), 'contact')) as contact, bool_or(regexp_matches(lower(url), 'privacy|policy')) as privacy, bool_or(regexp_matches(lower(url), 'team|people|staff|author')) as team, bool_or(url like 'https://%') as https, avg({_W}) as words from ok group by 1) w
 join (select site, bool_or(regexp_matches({_TX}, 'author|written by|contributor|byline')) as byline, bool_or(schema_author <> '') as author, bool_or(schema_rating is not null) as review, coalesce(avg(schema_rating) >= 4, false) as high,
  bool_or(len(list_filter(external_links, lambda u: regexp_matches(lower(u), '{_HOSTS}'))) > 0) as cited, bool_or(len(list_filter(external_links, lambda u: regexp_matches(lower(u), '{_TLDS}'))) > 0) as academic from ok group by 1) t on t.site = w.site"""
_T = "trim(title)"
_M = "trim(meta_description)"
_CTA = " or ".join(f"contains(lower({_M}), '{w}')" for w in L.CTA_WORDS)
Q["ctr"] = f"""select site, cast(least(100, max((case when length({_T}) between 50 and 60 then 20 when length({_T}) between 40 and 70 then 12 when {_T} <> '' then 5 else 0 end)
 + (case when len(list_filter(regexp_split_to_array(lower({_T}), '{WS}'), lambda w: w in {_sql_list(L.POWER_WORDS)})) > 0 then 15 else 0 end) + (case when regexp_matches({_T}, '\\d') then 15 else 0 end) + (case when regexp_matches({_T}, '{YEAR}|{YEAR - 1}') then 10 else 0 end)
 + (case when regexp_matches({_T}, '[\\[(].{{1,20}}[\\])]') then 10 else 0 end) + (case when {_T} like '%?' or regexp_matches(lower({_T}), '^(how|why|what|when|where|who|which|is|are|can)\\b') then 8 else 0 end) + (case when {_CTA} then 20 else 0 end)
 + (case when length({_M}) between 120 and 155 then 20 when length({_M}) between 100 and 170 then 12 when {_M} <> '' then 5 else 0 end))) as double) as ctr from ok where title <> '' group by site"""
Q["keywords"] = """select o.site, least(100, round((case when n >= 50 then 40 when n >= 20 then 30 when n >= 10 then 20 when n >= 5 then 10 else 0 end) + 30 * a + 30 * h, 1)) as keywords from
 (select site, avg(cast(len(keywords) > 0 as int)) as a, avg(cast(len(keywords) > 0 and len(h2) >= 3 as int)) as h from ok group by 1) o left join (select site, count(distinct lower(k)) as n from (select site, unnest(keywords) as k from ok) t where k <> '' group by 1) k on k.site = o.site"""
_LC, _CL = "round(response_time_ms * cast(2 as double), 1)", "((k % 5) / cast(10 as double))"
Q["page_speed"] = f"""select site, round(avg(case when k % 3 <> 0 then round(cast(k % 100 as double), 1) else greatest(0, least(100, 50 + (case when k % 10 = 0 then 0 when {_LC} < 2500 then 20 when {_LC} < 4000 then 5 else -20 end) + (case when {_CL} < 0.1 then 10 when {_CL} < 0.25 then 0 else -10 end))) end), 1) as page_speed from fx_pages group by site"""
Q["technical"] = f"select site, round(avg(s), 1) as technical from (select site, {TECH_SCORE} as s from ok) t group by site"

# Each score builds only the tables it reads; that of the best page needs labels, which are found on keys, but not the kept table of whole pages.
for _name, _dim, _build in [
    ("cmp_01_on_page", "on_page", lambda spark, sf: BM.on_page_scores(PI.detect_issues(fx_pages(spark, sf)))),
    ("cmp_02_content", "content", lambda spark, sf: BM.content_scores(scored_pages(spark, sf))),
    ("cmp_03_trust", "eeat", lambda spark, sf: BM.trust_scores(scored_pages(spark, sf), authority(spark, sf))),
    ("cmp_04_ctr", "ctr", lambda spark, sf: BM.ctr_scores(scored_pages(spark, sf), YEAR)),
    ("cmp_05_keywords", "keywords", lambda spark, sf: BM.keyword_scores(scored_pages(spark, sf))),
    ("cmp_06_page_speed", "page_speed", lambda spark, sf: BM.speed_scores(speed(spark, sf))),
    ("cmp_07_technical", "technical", lambda spark, sf: BM.technical_scores(scored_pages(spark, sf))),
]:
    query(_name, P, f"WITH {OK} {Q[_dim]}")(_build)


_SEO = "(round(100 * ((k % 50) / cast(50 as double)), 1))"
_TI, _ME, _CR, _CA = "(title <> '')::int", "(meta_description <> '')::int", "(not robots_noindex)::int", "(canonical <> '')::int"
_TLD = "(case when concat('.', split_part(site, '.', -1)) in ('.edu', '.gov', '.org') then 35 else 0 end)"


@query("cmp_08_scores_from_report", P, f"""select url, cast(25 * {_CR} + 20 * {_CA} as double) as technical, cast(25 * {_TI} + 25 * {_ME} as double) as on_page, cast(15 + case when k * 10 >= 3000 then 40 when k * 10 >= 1500 then 30 when k * 10 >= 600 then 15 when k * 10 >= 200 then 5 else 0 end as double) as content,
 round(least(100, 15 + {_TLD} + 10 * {_TI} + 10 * {_ME} + least({_SEO} * cast(0.1 as double), 10)), 1) as eeat, round(35 * {_TI} + 35 * {_ME} + least({_SEO} * cast(0.3 as double), 30), 1) as ctr, round(least(70, 25 * {_TI} + 25 * {_ME} + least({_SEO} * cast(0.2 as double), 20)), 1) as keywords, round(cast(k % 100 as double), 1) as page_speed from fx_pages""")
def _(spark, sf):
    return BM.scores_from_report(SPEED.flatten_reports(speed_reports(spark, sf)))


ALL = OK + ", " + ", ".join(f"d_{d} AS ({Q[d]})" for d in L.DIMENSION_WEIGHTS) + ", si AS (select distinct site from fx_pages), ss AS (select si.site, " + ", ".join(f"d_{d}.{d}" for d in L.DIMENSION_WEIGHTS) + " from si " + " ".join(f"left join d_{d} on d_{d}.site = si.site" for d in L.DIMENSION_WEIGHTS) + ")"
_COMP = "round(" + " + ".join(f"coalesce({d}, 0) * cast({w} as double)" for d, w in L.DIMENSION_WEIGHTS.items()) + ", 4)"


def scores(spark, sf):
    return once(spark, sf, "site-scores", lambda: BM.with_composite(BM.site_scores(scored_pages(spark, sf), speed(spark, sf), authority(spark, sf), YEAR)))


@query("cmp_09_composite", P, f"WITH {ALL} select site, {_COMP} as composite from ss")
def _(spark, sf):
    return scores(spark, sf).select("site", F.round(BM.weighted_sum(), 4).alias("composite"))


@query("cmp_10_dimension_matrix", P, f"WITH {ALL} " + " UNION ALL ".join(f"select site, '{d}' as dimension, coalesce({d}, 0) as score from ss" for d in L.DIMENSION_WEIGHTS))
def _(spark, sf):
    return BM.dimension_matrix(scores(spark, sf))


@query("cmp_11_action_list", P, f"""WITH {ALL}, m AS ({' UNION ALL '.join(f"select site, '{d}' as dimension, coalesce({d}, 0) as score from ss" for d in L.DIMENSION_WEIGHTS)}), tt AS (select min(site) as t from fx_pages),
 g AS (select dimension, max(score) filter (site = t) as a, avg(score) filter (site <> t) as b from m, tt group by 1) select dimension, round(a, 1) as target_score, round(b, 1) as avg_competitor_score, round(b - a, 1) as gap, case when b - a >= 20 then 'High' when b - a >= 10 then 'Medium' else 'Low' end as priority from g where b - a > 5 order by gap desc, dimension limit 5""")
def _(spark, sf):
    target = fx_pages(spark, sf).agg(F.min("site")).head()[0]
    return BM.action_list(scores(spark, sf), target)


@query("cmp_12_benchmark_job", P, f"WITH {ALL} select site, technical, on_page, content, eeat, ctr, keywords, page_speed, 'crawl' as source from ss where technical is not null")
def _(spark, sf):
    from rankloom.plans.competitor_benchmark import run_benchmark

    flat = SPEED.flatten_reports(speed_reports(spark, sf))
    perf = speed_reports(spark, sf).select("url", (F.col("k") % 3 == 0).alias("_x"))
    flat = flat.join(perf, "url").withColumn("perf_score", F.when(F.col("_x"), None).otherwise(F.col("perf_score"))).drop("_x")
    target = fx_pages(spark, sf).agg(F.min("site")).head()[0]
    result = run_benchmark(scored_pages(spark, sf), flat, target, YEAR, authority(spark, sf))
    return result["scores"].where("source = 'crawl'").select("site", *L.DIMENSION_WEIGHTS, "source")


# --- composed jobs ----------------------------------------------------------------------------------------------------

@query("iss_15_validation_suite", P, f"""WITH RECURSIVE {WALK}, d AS (select start, state, case when state = 'left' then path[1:len(path) - 1] else path end as path from w where state <> 'open'), {SITEMAP},
 li AS (select rtrim(unnest(links), '/') as d from fx_pages where not is_error), pk AS (select rtrim(url, '/') as k, min(status_code) as st, min_by(pagination_prev, (status_code, pagination_prev)) as pv from fx_pages group by 1), tg AS (select rtrim(url, '/') as src, rtrim(t.href, '/') as dst from (select url, unnest(hreflang_tags) as t from fx_pages) a),
 pg AS (select rtrim(p.url, '/') as source, rtrim(p.pagination_next, '/') as nxt, rtrim(p.pagination_prev, '/') as prv, n.k as nu, rtrim(n.pv, '/') as back, v.k as vu from fx_pages p left join pk n on n.k = rtrim(p.pagination_next, '/') left join pk v on v.k = rtrim(p.pagination_prev, '/') where not p.is_error),
 cw AS (select rtrim(url, '/') as k, bool_or(robots_noindex or contains(robots_meta, 'noindex')) as ni, bool_or(not is_error) as ok from fx_pages group by 1), sl AS (select distinct rtrim(url, '/') as k from sm),
 al AS (select 'canonical_loop' as type, 'CRITICAL' as severity from d where state = 'loop' and start = list_min(path[list_position(path, path[len(path)]):len(path)])
 UNION ALL select 'canonical_chain', 'HIGH' from d where state <> 'loop' and len(path) > 2 and start not in (select nxt from cn)
 UNION ALL select 'broken_internal_link', case when st >= 500 then 'CRITICAL' else 'HIGH' end from li join pk on pk.k = li.d where st >= 400
 UNION ALL select 'duplicate_content', 'HIGH' from (select count(*) over (partition by site, regexp_replace(body_text, '^{WS}|{WS}$', '', 'g')) as n from fx_pages where not is_error and {WC} >= 50) x where n > 1
 UNION ALL select 'hreflang_missing_reciprocal', 'HIGH' from tg where src <> dst and dst in (select k from pk) and not exists (select 1 from tg b where b.src = tg.dst and b.dst = tg.src)
 UNION ALL select 'hreflang_missing_xdefault', 'MEDIUM' from fx_pages where len(hreflang_tags) > 0 and not list_contains(list_transform(hreflang_tags, lambda t: lower(t.lang)), 'x-default')
 UNION ALL select 'pagination_next_not_crawled', 'HIGH' from pg where nxt <> '' and nu is null UNION ALL select 'pagination_missing_reciprocal', 'HIGH' from pg where nxt <> '' and nu is not null and back <> source
 UNION ALL select 'pagination_prev_not_crawled', 'MEDIUM' from pg where not (nxt <> '' and nu is null) and prv <> '' and vu is null
 UNION ALL select 'orphan_page', 'MEDIUM' from fx_pages where not is_error and rtrim(url, '/') not in (select d from li) and rtrim(url, '/') not in (select rtrim(url, '/') from (select site, url, case when is_error then 0 else len(links) end as n from fx_pages) t qualify row_number() over (partition by site order by n desc, url) = 1)
 UNION ALL select 'duplicate_title', 'HIGH' from (select count(*) over (partition by site, lower(trim(title))) as n from fx_pages where not is_error and trim(title) <> '') x where n > 1
 UNION ALL select 'duplicate_meta_description', 'HIGH' from (select count(*) over (partition by site, lower(trim(meta_description))) as n from fx_pages where not is_error and trim(meta_description) <> '') x where n > 1
 UNION ALL select 'sitemap_noindex', 'CRITICAL' from sl join cw using (k) where ni UNION ALL select 'sitemap_missing', 'MEDIUM' from sl left join cw using (k) where not coalesce(ok, false))
 select type, severity, count(*) as n from al group by 1, 2""")
def _(spark, sf):
    from rankloom.plans.validation_suite import validate_all

    cross = validate_all(fx_pages(spark, sf), sitemap(spark, sf))["cross_page_issues"]
    return cross.groupBy("type", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("set_06_issue_union", P, """WITH lab AS (select site, lower(trim(title)) as t, lower(trim(meta_description)) as m, url from fx_pages where not is_error)
 select 'duplicate_title' as type, url, t as value, cast(null as varchar) as target from (select *, count(*) over (partition by site, t) as n from lab where t <> '') a where n > 1
 UNION ALL select 'duplicate_meta_description', url, m, null from (select *, count(*) over (partition by site, m) as n from lab where m <> '') a where n > 1
 UNION ALL select 'hreflang_missing_reciprocal', null, lang, dst from (select rtrim(url, '/') as src, t.lang as lang, rtrim(t.href, '/') as dst from (select url, unnest(hreflang_tags) as t from fx_pages) a) tg
 where src <> dst and dst in (select rtrim(url, '/') from fx_pages) and not exists (select 1 from (select rtrim(url, '/') as src, rtrim(t.href, '/') as dst from (select url, unnest(hreflang_tags) as t from fx_pages) a) b where b.src = tg.dst and b.dst = tg.src)""")
def _(spark, sf):
    from rankloom.plans.validation_suite import cross_page_issues

    out = cross_page_issues(fx_pages(spark, sf))
    kept = out.where("type in ('duplicate_title', 'duplicate_meta_description', 'hreflang_missing_reciprocal')")
    return kept.select("type", "url", "value", "target")


@query("gra_10_link_report", P, """WITH l AS (select lower(rtrim(regexp_replace(url, '[?#].*$', ''), '/')) as s, lower(rtrim(regexp_replace(unnest(links), '[?#].*$', ''), '/')) as d from fx_pages where not is_error), n AS (select distinct lower(rtrim(regexp_replace(url, '[?#].*$', ''), '/')) as u from fx_pages)
 select split_part(u, '/', 3) as site, count(distinct u) as total_pages, count(l.s) as total_internal_links from n left join l on l.d = n.u and l.s <> l.d group by 1""")
def _(spark, sf):
    from rankloom.plans.link_report import link_report

    return link_report(labelled(spark, sf))["totals"]


@query("snk_02_competitor_errors", P, "select site, url, status_code, title as note from fx_pages where is_error")
def _(spark, sf):
    return _competitor_tables(spark, sf)["errors"]


@query("snk_02_competitor_gaps", P, """WITH p AS (select distinct site, lower(k) as keyword from (select site, unnest(keywords) as k from fx_pages) t where lower(k) <> ''), tt AS (select min(site) as t from fx_pages), n AS (select count(distinct site) as n from p, tt where site <> t),
 g AS (select keyword, count(*) filter (site <> t) as competitor_count, bool_or(site = t) as own from p, tt where length(keyword) > 3 group by 1)
 select keyword, competitor_count, round(least(competitor_count / cast(greatest(n, 1) as double) * 70 + least(10 * len(list_filter(regexp_split_to_array(keyword, '\\s+'), lambda w: w <> '')), 30), 100), 1) as opportunity_score from g, n
 where not own and competitor_count >= (case when n >= 2 then 2 else 1 end) order by 2 desc, 3 desc, 1 limit 100""")
def _(spark, sf):
    return _competitor_tables(spark, sf)["keyword_gaps"].select("keyword", "competitor_count", "opportunity_score")


def _competitor_tables(spark, sf):
    from rankloom.plans.competitor_benchmark import run_benchmark
    from rankloom.sinks.reports import competitor_tables

    target = fx_pages(spark, sf).agg(F.min("site")).head()[0]
    result = run_benchmark(scored_pages(spark, sf), SPEED.flatten_reports(speed_reports(spark, sf)), target, YEAR, authority(spark, sf))
    return competitor_tables(result, speed(spark, sf), scored_pages(spark, sf))


# --- end to end -------------------------------------------------------------------------------------------------------

_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"
_TITLE = f"replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"


@query("e2e_01_raw_pages_to_labels", (), f"""WITH p AS (select url, regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1) as site, {_TITLE} as t, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) as h from pages),
 l AS (select site, case when length(t) = 0 then 'Missing Title' when length(t) > 60 then 'Title Too Long' when length(t) < 30 and regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) not in ('', '/') then 'Title Too Short' end as label from p
 UNION ALL select site, 'Missing Meta Description' from p UNION ALL select site, case when h = '' then 'Missing H1' end from p UNION ALL select site, 'Missing H2' from p UNION ALL select site, 'Missing Canonical' from p
 UNION ALL select site, 'Duplicate Title' from (select site, count(*) over (partition by site, lower(t)) as n from p where t <> '') x where n > 1)
 select site, label, count(*) as pages from l where label is not null group by 1, 2""")
def _(spark, sf):
    from rankloom.catalog.source_queries import facts
    from rankloom.operators.page_issues import detect_issues

    labelled_pages = detect_issues(facts(spark, sf))
    return labelled_pages.select("site", F.explode("issues").alias("label")).groupBy("site", "label").agg(F.count(F.lit(1)).alias("pages"))


@query("e2e_02_raw_pages_to_rule_audit")
def _(spark, sf):
    """Raw pages to facts to the rule audit, with the crawled addresses as sitemap and no robots rules or measurements."""
    from rankloom.catalog.source_queries import facts
    from rankloom.operators import rule_audit as RULES

    pages = facts(spark, sf)
    none = spark.createDataFrame([], "site string, pos int, path string")
    vitals = spark.createDataFrame([], "url string, lcp_s double, cls double, inp_s double")
    issues = RULES.rule_audit(pages, pages.select("url"), none, vitals)
    return issues.groupBy("scope", "type", "cluster", "severity").agg(F.count(F.lit(1)).alias("pages"))
