"""Queries over raw pages, sitemaps, robots files, page-speed reports and structured data."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import table
from rankloom.catalog.registry import once, query
from rankloom.sources.page_facts import extract_pages, mixed_content


def raw_pages(spark, sf):
    return table(spark, sf, "pages")


def facts(spark, sf):
    """Extracted page records, kept as a table."""
    return once(spark, sf, "extracted-pages", lambda: extract_pages(raw_pages(spark, sf)))


_UN = "replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"


@query("src_02a_titles", (), f"select url, trim({_UN.format('''regexp_extract(html, '<title>([^<]*)</title>', 1)''')}) as title, '' as canonical, '' as viewport from pages")
def _(spark, sf):
    return facts(spark, sf).select("url", "title", "canonical", "viewport")


@query("src_02b_headings", (), f"select url, trim({_UN.format('''regexp_extract(html, '<h1>([^<]*)</h1>', 1)''')}) as h1, 0 as n_h2 from pages")
def _(spark, sf):
    return facts(spark, sf).select("url", F.array_join("h1", "|").alias("h1"), F.size("h2").alias("n_h2"))


_HREF = "regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)"


@query("src_02e_internal_links", (), f"""WITH l AS (select url, regexp_extract(url, '^([a-z]+://[^/]+)', 1) as root, unnest({_HREF}) as h from pages)
 select distinct url, {_UN.format("concat(root, h)")} as href from l where h like '/%'""")
def _(spark, sf):
    return facts(spark, sf).select("url", F.explode("links").alias("href"))


@query("src_02f_external_links", (), f"select url, cast(0 as int) as external_links, cast(len(list_filter({_HREF}, lambda h: not starts_with(h, '/'))) as int) as absolute from pages")
def _(spark, sf):
    return facts(spark, sf).select("url", F.size("external_links").alias("external_links"), F.size("external_links").alias("absolute"))


@query("src_02g_images_and_resources", (), """select url, cast(len(regexp_extract_all(html, '<img[^>]*>')) as int) as img_total, cast(len(regexp_extract_all(html, '<img[^>]*>')) + len(regexp_extract_all(html, '<script[^>]* src=')) as int) as resource_count from pages""")
def _(spark, sf):
    return facts(spark, sf).select("url", "img_total", "resource_count")


@query("src_02h_page_weight", (), "select url, round(octet_length(encode(html)) / cast(1024 as double), 1) as html_size_kb from pages")
def _(spark, sf):
    return facts(spark, sf).select("url", "html_size_kb")


_TEXT = _UN.format("regexp_replace(regexp_replace(html, '(?s)<(script|style|nav|footer|header|noscript|iframe|svg)[^>]*>.*?</(script|style|nav|footer|header|noscript|iframe|svg)>|<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '<[^>]*>', ' ', 'g')")


@query("src_02k_body_text", (), f"select url, trim(regexp_replace({_TEXT}, '[\\s\\x{{85}}\\p{{Z}}]+', ' ', 'g')) as body_text from pages")
def _(spark, sf):
    return facts(spark, sf).select("url", "body_text")


def with_http_resources(spark, sf):
    """Raw pages with image, style and srcset references in front of the article."""
    pages = raw_pages(spark, sf)
    extra = F.concat(F.lit('<img src="http://img.example.com/'), F.col("page_id"), F.lit('.png"><p style="background:url(http://css.example.com/b.gif)">'
                     '<img srcset="http://s.example.com/1.webp 1x, http://s.example.com/2.webp 2x"><article>'))
    return pages.select("page_id", "url", F.replace("html", F.lit("<article>"), extra).alias("html"))


@query("src_02l_mixed_content", (), """select url, case when url like 'https://%' and contains(html, '<article>') then concat('http://css.example.com/b.gif http://img.example.com/', page_id, '.png http://s.example.com/1.webp http://s.example.com/2.webp') else '' end as resources from pages""")
def _(spark, sf):
    rows = with_http_resources(spark, sf)
    return rows.select("url", F.array_join(mixed_content(F.col("url"), F.col("html"), full=True), " ").alias("resources"))


# --- stored pages -----------------------------------------------------------------------------------------------------

from rankloom.catalog.fixtures import fx_pages, view  # noqa: E402
from rankloom.catalog.page_queries import P  # noqa: E402
from rankloom.sources import page_speed as SPEED, robots as RB, sitemaps as SM, stored_pages as ST, structured_data as SD  # noqa: E402


@query("src_01_stored_pages", P, """select url, title, status_code, case when length(title) % 5 = 0 then '' else canonical end as canonical, cast(case when length(title) % 5 = 0 then 0 else len(h1) end as int) as n_h1,
 cast(case when length(title) % 4 = 0 then 0 else len(keywords) end as int) as n_issues from fx_pages""")
def _(spark, sf):
    pages = fx_pages(spark, sf).withColumn("issues", F.col("keywords"))
    stored = ST.to_stored(pages, "job-1")
    broken = stored.withColumns({
        "meta_data": F.when(F.length("title") % 5 == 0, "{not json").otherwise(F.col("meta_data")),
        "issues": F.when(F.length("title") % 4 == 0, "oops").otherwise(F.col("issues"))})
    return ST.from_stored(broken).select("url", "title", "status_code", "canonical", F.size("h1").alias("n_h1"), F.size("issues").alias("n_issues"))


@query("src_03_error_pages", P, "select url, concat('HTTP ', status_code) as title, true as is_error, cast(0 as int) as n_links, '' as canonical from fx_pages where is_error")
def _(spark, sf):
    failures = fx_pages(spark, sf).where("is_error").select("url", F.concat(F.lit("HTTP "), "status_code").alias("note"))
    return ST.error_pages(failures).select("url", "title", "is_error", F.size("links").alias("n_links"), "canonical")


def sitemap_files(spark, sf):
    """Sitemap files of each site, as many as its pages fill: each page once, and once more with a slash."""
    pages = view(spark, sf, "fx_pages").select("site", "url", "k")
    entry = F.concat(F.lit("<url><loc> "), "url", F.lit("/ </loc></url><url><LOC>"), "url", F.lit("</LOC></url>"))
    part = F.concat_ws("/", "site", F.floor(F.col("k") / 1000).cast("string"))
    parts = pages.groupBy(part.alias("sitemap")).agg(F.array_sort(F.collect_list(F.struct("k", entry.alias("e")))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["e"]), "")
    return parts.select("sitemap", F.concat(F.lit("<urlset>"), body, F.lit("</urlset>")).alias("content"))


@query("src_04_sitemap_urls", P, "WITH f AS (select concat(site, '/', k // 1000) as sitemap, rtrim(url, '/') as url, min(k) as k from fx_pages group by 1, 2) select sitemap, cast(row_number() over (partition by sitemap order by k) as int) as pos, url from f")
def _(spark, sf):
    return SM.sitemap_urls(sitemap_files(spark, sf))


def robots_files(spark, sf):
    """A robots file per site with several blocks."""
    sites = table(spark, sf, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site")).distinct()
    n = F.length("site")
    text = F.concat(
        F.lit("# rules\nUser-agent: Badbot\nDisallow: /everything\n\nUser-agent: *\nDisallow: /a\nAllow: /a/b\n"),
        F.when(n % 5 == 0, "Disallow: /\n").otherwise("Disallow:\n"), F.when(n % 4 == 0, "Crawl-delay: 20\n").otherwise("Crawl-delay: 2\n"),
        F.when(n % 3 == 0, "\nUser-agent: Googlebot\nUser-agent: Otherbot\nDisallow: /\n").otherwise(""),
        F.when(n % 2 == 0, F.concat(F.lit("Sitemap: https://"), "site", F.lit("/sitemap.xml\n"))).otherwise(""))
    return sites.select("site", text.alias("content"))


_SITES = "st AS (select site, length(site) as n from (select distinct regexp_extract(url, '^https?://([^/]+)', 1) as site from pages) t)"


@query("src_05_robots_report", (), f"""WITH {_SITES} select site, case when n % 5 = 0 then '/a|/' else '/a' end as disallowed, '/a/b' as allowed, case when n % 2 = 0 then concat('https://', site, '/sitemap.xml') else '' end as sitemaps,
 case when n % 4 = 0 then cast(20 as double) else cast(2 as double) end as crawl_delay, n % 3 = 0 as has_googlebot_rules, concat_ws('|', case when n % 5 = 0 then 'whole site blocked' end, case when n % 2 <> 0 then 'no sitemap' end, case when n % 4 = 0 then 'high crawl delay' end) as issues from st""")
def _(spark, sf):
    out = RB.robots_report(robots_files(spark, sf))
    join = {c: F.array_join(c, "|") for c in ("disallowed", "allowed", "sitemaps", "issues")}
    return out.withColumns(join).select("site", "disallowed", "allowed", "sitemaps", "crawl_delay", "has_googlebot_rules", "issues")


@query("src_05_blocked_sites", (), f"WITH {_SITES} select site, n % 5 = 0 or n % 3 = 0 as blocks_crawler from st")
def _(spark, sf):
    return RB.blocked_sites(robots_files(spark, sf))


# --- page speed -------------------------------------------------------------------------------------------------------

def speed_reports(spark, sf):
    """Page-speed reports, kept as a table."""
    return once(spark, sf, "speed-reports", lambda: _speed_reports(spark, sf))


def _speed_reports(spark, sf):
    """A page-speed report per page, its numbers taken from the page facts."""
    p = view(spark, sf, "fx_pages")
    k, rt = F.col("k"), F.col("response_time_ms").cast("double")

    def audit(name, score, value):
        return [F.lit(name), F.struct(score.cast("double").alias("score"), value.cast("double").alias("numericValue"))]

    none = F.lit(None).cast("double")
    audits = F.create_map(
        *audit("largest-contentful-paint", none, F.when(k % 10 == 0, None).otherwise(rt * 2)), *audit("total-blocking-time", none, rt / 10),
        *audit("cumulative-layout-shift", none, (k % 5) / 10), *audit("interaction-to-next-paint", none, rt / 4),
        *audit("dom-size", none, k * 10), *audit("document-title", F.when(F.col("title") == "", 0).otherwise(1), none),
        *audit("meta-description", F.when(F.col("meta_description") == "", 0).otherwise(1), none), *audit("is-crawlable", F.when(F.col("robots_noindex"), 0).otherwise(1), none),
        *audit("canonical", F.when(F.col("canonical") == "", 0).otherwise(1), none))
    items = F.transform(F.sequence(F.lit(1), (k % 13 + 1).cast("int")), lambda i: F.struct(
        F.concat(F.lit("https://cdn.example.com/"), i, F.lit(".css")).alias("url"), (i * 100).cast("bigint").alias("totalBytes"), (i * 10.04).alias("wastedMs")))
    blocking = F.struct(F.struct(items.alias("items")).alias("details"))
    text = F.concat(
        F.lit('{"lighthouseResult":{"categories":'),
        F.to_json(F.create_map(F.lit("performance"), F.struct(((k % 100) / 100).alias("score")), F.lit("seo"), F.struct(((k % 50) / 50).alias("score")))),
        F.lit(',"audits":'), F.regexp_replace(F.to_json(audits), r"\}$", ',"render-blocking-resources":'), F.to_json(blocking), F.lit('}},"loadingExperience":{"overall_category":"FAST"}}'))
    return p.select("url", "site", "k", F.lit("mobile").alias("strategy"), text.alias("report"))


@query("src_06_speed_scores", P, """WITH a AS (select url, k, cast(response_time_ms as double) as rt from fx_pages), b AS (select *, case when k % 10 = 0 then null else round(rt * 2, 1) end as lcp, round((k % 5) / cast(10 as double), 1) as cls from a)
 select url, round(cast(k % 100 as double), 1) as perf_score, round(100 * ((k % 50) / cast(50 as double)), 1) as seo_score, lcp as lcp_ms, round(rt / 10, 1) as inp_ms, cls,
 case when lcp is null or lcp = 0 then 'Unknown' when lcp < 2500 then 'Good' when lcp < 4000 then 'Needs Improvement' else 'Poor' end as lcp_status, case when cls < 0.1 then 'Good' when cls < 0.25 then 'Needs Improvement' else 'Poor' end as cls_status from b""")
def _(spark, sf):
    return SPEED.flatten_reports(speed_reports(spark, sf)).select("url", "perf_score", "seo_score", "lcp_ms", "inp_ms", "cls", "lcp_status", "cls_status")


@query("src_06_web_vitals", P, "select url, case when k % 10 <> 0 then round(response_time_ms * 2 / cast(1000 as double), 6) end as lcp_s, round((k % 5) / cast(10 as double), 6) as cls, round(response_time_ms / cast(4000 as double), 6) as inp_s from fx_pages")
def _(spark, sf):
    out = SPEED.web_vitals(speed_reports(spark, sf))
    return out.select("url", *[F.round(c, 6).alias(c) for c in ("lcp_s", "cls", "inp_s")])


_ITEMS = "it AS (select url, i, round(i * cast(10.04 as double), 1) as wasted_ms from (select url, unnest(range(1, k % 13 + 2)) as i from fx_pages) t)"


@query("src_07_render_blocking", P, f"WITH {_ITEMS} select url, concat('https://cdn.example.com/', i, '.css') as resource, cast(i * 100 as bigint) as bytes, wasted_ms, cast(row_number() over (partition by url order by wasted_ms desc) as int) as rank from it qualify rank <= 10")
def _(spark, sf):
    return SPEED.render_blocking(speed_reports(spark, sf))[0]


@query("src_07_render_blocking_totals", P, f"WITH {_ITEMS} select url, count(*) as count, round(sum(wasted_ms), 1) as total_wasted_ms from it group by url")
def _(spark, sf):
    return SPEED.render_blocking(speed_reports(spark, sf))[1]


# --- structured data and head facts -----------------------------------------------------------------------------------

def marked_pages(spark, sf):
    """Raw pages with head links, robots and viewport tags, structured data and a breadcrumb list put in."""
    k = F.col("page_id")
    data = (
        F.when(k % 6 == 0, '<script type="application/ld+json">{"@context":"https://schema.org","@type":"Article","headline":"H","author":{"@type":"Person","name":"Ann"}}</script>')
        .when(k % 6 == 1, '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"Product","name":"P","aggregateRating":{"ratingValue":"4.5","reviewCount":12}},{"@type":["Organization","LocalBusiness"],"name":"O"}]}</script>')
        .when(k % 6 == 2, '<script type="application/ld+json">{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"Two","item":"/2"},{"position":1,"name":"One","item":"/1"}]}</script><script type="application/ld+json">{bad json</script>')
        .when(k % 6 == 3, '<script type="application/ld+json">[{"@context":"http://example.com","@type":"SaaS"},{"name":"no type"}]</script>')
        .otherwise(""))
    head = F.concat(
        F.lit('<link rel="canonical" href="/c/../page"><link rel="alternate" hreflang="de" href="https://de.example.com/"><link rel=stylesheet href=/s.css><link rel="next" href="?page=2"><LINK REL="PREV" HREF="p0.html">'
              '<meta name="viewport" content="width=device-width"><meta NAME="Robots" content="NOINDEX, follow"><meta name="description" content=" A &amp; B "><meta property="og:title" content="OG"><meta name="twitter:card" content="summary">'),
        data, F.lit("</head>"))
    crumbs = F.when(k % 2 == 0, '<body><nav aria-label="Breadcrumb"><ol><li><a href="/">Home</a></li><li>Here</li></ol></nav><img src="/a.jpg" loading=lazy><img src="/b.webp" alt="B" width=1 height=1 srcset="x 1x"><h2>Sub <b>head</b></h2>').otherwise("<body>")
    return raw_pages(spark, sf).select("page_id", "url", F.replace(F.replace("html", F.lit("</head>"), head), F.lit("<body>"), crumbs).alias("html"))


def marked_facts(spark, sf):
    return once(spark, sf, "marked-pages", lambda: extract_pages(marked_pages(spark, sf)))


_RT = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_PTH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


@query("src_02i_head_links", (), f"""select url, concat({_RT}, '/page') as canonical, 'de=https://de.example.com/' as hreflang, concat({_RT}, {_PTH}, '?page=2') as pagination_next, concat({_RT}, regexp_replace({_PTH}, '[^/]*$', ''), 'p0.html') as pagination_prev from pages""")
def _(spark, sf):
    tags = F.array_join(F.transform("hreflang_tags", lambda t: F.concat(t["lang"], F.lit("="), t["href"])), "|")
    return marked_facts(spark, sf).select("url", "canonical", tags.alias("hreflang"), "pagination_next", "pagination_prev")


@query("src_02j_robots_directives", (), "select url, 'noindex, follow' as robots_meta, true as robots_noindex, false as robots_nofollow, 'width=device-width' as viewport, 'A & B' as meta_description, 'OG' as og_title, 'summary' as twitter_card from pages")
def _(spark, sf):
    return marked_facts(spark, sf).select("url", "robots_meta", "robots_noindex", "robots_nofollow", "viewport", "meta_description", "og_title", "twitter_card")


@query("src_02c_structured_data", (), """select url, case page_id % 6 when 0 then 'Article' when 1 then 'Product|Organization|LocalBusiness' when 2 then 'BreadcrumbList' else '' end as schema_types, case page_id % 6 when 1 then cast(4.5 as double) end as schema_rating,
 case page_id % 6 when 1 then cast(12 as int) end as schema_review_count, case page_id % 6 when 0 then 'Ann' else '' end as schema_author from pages""")
def _(spark, sf):
    return marked_facts(spark, sf).select("url", F.array_join("schema_types", "|").alias("schema_types"), "schema_rating", "schema_review_count", "schema_author")


@query("src_02d_breadcrumbs", (), """select url, case when page_id % 6 = 2 then 'json_ld' when page_id % 2 = 0 then 'html_nav' else '' end as breadcrumb_source, case when page_id % 6 = 2 then 'One>Two' when page_id % 2 = 0 then 'Home>Here' else '' end as trail,
 cast(case when page_id % 2 = 0 then 2 else 0 end as int) as img_total, cast(case when page_id % 2 = 0 then 1 else 0 end as int) as img_lazy_count, cast(case when page_id % 2 = 0 then 1 else 0 end as int) as img_missing_alt, cast(case when page_id % 2 = 0 then 1 else 0 end as int) as img_non_modern_count,
 case when page_id % 2 = 0 then 'Subhead' else '' end as h2 from pages""")
def _(spark, sf):
    trail = F.array_join(F.transform("breadcrumbs", lambda b: b["name"]), ">")
    return marked_facts(spark, sf).select("url", "breadcrumb_source", trail.alias("trail"), "img_total", "img_lazy_count", "img_missing_alt", "img_non_modern_count", F.array_join("h2", "|").alias("h2"))


@query("src_09_structured_data_blocks", (), """select url, cast(b as int) as block, cast(p as int) as pos, k as kind from (
 select url, 0 as b, 0 as p, case page_id % 6 when 0 then 'object' when 1 then 'object' when 2 then 'object' when 3 then 'object' end as k, page_id from pages where page_id % 6 < 4
 UNION ALL select url, 1, 0, 'error', page_id from pages where page_id % 6 = 2 UNION ALL select url, 0, 1, 'object', page_id from pages where page_id % 6 = 3) t""")
def _(spark, sf):
    out = SD.blocks(marked_pages(spark, sf))
    return out.select("url", "block", "pos", F.when(F.col("error").isNotNull(), "error").otherwise("object").alias("kind"))


@query("iss_17_structured_data_checks", (), """select url, case page_id % 6 when 0 then 'Article' when 1 then 'Product' when 2 then 'BreadcrumbList' else 'SaaS' end as type, case page_id % 6 when 0 then 'Article.datePublished' when 1 then 'Product.offers' else '' end as issues,
 case page_id % 6 when 0 then '' when 1 then 'missing @context' when 2 then 'missing @context' else 'unexpected @context|risky type SaaS' end as warnings from pages where page_id % 6 < 4
 UNION ALL select url, 'Organization', 'LocalBusiness.address|LocalBusiness.telephone', 'missing @context' from pages where page_id % 6 = 1
 UNION ALL select url, null, 'syntax error', '' from pages where page_id % 6 = 2 UNION ALL select url, null, 'missing @type', '' from pages where page_id % 6 = 3""")
def _(spark, sf):
    out = SD.validate_blocks(SD.blocks(marked_pages(spark, sf)))
    return out.select("url", "type", F.array_join("issues", "|").alias("issues"), F.array_join("warnings", "|").alias("warnings"))


@query("iss_18_structured_data_report", (), """select url, case page_id % 6 when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 2 else 0 end::bigint as objects, case page_id % 6 when 0 then 1 when 1 then 3 when 2 then 1 when 3 then 1 else 0 end::bigint as issues,
 case page_id % 6 when 1 then 2 when 2 then 1 when 3 then 2 else 0 end::bigint as warnings, case when page_id % 6 < 4 then 'invalid' else 'none' end as status from pages""")
def _(spark, sf):
    return SD.page_report(marked_pages(spark, sf)).select("url", "objects", "issues", "warnings", "status")


@query("iss_18_structured_data_site_report", (), """select count(*) as pages, count(*) filter (page_id % 6 < 4) as with_data, cast(sum(case page_id % 6 when 0 then 1 when 1 then 2 when 2 then 2 when 3 then 2 else 0 end) as bigint) as objects,
 cast(sum(case page_id % 6 when 0 then 1 when 1 then 3 when 2 then 1 when 3 then 1 else 0 end) as bigint) as issues, 0::bigint as skipped from pages""")
def _(spark, sf):
    return SD.site_report(SD.page_report(marked_pages(spark, sf))).drop("warnings")
