"""Input views of the registered queries, derived from the driver tables.

Each view is one SQL text that is rendered for Spark and for DuckDB, so that a query and its oracle
start from the same rows; ``SPARK_TEXTS`` has another form for Spark where the common one would gather rows in one task. Facts the tables lack (status, canonical, headers and so on) are computed from
the row's key; no row is left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rankloom.schema import normalise_pages
from rankloom.sources.tables import kept

# Markers in the texts: RX'..' raw pattern, SUBALL(..) replace all matches, LIST(..) array, STRS empty string array,
# HEADERS(keys, values) map, ROW2(a, x, b, y) struct with two fields.
_PAGE_BASE = """
select p.page_id as k, regexp_replace(p.url, '#.*$', '') as url,
 regexp_extract(p.url, '^https?://([^/]+)', 1) as site,
 regexp_extract(p.html, '<title>([^<]*)</title>', 1) as raw_title,
 regexp_extract(p.html, '<h1>([^<]*)</h1>', 1) as raw_h1,
 octet_length(encode(p.html)) as n_bytes,
 trim(SUBALL(SUBALL(SUBALL(p.html, RX'(?s)<(title|style|script|nav|footer)[^>]*>.*?</(title|style|script|nav|footer)>', ' '),
  RX'<[^>]*>', ' '), RX'\\s+', ' ')) as body_text,
 regexp_replace(q.url, '#.*$', '') as canonical_target, q.page_id as canonical_id,
 regexp_replace(n.url, '#.*$', '') as next_url, regexp_replace(v.url, '#.*$', '') as prev_url
 from pages p
 left join pages q on q.page_id = p.page_id + case when p.page_id % 12 in (0, 1, 6) then 1 when p.page_id % 12 = 7 then -1 end
 left join pages n on n.page_id = p.page_id + 1
 left join pages v on v.page_id = p.page_id - 1
"""

# The same rows as Spark is to build them. Most pages have no canonical partner, so that key is null for them: they must not meet in one task.
# The markup is read before the joins; partners are looked up by number among narrow rows, and each page is dealt once, by its own number.
# Pages without a number have no partner either and are dealt by their place in the table, whatever addresses they share or lack. Who needs the start of a text only reads ``lead_text``.
_PAGE_BASE_SPARK = """
select p.k, p.url, p.site, p.raw_title, p.raw_h1, p.n_bytes, p.body_text, p.lead_text,
 regexp_replace(q.url, '#.*$', '') as canonical_target, q.page_id as canonical_id,
 regexp_replace(n.url, '#.*$', '') as next_url, regexp_replace(v.url, '#.*$', '') as prev_url
 from (select *, substr(body_text, 1, 189) as lead_text, coalesce(k, monotonically_increasing_id()) as dealt_by
 from (select page_id as k, regexp_replace(url, '#.*$', '') as url,
  regexp_extract(url, '^https?://([^/]+)', 1) as site,
  regexp_extract(html, '<title>([^<]*)</title>', 1) as raw_title,
  regexp_extract(html, '<h1>([^<]*)</h1>', 1) as raw_h1,
  octet_length(html) as n_bytes,
  trim(SUBALL(SUBALL(SUBALL(html, RX'(?s)<(title|style|script|nav|footer)[^>]*>.*?</(title|style|script|nav|footer)>', ' '),
   RX'<[^>]*>', ' '), RX'\\s+', ' ')) as body_text from pages) t) p
 left join (select a.page_id as of_id, b.page_id, b.url
  from (select distinct page_id, page_id + case when page_id % 12 in (0, 1, 6) then 1 when page_id % 12 = 7 then -1 end as partner from pages
   where page_id % 12 in (0, 1, 6, 7)) a join pages b on b.page_id = a.partner) q on q.of_id = p.dealt_by and p.k is not null
 left join (select page_id - 1 as of_id, url from pages) n on n.of_id = p.dealt_by and p.k is not null
 left join (select page_id + 1 as of_id, url from pages) v on v.of_id = p.dealt_by and p.k is not null
"""

_PAGE_FACTS = """
select k, url, site, body_text, next_url, prev_url,
 case when k % 19 = 0 then '' when k % 14 = 3 then 'Shared landing page' when k % 23 = 1 then concat('How to ', raw_title)
  else raw_title end as title,
 case when k % 9 = 0 then '' when k % 16 = 5 then 'One shared description for this whole section of the site, which is just long enough to pass the lower bound of length.'
  else trim(substr(body_text, 1, cast(60 + k % 130 as int))) end as meta_description,
 case when k % 10 = 0 then STRS when k % 6 = 1 then LIST(raw_h1, 'Second heading') else LIST(raw_h1) end as h1,
 case when k % 4 = 0 then STRS when k % 4 = 1 then LIST('How does it work', 'What is included', 'Pricing')
  when k % 4 = 2 then LIST('Overview') else LIST('Features', 'Why choose us', 'Reviews', 'Contact') end as h2,
 case when k % 3 = 0 then STRS else LIST('Details', 'More on this') end as h3,
 case when k % 5 = 0 then LIST(ROW2(level, 1, text, 'a'), ROW2(level, 3, text, 'b'))
  when k % 5 = 1 then LIST(ROW2(level, 1, text, 'a'), ROW2(level, 2, text, 'b'), ROW2(level, 2, text, 'c'), ROW2(level, 5, text, 'd'))
  when k % 5 = 2 then LIST(ROW2(level, 2, text, 'a'), ROW2(level, 3, text, 'b'), ROW2(level, 6, text, 'c'))
  else LIST(ROW2(level, 1, text, 'a'), ROW2(level, 2, text, 'b')) end as heading_sequence,
 case when k % 11 = 0 then 404 when k % 29 = 0 then 503 when k % 17 = 0 then 301 else 200 end as status_code,
 case when canonical_id is not null then canonical_target when k % 5 = 0 then '' else url end as canonical,
 case when k % 13 = 0 then 'noindex,follow' when k % 31 = 0 then 'index,nofollow' when k % 37 = 0 then 'none' else '' end as robots_meta,
 case when k % 41 = 0 then 'noindex' when k % 43 = 0 then 'nofollow' else '' end as x_robots_tag,
 (k % 13 = 0 or k % 41 = 0) as robots_noindex, (k % 41 = 0) as x_robots_noindex, (k % 43 = 0) as x_robots_nofollow,
 case when k % 4 = 0 then '' when k % 20 = 2 then 'width=1024' when k % 20 = 6 then 'width=device-width, user-scalable=no'
  when k % 20 = 14 then 'width=device-width, maximum-scale=1' else 'width=device-width, initial-scale=1' end as viewport,
 case when k % 3 = 0 then '' else 'Share title' end as og_title,
 case when k % 5 = 0 then '' else 'Summary' end as og_description,
 case when k % 2 = 0 then '' else 'https://img.example.com/a.png' end as og_image,
 case when k % 3 = 1 then '' else 'summary' end as twitter_card,
 cast(k % 7 as int) as img_total, cast(least(k % 7, k % 4) as int) as img_lazy_count, cast(least(k % 7, k % 6) as int) as img_srcset_count,
 cast(least(k % 7, k % 3) as int) as img_missing_alt, cast(least(k % 7, k % 2) as int) as img_missing_dims,
 cast(least(k % 7, k % 5) as int) as img_non_modern_count,
 case when k % 7 = 0 then cast(0 as double) else cast(100 as double) * least(k % 7, k % 4) / (k % 7) end as img_lazy_pct,
 case when k % 7 = 0 then cast(0 as double) else cast(100 as double) * least(k % 7, k % 6) / (k % 7) end as img_srcset_pct,
 case when k % 5 = 0 then STRS when k % 5 = 1 then LIST('logo', '') when k % 5 = 2 then LIST('', '')
  when k % 17 = 3 then LIST('one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen')
  else LIST('a photo', 'chart of results') end as img_alts,
 case when k % 4 = 0 then STRS when k % 4 = 1 then LIST('/a.webp', '/b.jpg?x=1', '/c.PNG') when k % 4 = 2 then LIST('/a.jpg', '/b.png')
  else LIST('/a.webp', '/b.avif') end as img_srcs,
 case when k % 4 = 0 then STRS when k % 4 = 1 then LIST('Article') when k % 4 = 2 then LIST('Product', 'Gadget') else LIST('WebPage') end as schema_types,
 case when k % 4 = 1 then LIST(ROW2(type, 'Article', props, LIST('headline', 'author')))
  when k % 4 = 2 then LIST(ROW2(type, 'Product', props, LIST('offers')), ROW2(type, 'FAQPage', props, LIST('mainEntity')))
  else LIST(ROW2(type, 'WebPage', props, LIST('name'))) end as schema_objects,
 (k % 3 <> 0) as breadcrumb_detected, case when k % 3 = 1 then 'json_ld' when k % 3 = 2 then 'html_nav' else '' end as breadcrumb_source,
 case when k % 12 = 0 and next_url is not null then LIST(ROW2(lang, 'en', href, url), ROW2(lang, 'de', href, next_url))
  when k % 12 = 6 and next_url is not null then LIST(ROW2(lang, 'en', href, url), ROW2(lang, 'english', href, next_url))
  when k % 12 = 1 then LIST(ROW2(lang, 'en', href, prev_url), ROW2(lang, 'x-default', href, prev_url), ROW2(lang, 'de', href, url))
  when k % 12 = 7 then LIST(ROW2(lang, 'de', href, url), ROW2(lang, 'de', href, 'https://elsewhere.example.com/de')) end as hreflang_tags,
 case when k % 36 = 5 then 'https://missing.example.com/p2' when k % 6 in (3, 5) then coalesce(next_url, '') else '' end as pagination_next,
 case when k % 36 = 11 then coalesce(next_url, '') when k % 36 = 17 then 'https://missing.example.com/p1'
  when k % 12 = 4 then coalesce(prev_url, '') else '' end as pagination_prev,
 case when k % 3 <> 0 and next_url is not null and k % 5 <> 0 and prev_url is not null then LIST(next_url, prev_url)
  when k % 3 <> 0 and next_url is not null then LIST(next_url) when k % 5 <> 0 and prev_url is not null then LIST(prev_url) else STRS end as links,
 case when k % 8 = 0 then LIST(ROW2(href, '/1', text, 'Pricing'), ROW2(href, '/2', text, 'pricing '), ROW2(href, '/3', text, 'pricing'), ROW2(href, '/4', text, 'pricing'), ROW2(href, '/5', text, 'Home'), ROW2(href, '/6', text, 'guide'))
  when k % 8 = 1 then LIST(ROW2(href, '/1', text, 'Click here'), ROW2(href, '/2', text, 'here'), ROW2(href, '/3', text, 'read more'), ROW2(href, '/4', text, 'more'), ROW2(href, '/5', text, 'this'), ROW2(href, '/6', text, 'link'))
  when k % 8 = 2 then LIST(ROW2(href, '/1', text, ''))
  else LIST(ROW2(href, '/1', text, 'Product A'), ROW2(href, '/2', text, 'Product B')) end as link_objects,
 case when k % 6 = 0 then HEADERS(LIST('strict-transport-security', 'content-security-policy', 'x-frame-options', 'x-content-type-options', 'referrer-policy', 'permissions-policy', 'content-type', 'content-encoding', 'cache-control', 'etag'),
   LIST('max-age=31536000; includeSubDomains; preload', 'default-src https:', 'DENY', 'nosniff', 'no-referrer', 'camera=()', 'text/html; charset=utf-8', 'gzip', 'max-age=7200', 'v1'))
  when k % 6 = 1 then HEADERS(LIST('strict-transport-security', 'content-security-policy', 'content-type', 'cache-control'), LIST('max-age=86400', concat('script-src ', chr(39), 'unsafe-inline', chr(39)), 'text/html', 'no-store'))
  when k % 6 = 2 then HEADERS(LIST('content-type', 'cache-control', 'strict-transport-security'), LIST('text/html', 'max-age=0', 'includeSubDomains'))
  when k % 6 = 3 then HEADERS(LIST('x-frame-options', 'x-content-type-options', 'content-type', 'cache-control'), LIST('DENY', 'nosniff', 'image/png', 'public, max-age=600'))
  when k % 6 = 4 then HEADERS(LIST('content-security-policy', 'content-type'), LIST(concat('default-src ', chr(39), 'none', chr(39), '; script-src ', chr(39), 'unsafe-eval', chr(39)), 'application/json'))
  else HEADERS(STRS, STRS) end as response_headers,
 cast((k * 37) % 4000 as int) as response_time_ms, cast((k * 13) % 150 as int) as resource_count,
 cast(n_bytes as double) / 1024 + case when k % 40 = 1 then 2100 when k % 40 = 2 then 600 else 0 end as html_size_kb,
 cast(case when k % 17 = 0 then 1 + k % 3 else 0 end as int) as redirect_hops,
 case when k % 21 = 0 then 'TLSv1.1' when k % 22 = 1 then 'TLSv1' when k % 8 = 3 then '' else 'TLSv1.3' end as tls_version,
 case when k % 10 = 3 then LIST('http://cdn.example.com/a.js', 'http://cdn.example.com/b.js') else STRS end as mixed_resources,
 case when k % 5 = 0 then '' when k % 29 = 5 then 'yesterday'
  else concat('Wed, ', lpad(cast(1 + k % 28 as varchar(4)), 2, '0'), case when k % 2 = 0 then ' Oct ' else ' Mar ' end, cast(2023 + k % 4 as varchar(4)), ' 07:28:00 GMT') end as last_modified,
 case when k % 11 = 5 then STRS else LIST(lower(regexp_extract(body_text, '([A-Za-z]{4,})', 1)), concat('buy ', lower(regexp_extract(raw_title, '([A-Za-z]{4,})', 1))), concat('topic ', cast(k % 12 as varchar(4)))) end as keywords,
 case when k % 6 = 1 then 'A. Writer' else '' end as schema_author,
 case when k % 6 = 2 then cast(3.5 as double) + (k % 4) / cast(4 as double) end as schema_rating,
 case when k % 7 = 1 then LIST('https://en.wikipedia.org/wiki/Page', 'https://shop.example.net/') when k % 7 = 2 then LIST('https://www.university.edu/x') else STRS end as external_links
 from page_base
"""

_PAGES = """
select *, (status_code >= 400) as is_error, cast(len_links as int) as internal_links_count from
 (select *, case when k % 9 = 4 then 40 else 2 end as len_links from page_facts) t
"""

_LINK_NODES = """
select url, min(case when s % 13 = 0 then 404 when s % 31 = 0 then 500 else 200 end) as status_code, min(case when s % 7 = 0 then 2 else 0 end) as redirect_hops from
 (select concat('https://s.example.com/', cast(l_suppkey % 20 as varchar(20)), '/', cast(l_suppkey as varchar(20))) as url, l_suppkey as s from lineitem) t group by url
"""

_LINKS = """
select distinct concat('https://s.example.com/', cast(l_suppkey % 20 as varchar(20)), '/', cast(l_suppkey as varchar(20))) as src,
 concat('https://s.example.com/', cast(((l_suppkey * 7 + l_linenumber) % 97) % 20 as varchar(20)), '/', cast((l_suppkey * 7 + l_linenumber) % 97 as varchar(20))) as dst from lineitem
"""

_RANK_CHECKS = """
select concat('d', cast(user_id % 5 as varchar(20)), '.example.com') as domain, concat('kw', cast(user_id as varchar(20))) as keyword,
 case when value > 60 then null else cast(floor(value) as int) + 1 end as position, ts as checked_at, event_id as check_id, event_type from events
"""

_DOC_PAGES = """
select doc_id, source as site, concat('https://', source, '.example.com/', cast(doc_id as varchar(20))) as url, text, lower(text) as body_text from documents
"""

_SNAPSHOTS = """
select o_custkey % 50 as project_id, cast(o_orderdate as date) as crawled_at, concat('u', cast(o_orderkey % 40 as varchar(20))) as url, o_orderpriority as issue from orders
"""

VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "page_base": (_PAGE_BASE, ()),
    "page_facts": (_PAGE_FACTS, ("page_base",)),
    "fx_pages": (_PAGES, ("page_facts",)),
    "fx_link_nodes": (_LINK_NODES, ()),
    "fx_links": (_LINKS, ()),
    "fx_rank_checks": (_RANK_CHECKS, ()),
    "fx_docs": (_DOC_PAGES, ()),
    "fx_snapshots": (_SNAPSHOTS, ()),
}
# A description is at most 60 + 129 characters of the text.
SPARK_TEXTS = {"page_base": _PAGE_BASE_SPARK, "page_facts": _PAGE_FACTS.replace("substr(body_text, 1, cast(60 + k % 130", "substr(lead_text, 1, cast(60 + k % 130")}
TABLES = ("pages", "lineitem", "events", "documents", "orders", "supplier")


def _suball(text: str, render) -> str:
    """Rewrite SUBALL(x, pattern, replacement), which may be nested."""
    while "SUBALL(" in text:
        start = text.rindex("SUBALL(")
        depth, i, quoted = 0, start + len("SUBALL"), False
        while True:
            ch = text[i]
            if ch == "'":
                quoted = not quoted
            elif not quoted and ch == "(":
                depth += 1
            elif not quoted and ch == ")":
                depth -= 1
                if depth == 0:
                    break
            i += 1
        text = text[:start] + render(text[start + len("SUBALL("): i]) + text[i + 1:]
    return text


def spark_text(sql: str) -> str:
    sql = _suball(sql, lambda args: f"regexp_replace({args})").replace("RX'", "r'")
    sql = sql.replace("STRS", "cast(array() as array<string>)").replace("LIST(", "array(")
    sql = sql.replace("HEADERS(", "map_from_arrays(").replace("encode(p.html)", "p.html")
    return re.sub(r"ROW2\((\w+), (.*?), (\w+), ", r"named_struct('\1', \2, '\3', ", sql)


def duck_text(sql: str) -> str:
    sql = _suball(sql, lambda args: f"regexp_replace({args}, 'g')").replace("RX'", "'")
    sql = sql.replace("STRS", "cast([] as varchar[])").replace("LIST(", "list_value(")
    sql = sql.replace("HEADERS(", "map(")
    return re.sub(r"ROW2\((\w+), (.*?), (\w+), ", r"struct_pack(\1 := \2, \3 := ", sql)


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for dep in (*_closure(VIEWS[name][1]), name):
            if dep not in out:
                out.append(dep)
    return out


def ctes(*names: str) -> str:
    """``WITH`` list that defines the views for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({duck_text(VIEWS[n][0])})" for n in _closure(names)) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view as a DataFrame."""
    chain = _closure((name,))
    body = f"select * from {name}"
    with_list = ",\n".join(f"{n} AS ({spark_text(SPARK_TEXTS.get(n, VIEWS[n][0]))})" for n in chain)
    used = {t: table(spark, sf_dir, t) for t in TABLES if re.search(rf"\bfrom {t}\b|\bjoin {t}\b", with_list)}
    sql = f"WITH {with_list}\n{body}"
    for t in used:
        sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
    sql = re.sub(r"\{4,\}", "{{4,}}", sql)
    return spark.sql(sql, **used)


_SHARED: dict[tuple[str, str], DataFrame] = {}
_ADDRESSES: dict[tuple[str, str], DataFrame] = {}


def fx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page facts with the full page schema, derived once per application and kept as a table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        rows = normalise_pages(view(spark, sf_dir, "fx_pages"))
        _SHARED[key] = kept(rows, "page-facts")
    return _SHARED[key]


# Page facts that follow from number and address.
ADDRESS_FACTS = ("url", "site", "status_code", "is_error", "canonical", "robots_meta", "x_robots_tag", "robots_noindex", "hreflang_tags", "links")


def fx_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of all pages that follow from number and address, kept as a table of its own unless all facts are: no text is dealt for them."""
    app = spark.sparkContext.applicationId
    if (app, sf_dir) in _SHARED:
        return _SHARED[app, sf_dir].select(*ADDRESS_FACTS)
    if (app, sf_dir) not in _ADDRESSES:
        _ADDRESSES[app, sf_dir] = kept(normalise_pages(view(spark, sf_dir, "fx_pages")).select(*ADDRESS_FACTS), "page-addresses")
    return _ADDRESSES[app, sf_dir]


def fx_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_docs")
