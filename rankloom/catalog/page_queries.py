"""Queries over the page view: page checks, technical audit and URL and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import lookups as L
from rankloom.catalog.fixtures import fx_docs, fx_pages
from rankloom.catalog.registry import query, union_rows
from rankloom.functions import scores as S, text as TX, urls as U
from rankloom.operators import page_issues as PI, technical as TE

P = ("fx_pages",)
NOW = "2026-11-28 00:00:00"


def _sql_list(values) -> str:
    return "(" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + ")"


def hdr(name: str) -> str:
    return f"coalesce(response_headers['{name}'], '')"


# Word count of the body and the parts of the URL, as DuckDB text.
WS = "[\\s\\x{85}\\p{Z}]+"
WC = f"len(list_filter(regexp_split_to_array(body_text, '{WS}'), lambda w: w <> ''))"
PATH = "regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
DEPTH = f"len(list_filter(string_split({PATH}, '/'), lambda s: s <> ''))"

_LIGHT = [
    ("is_error", "'Broken Page'"),
    ("not is_error and length(title) = 0", "'Missing Title'"),
    ("not is_error and length(title) > 60", "'Title Too Long'"),
    (f"not is_error and length(title) between 1 and 29 and rtrim({PATH}, '/') <> ''", "'Title Too Short'"),
    ("not is_error and length(meta_description) = 0", "'Missing Meta Description'"),
    ("not is_error and length(meta_description) > 160", "'Meta Description Too Long'"),
    ("not is_error and length(meta_description) between 1 and 119", "'Meta Description Too Short'"),
    ("not is_error and len(h1) = 0", "'Missing H1'"),
    ("not is_error and len(h1) > 1", "'Multiple H1 Tags'"),
    ("not is_error and len(h2) = 0", "'Missing H2'"),
    ("not is_error and status_code <> 200", "'Broken Page'"),
    ("not is_error and canonical = ''", "'Missing Canonical'"),
    ("not is_error and canonical <> '' and rtrim(canonical, '/') <> rtrim(url, '/')", "'Canonical Mismatch'"),
]
_TRIMMED = "(select * replace (trim(title) as title, trim(meta_description) as meta_description, trim(canonical) as canonical) from fx_pages)"
LIGHT_SQL = union_rows(_TRIMMED, "url", _LIGHT, ("issue",))
DUP_SQL = LIGHT_SQL + """
UNION ALL select url, 'Duplicate Title' as issue from fx_pages where not is_error and (site, lower(trim(title))) in
 (select site, lower(trim(title)) from fx_pages where not is_error and trim(title) <> '' group by 1, 2 having count(*) > 1)
UNION ALL select url, 'Duplicate Meta Description' as issue from fx_pages where not is_error and (site, lower(trim(meta_description))) in
 (select site, lower(trim(meta_description)) from fx_pages where not is_error and trim(meta_description) <> '' group by 1, 2 having count(*) > 1)
"""


@query("iss_01_light_labels", P, LIGHT_SQL)
def _(spark, sf):
    return PI.light_issues(fx_pages(spark, sf)).select("url", F.explode("issues").alias("issue"))


@query("iss_02_labels_with_duplicates", P, DUP_SQL)
def _(spark, sf):
    return PI.detect_issues(fx_pages(spark, sf)).select("url", F.explode("issues").alias("issue"))


_FIELDS = ("category", "severity", "code", "detail")


def _t(x: str) -> str:
    return f"cast({x} as varchar)"


def _validator_rules() -> list[tuple[str, ...]]:
    meta, xr = "lower(robots_meta)", "lower(x_robots_tag)"
    idx = [
        (f"contains({meta}, 'noindex') or contains({xr}, 'noindex')", "'indexability'", "'CRITICAL'", "'noindex'",
         f"case when contains({xr}, 'noindex') then 'header' else 'meta' end"),
        (f"x_robots_nofollow or contains({xr}, 'nofollow') or contains({xr}, 'none')", "'indexability'", "'HIGH'",
         "'header_nofollow'", "''"),
        ("rtrim(canonical, '/') <> '' and rtrim(canonical, '/') <> rtrim(url, '/')", "'indexability'", "'HIGH'",
         "'canonical_conflict'", "rtrim(canonical, '/')"),
    ]
    ok = "not is_error and "
    total = "img_total"
    ct = f"trim(split_part(lower({hdr('content-type')}), ';', 1))"
    sq = f"{ct} in {_sql_list(L.COMPRESSIBLE_TYPES)}"
    age = f"try_cast(regexp_extract({hdr('cache-control')}, '(?i)max-age\\s*=\\s*(\\d+)', 1) as bigint)"
    view = "lower(trim(viewport))"
    rules = [
        (ok + f"{WC} = 0", "'content'", "'MEDIUM'", "'no_content'", "''"),
        (ok + f"{WC} between 1 and 299", "'content'", "'MEDIUM'", "'thin_content'", _t(WC)),
        (ok + f"{total} > 0 and img_missing_alt > 0", "'images'", "'MEDIUM'", "'missing_alt'", _t("img_missing_alt")),
        (ok + f"{total} > 0 and img_missing_dims > 0", "'images'", "'MEDIUM'", "'missing_dimensions'", _t("img_missing_dims")),
        (ok + f"{total} > 2 and 2 * img_lazy_count < {total}", "'images'", "'MEDIUM'", "'few_lazy_images'",
         f"concat(img_lazy_count, '/', {total})"),
        (ok + "try_cast(regexp_extract(tls_version, '(\\d+\\.\\d+)', 1) as double) < 1.2", "'security'", "'CRITICAL'",
         "'weak_tls'", "tls_version"),
        (ok + f"{view} = ''", "'mobile'", "'HIGH'", "'missing_viewport'", "''"),
        (ok + f"{view} <> '' and not contains({view}, 'width=device-width')", "'mobile'", "'HIGH'", "'no_device_width'", "''"),
        (ok + f"contains({view}, 'user-scalable=no')", "'mobile'", "'MEDIUM'", "'zoom_disabled'", "''"),
        (ok + f"contains({view}, 'maximum-scale=1')", "'mobile'", "'MEDIUM'", "'zoom_limited'", "''"),
        (ok + "resource_count > 100", "'performance'", "'HIGH'", "'many_resources'", _t("resource_count")),
        (ok + "html_size_kb > 2048", "'performance'", "'HIGH'", "'large_html'", _t("html_size_kb")),
        (ok + "img_non_modern_count > 0", "'performance'", "'MEDIUM'", "'legacy_images'", _t("img_non_modern_count")),
        (ok + "pagination_next <> '' and pagination_next = pagination_prev", "'pagination'", "'HIGH'",
         "'next_equals_prev'", "pagination_next"),
        (ok + f"{hdr('cache-control')} = ''", "'cache_compression'", "'HIGH'", "'no_cache_control'", "''"),
        (ok + f"{age} = 0", "'cache_compression'", "'HIGH'", "'max_age_zero'", "''"),
        (ok + f"{age} > 0 and {age} < 3600", "'cache_compression'", "'MEDIUM'", "'short_max_age'", _t(age)),
        (ok + f"{age} is null and contains({hdr('cache-control')}, 'no-store')", "'cache_compression'", "'HIGH'", "'no_store'", "''"),
        (ok + f"{sq} and {hdr('etag')} = ''", "'cache_compression'", "'MEDIUM'", "'no_etag'", "''"),
        (ok + f"{sq} and not regexp_matches(lower({hdr('content-encoding')}), 'gzip|br|deflate|zstd')",
         "'cache_compression'", "'HIGH'", "'not_compressed'", "''"),
    ]
    for name in L.SECURITY_HEADERS[1:]:
        sev = "HIGH" if name in ("referrer-policy", "permissions-policy") else "MEDIUM"
        rules.append((ok + f"not map_contains(response_headers, '{name}')", "'security'", f"'{sev}'", f"'missing_{name}'", "''"))
    return idx + rules


_RULES = _validator_rules()


def _rules_for(*categories: str) -> str:
    picked = [r for r in _RULES if r[1].strip("'") in categories]
    return union_rows("fx_pages", "url", picked, _FIELDS)


_CONTENT_SQL = _rules_for("content") + f"""
UNION ALL select url, 'content', 'MEDIUM', 'keyword_overuse', first_kw from kw where n >= 50 and first_kw is not null
 and 100.0 * cast((length(low) - length(replace(low, first_kw, ''))) / length(first_kw) as int) / n > 4
UNION ALL select url, 'content', 'MEDIUM', 'keyword_not_prominent', first_kw from kw where n >= 50 and first_kw = lower(keywords[1])
 and not contains(lower(array_to_string(list_filter(regexp_split_to_array(body_text, '{WS}'), lambda w: w <> '')[1:100], ' ')), first_kw)
"""
_KW_CTE = f"""WITH kw AS (select *, list_filter(list_transform(keywords[1:5], lambda x: lower(x)), lambda x: x <> '' and contains(low, x))[1] as first_kw from
 (select *, lower(trim(body_text)) as low, {WC} as n from fx_pages where not is_error) t)
"""
_HEADING_SQL = """
select url, 'headings' as category, 'MEDIUM' as severity, 'heading_skip' as code, concat('H', prev, '>H', curr, ' misses H', m) as detail from
 (select url, prev, curr, unnest(range(prev + 1, curr)) as m from
  (select url, heading_sequence[i].level as prev, heading_sequence[i + 1].level as curr from
    (select url, heading_sequence, unnest(range(1, len(heading_sequence))) as i from fx_pages where not is_error) a) b where curr > prev + 1) c
"""
_HREFLANG_SQL = """
select url, 'hreflang' as category, 'MEDIUM' as severity, 'invalid_language_code' as code, lang as detail from
 (select url, unnest(list_transform(hreflang_tags, lambda t: t.lang)) as lang from fx_pages where not is_error) a
 where not regexp_matches(lang, '(?i)^(x-default|[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|[0-9]{3}))?)$')
UNION ALL select url, 'hreflang', 'MEDIUM', 'missing_x_default', '' from fx_pages
 where not is_error and len(hreflang_tags) > 0 and not list_contains(list_transform(hreflang_tags, lambda t: lower(t.lang)), 'x-default')
UNION ALL select url, 'hreflang', 'MEDIUM', 'repeated_language_code', string_agg(lang, ',' order by lang) from
 (select url, lang from (select url, unnest(list_transform(hreflang_tags, lambda t: lower(t.lang))) as lang from fx_pages where not is_error) b
  group by url, lang having count(*) > 1) c group by url
"""
_ANCHOR_CTE = f"""WITH anch AS (select url, a from (select url, unnest(list_transform(link_objects, lambda o: lower(trim(o.text)))) as a from fx_pages where not is_error) t),
 g AS (select url, count(*) as n from anch where a in {_sql_list(L.GENERIC_ANCHORS)} group by url),
 u AS (select url, a, count(*) as n from anch where a <> '' and a not in {_sql_list(L.GENERIC_ANCHORS)} group by url, a),
 o AS (select url, count(*) as k, max_by(a, n) as worst from u where n > 3 group by url)
"""
_LINKS_SQL = """select url, 'links' as category, 'MEDIUM' as severity, 'generic_anchors' as code, cast(n as varchar) as detail from g
UNION ALL select url, 'links', 'HIGH', 'anchor_overuse', worst from o"""


def _issue_rows(*categories: str):
    def build(spark, sf):
        return PI.page_issue_rows(fx_pages(spark, sf), list(categories))

    return build


for _name, _cats, _sql in [
    ("iss_03_indexability", ("indexability",), _rules_for("indexability")),
    ("iss_05_content", ("content",), _KW_CTE + _CONTENT_SQL),
    ("iss_06_heading_skips", ("headings",), _HEADING_SQL),
    ("iss_07_hreflang_codes", ("hreflang",), _HREFLANG_SQL),
    ("iss_08_images", ("images",), _rules_for("images")),
    ("iss_09_security_headers", ("security",), _rules_for("security")),
    ("iss_10_viewport", ("mobile",), _rules_for("mobile")),
    ("iss_11_performance", ("performance",), _rules_for("performance")),
    ("iss_12_pagination_self_conflict", ("pagination",), _rules_for("pagination")),
    ("iss_13_cache_compression", ("cache_compression",), _rules_for("cache_compression")),
]:
    query(_name, P, _sql)(_issue_rows(*_cats))


@query("iss_04_anchor_quality", P, _ANCHOR_CTE + """
select p.url, cast(case when len(p.link_objects) = 0 or p.is_error then 100 else greatest(0, 100 - least(40, 8 * coalesce(g.n, 0)) - least(30, 10 * coalesce(o.k, 0))
 - case when len(p.link_objects) > 5 and coalesce(d.k, 0) * 1.0 / len(p.link_objects) < 0.5 then 10 else 0 end) end as int) as anchor_quality_score,
 cast(coalesce(g.n, 0) as int) as generic, cast(coalesce(o.k, 0) as int) as overused
 from fx_pages p left join g using (url) left join o using (url) left join (select url, count(*) as k from u group by url) d using (url)""")
def _(spark, sf):
    out = PI.with_anchor_quality(fx_pages(spark, sf))
    return out.select("url", "anchor_quality_score", F.col("_generic").alias("generic"), F.size("_overused").alias("overused"))


_EXTRA_CONTENT = _CONTENT_SQL[_CONTENT_SQL.index("UNION ALL select url, 'content', 'MEDIUM', 'keyword_overuse'"):]
_ALL_RULES = (
    "all_rows AS (" + union_rows("fx_pages", "url", _RULES, _FIELDS) + "\nUNION ALL\n" + _HEADING_SQL + "\nUNION ALL\n"
    + _HREFLANG_SQL + "\nUNION ALL\n" + _LINKS_SQL + "\n" + _EXTRA_CONTENT + ")"
)


@query("iss_14_page_validator", P, _ANCHOR_CTE + "," + _KW_CTE[5:] + "," + _ALL_RULES + """
select p.url, cast(count(a.url) as int) as issue_count, cast(count(*) filter (a.severity = 'CRITICAL') as int) as critical,
 cast(count(*) filter (a.severity = 'HIGH') as int) as high, cast(count(distinct a.category) as int) as categories
 from fx_pages p left join all_rows a on a.url = p.url group by p.url""")
def _(spark, sf):
    out = PI.validate_pages(fx_pages(spark, sf))
    def n(severity):
        return F.size(F.filter("all_issues", lambda i: i["severity"] == severity))
    return out.select("url", "issue_count", n("CRITICAL").alias("critical"), n("HIGH").alias("high"),
                      F.size(F.array_distinct(F.transform("all_issues", lambda i: i["category"]))).alias("categories"))


@query("iss_16_priority", P, f"""WITH rows AS ({DUP_SQL}) select p.url, case
 when count(r.issue) = 0 then '' when count(*) filter (r.issue in ('Broken Page', 'Missing Title')) > 0 then 'High'
 when count(*) filter (r.issue in ('Missing Meta Description', 'Missing H1', 'Duplicate Meta Description', 'Multiple H1 Tags')) > 0 then 'Medium'
 else 'Low' end as priority from fx_pages p left join rows r using (url) group by p.url""")
def _(spark, sf):
    pages = PI.detect_issues(fx_pages(spark, sf))
    return pages.select("url", PI.priority_label(F.col("issues")).alias("priority"))


_HSTS = hdr("strict-transport-security")


@query("iss_19_hsts", P, f"""select url, age as max_age, {_HSTS} <> '' as present, case when {_HSTS} = '' then 'missing'
 when age >= 31536000 and regexp_matches({_HSTS}, '(?i)includesubdomains') and regexp_matches({_HSTS}, '(?i)preload') then 'good' else 'weak' end as status,
 cast(case when {_HSTS} = '' then 1 else (case when age is null then 1 when age < 31536000 then 1 else 0 end)
  + (case when regexp_matches({_HSTS}, '(?i)includesubdomains') then 0 else 1 end) + (case when regexp_matches({_HSTS}, '(?i)preload') then 0 else 1 end) end as int) as issues
 from (select *, try_cast(regexp_extract({_HSTS}, '(?i)max-age\\s*=\\s*(\\d+)', 1) as bigint) as age from fx_pages) t""")
def _(spark, sf):
    checked = fx_pages(spark, sf).select("url", PI.hsts_check().alias("h"))
    return checked.select("url", "h.max_age", "h.present", "h.status", F.size("h.issues").alias("issues"))


# --- technical audit --------------------------------------------------------------------------------------------------

def px(col: str) -> str:
    narrow = "[iIl|!.,;:''\"\\-()\\[\\]{}1 /\\\\]"
    n = f"(length({col}) - length(regexp_replace({col}, '{narrow}', '', 'g')))"
    w = f"(length({col}) - length(regexp_replace({col}, '{L.WIDE_GLYPHS}', '', 'g')))"
    return f"cast(floor(7.5 * length({col}) - 3 * {n} + 3 * {w} + 0.5) as int)"


_TT, _MM, _CC = "trim(title)", "trim(meta_description)", "trim(canonical)"


def _len_score(c, low, high, limit, px_score):
    return f"case when length({c}) = 0 then 0 when length({c}) < {low} then 55 when length({c}) > {high} then 65 when {px(c)} > {limit} then {px_score} else 100 end"


def _len_status(c, low, high, limit):
    return f"case when length({c}) = 0 then 'missing' when length({c}) < {low} then 'too_short' when length({c}) > {high} then 'too_long' when {px(c)} > {limit} then 'pixel_overflow' else 'ok' end"


_URL_ISSUES = (
    f"((case when url like 'https:%' then 0 else 1 end) + (case when length(url) > 115 then 1 else 0 end) + (case when contains({PATH}, '_') then 1 else 0 end)"
    f" + (case when {PATH} <> lower({PATH}) then 1 else 0 end) + (case when contains(url, '%20') or contains(url, '+') then 1 else 0 end) + (case when {DEPTH} > 4 then 1 else 0 end))"
)
_FILLED = "len(list_filter(img_alts, lambda a: trim(a) <> ''))"
SCORE_SQL = {
    "title": _len_score(_TT, 30, 60, 580, 75),
    "meta": _len_score(_MM, 120, 160, 920, 80),
    "canonical": f"case when {_CC} = '' then 0 when rtrim({_CC}, '/') = rtrim(url, '/') then 100 else 60 end",
    "headings": "case when len(h1) = 0 then 20 when len(h1) > 1 then 55 when len(h2) = 0 then 70 else 100 end",
    "og": "case when og_title <> '' and og_description <> '' and og_image <> '' then 100 when og_title <> '' and og_description <> '' then 75 when og_title <> '' or og_description <> '' then 55 else 0 end",
    "content": f"case when {WC} < 100 then 30 when {WC} < 300 then 55 when {WC} < 800 then 80 else 100 end",
    "url": f"case when {_URL_ISSUES} = 0 then 100 when {_URL_ISSUES} = 1 then 75 else greatest(30, 100 - 18 * {_URL_ISSUES}) end",
    "images": f"case when len(img_alts) = 0 or {_FILLED} = len(img_alts) then 100 when {_FILLED} > 0 then greatest(40, cast(round(100.0 * {_FILLED} / len(img_alts), 0) as int)) else 0 end",
    "status": "case when is_error then 0 when status_code // 100 = 2 then 100 when status_code // 100 = 3 then 70 when status_code // 100 in (4, 5) then 0 else 50 end",
}
TECH_SCORE = "cast(round((" + " + ".join(f"{L.TECH_WEIGHTS[k]} * ({v})" for k, v in SCORE_SQL.items()) + ") / 100.0, 0) as int)"
INDEX_SQL = """case when robots_noindex then 'not_indexable_noindex' when is_error then 'not_indexable_error' when status_code // 100 = 3 then 'not_indexable_redirect'
 when status_code // 100 = 2 and trim(canonical) = '' then 'likely_indexable' when status_code // 100 = 2 and rtrim(trim(canonical), '/') = rtrim(url, '/') then 'indexable'
 when status_code // 100 = 2 then 'canonical_mismatch' else 'unknown' end"""
LETTER = "case when {0} >= 85 then 'A' when {0} >= 70 then 'B' when {0} >= 55 then 'C' when {0} >= 40 then 'D' else 'F' end"
SITE = "case when {0} >= 90 then 'A+' when {0} >= 80 then 'A' when {0} >= 70 then 'B' else 'Needs Fix' end"


def _sub(audit, *fields):
    def build(spark, sf):
        rows = TE.with_word_count(fx_pages(spark, sf)).select("url", audit().alias("a"))
        return rows.select("url", *[F.col(f"a.{f}").alias(f) for f in fields])

    return build


for _name, _audit, _cols in [
    ("tec_01_title", TE.title_audit, {"length": f"cast(length({_TT}) as int)", "px_est": px(_TT), "status": _len_status(_TT, 30, 60, 580), "score": SCORE_SQL["title"]}),
    ("tec_02_meta", TE.meta_audit, {"length": f"cast(length({_MM}) as int)", "px_est": px(_MM), "status": _len_status(_MM, 120, 160, 920), "score": SCORE_SQL["meta"]}),
    ("tec_03_canonical", TE.canonical_audit, {"status": f"case when {_CC} = '' then 'missing' when rtrim({_CC}, '/') = rtrim(url, '/') then 'self' else 'points_elsewhere' end", "score": SCORE_SQL["canonical"]}),
    ("tec_04_headings", TE.heading_audit, {"h1_count": "cast(len(h1) as int)", "h2_count": "cast(len(h2) as int)", "h3_count": "cast(len(h3) as int)", "depth": "case when len(h3) > 0 then 3 when len(h2) > 0 then 2 when len(h1) > 0 then 1 else 0 end", "score": SCORE_SQL["headings"]}),
    ("tec_05_open_graph", TE.open_graph_audit, {"has_og": "og_title <> '' or og_description <> ''", "completeness": "case when og_title <> '' and og_description <> '' and og_image <> '' then 'complete' when og_title <> '' or og_description <> '' then 'partial' else 'missing' end", "has_twitter": "twitter_card <> ''", "score": SCORE_SQL["og"]}),
    ("tec_06_content", TE.content_audit, {"word_count": f"cast({WC} as int)", "depth": f"case when {WC} < 300 then 'thin' when {WC} < 800 then 'medium' else 'rich' end", "link_density": f"case when {WC} > 0 then round(cast(100 as double) * internal_links_count / {WC}, 1) else cast(0 as double) end", "score": SCORE_SQL["content"]}),
    ("tec_07_url", TE.url_audit, {"is_https": "url like 'https:%'", "depth": f"cast({DEPTH} as int)", "has_query": "regexp_matches(url, '\\?[^#]')", "score": SCORE_SQL["url"]}),
    ("tec_08_image_alt", TE.image_alt_audit, {"captured": "cast(len(img_alts) as int)", "with_text": f"cast({_FILLED} as int)", "score": SCORE_SQL["images"]}),
    ("tec_09_status", TE.status_audit, {"score": SCORE_SQL["status"]}),
    ("tec_12_readability", TE.readability_audit, {
        "avg_sentence_len": f"case when {WC} >= 30 and len(ss) > 0 then round(list_sum(list_transform(ss, lambda s: len(list_filter(regexp_split_to_array(s, '{WS}'), lambda w: w <> '')))) / cast(len(ss) as double), 1) end"}),
    ("tec_14_rich_results", TE.rich_result_audit, {"status": f"case when len(schema_types) = 0 then 'missing' when len(list_filter(schema_types, lambda t: lower(t) in {_sql_list(L.RICH_TYPES)})) > 0 then 'ok' else 'non_eligible' end"}),
]:
    _src = "fx_pages"
    if _name == "tec_12_readability":
        _src = "(select *, list_filter(list_transform(regexp_split_to_array(body_text, '[.!?]'), lambda s: regexp_replace(s, '^{WS}|{WS}$', '', 'g')), lambda s: length(s) > 10) as ss from fx_pages)".replace("{WS}", WS)
    query(_name, P, "select url, " + ", ".join(f"{v} as {c}" for c, v in _cols.items()) + f" from {_src} t")(_sub(_audit, *_cols))


@query("tec_10_tech_score", P, f"select url, s as tech_score, {LETTER.format('s')} as tech_grade from (select url, {TECH_SCORE} as s from fx_pages) t")
def _(spark, sf):
    return TE.audit_pages(fx_pages(spark, sf), parts=[]).select("url", "tech_score", "tech_grade")


@query("tec_11_indexability", P, f"select url, {INDEX_SQL} as status from fx_pages")
def _(spark, sf):
    return fx_pages(spark, sf).select("url", TE.indexability().alias("status"))


@query("tec_13_freshness", P, f"""select url, cast(floor((epoch(timestamp '{NOW}') - epoch(ts)) / 86400) as int) as age_days, case when last_modified = '' then 'unknown' when ts is null then 'parse_error'
 when floor((epoch(timestamp '{NOW}') - epoch(ts)) / 86400) < 30 then 'fresh' when floor((epoch(timestamp '{NOW}') - epoch(ts)) / 86400) < 180 then 'recent'
 when floor((epoch(timestamp '{NOW}') - epoch(ts)) / 86400) < 365 then 'ageing' else 'stale' end as status
 from (select url, last_modified, try_strptime(regexp_extract(last_modified, ', (.*) GMT', 1), '%d %b %Y %H:%M:%S') as ts from fx_pages) t""")
def _(spark, sf):
    rows = fx_pages(spark, sf).select("url", TE.freshness_audit(F.lit(NOW).cast("timestamp")).alias("a"))
    return rows.select("url", "a.age_days", "a.status")


@query("tec_15_schema_props", P, """WITH o AS (select url, unnest(schema_objects) as o from fx_pages), r AS (select * from (values ('Article', 'headline'), ('Article', 'author'),
 ('Article', 'datePublished'), ('Product', 'name'), ('Product', 'offers'), ('FAQPage', 'mainEntity')) v(type, prop))
 select url, concat(r.type, '.', r.prop) as missing from o join r on o.type = r.type where not list_contains(o.props, r.prop)""")
def _(spark, sf):
    rows = fx_pages(spark, sf).select("url", TE.schema_props_audit().alias("a"))
    return rows.select("url", F.explode("a.issues").alias("missing"))


@query("tec_16_images_and_breadcrumbs", P, """select url, cast(m as int) as next_gen, cast(g as int) as legacy, case when len(img_srcs) = 0 then 'no_images' when g > 0 and m = 0 then 'legacy_only' when g > m then 'mostly_legacy' else 'ok' end as format_status,
 case when img_total = 0 then 'no_images' when img_total > 2 and img_lazy_pct < 50 and img_srcset_pct < 30 then 'needs_work' when img_total > 2 and (img_lazy_pct < 50 or img_srcset_pct < 30) then 'partial' else 'ok' end as loading_status,
 case when not breadcrumb_detected then 'missing' when breadcrumb_source = 'json_ld' then 'ok' else 'partial' end as breadcrumb_status from
 (select *, len(list_filter(img_srcs, lambda s: regexp_matches(lower(split_part(s, '?', 1)), '\\.(webp|avif)$'))) as m,
  len(list_filter(img_srcs, lambda s: regexp_matches(lower(split_part(s, '?', 1)), '\\.(jpg|jpeg|png|gif|bmp|tif|tiff)$'))) as g from fx_pages) t""")
def _(spark, sf):
    rows = fx_pages(spark, sf).select("url", TE.image_format_audit().alias("f"), TE.image_loading_audit().alias("l"), TE.breadcrumb_audit().alias("b"))
    return rows.select("url", "f.next_gen", "f.legacy", F.col("f.status").alias("format_status"), F.col("l.status").alias("loading_status"), F.col("b.status").alias("breadcrumb_status"))


_SKIPS = "coalesce(list_sum(list_transform(range(1, len(heading_sequence)), lambda i: greatest(0, heading_sequence[i + 1].level - heading_sequence[i].level - 1))), 0)"
TECH_ISSUES = "(" + " + ".join([
    f"case when {_len_status(_TT, 30, 60, 580)} = 'ok' then 0 else 1 end", f"case when {_len_status(_MM, 120, 160, 920)} = 'ok' then 0 else 1 end",
    f"case when {_CC} <> '' and rtrim({_CC}, '/') = rtrim(url, '/') then 0 else 1 end",
    "case when len(h1) = 1 then 0 else 1 end", "case when len(h2) = 0 then 1 else 0 end", "case when len(h3) > 0 and len(h2) = 0 then 1 else 0 end",
    "case when og_title = '' then 1 else 0 end", "case when og_description = '' then 1 else 0 end", "case when og_image = '' then 1 else 0 end",
    f"case when {WC} < 300 then 1 else 0 end", f"case when {WC} > 0 and round(100.0 * internal_links_count / {WC}, 1) > 10 and internal_links_count > 5 then 1 else 0 end",
    _URL_ISSUES, f"case when {_FILLED} < len(img_alts) then 1 else 0 end", f"case when len(img_alts) > 0 and {_FILLED} = 0 then 1 else 0 end",
    "case when len(list_filter(img_srcs, lambda s: regexp_matches(lower(split_part(s, '?', 1)), '\\.(jpg|jpeg|png|gif|bmp|tif|tiff)$'))) > len(list_filter(img_srcs, lambda s: regexp_matches(lower(split_part(s, '?', 1)), '\\.(webp|avif)$'))) then 1 else 0 end",
    "case when is_error or status_code // 100 = 3 then 1 else 0 end",
    "case when viewport = '' then 1 else (case when contains(viewport, 'width=device-width') then 0 else 1 end) + (case when contains(viewport, 'user-scalable=no') then 1 else 0 end) end",
    _SKIPS,
    "coalesce(list_sum(list_transform(schema_objects, lambda o: case when o.type = 'Article' then len(list_filter(['headline', 'author', 'datePublished'], lambda x: not list_contains(o.props, x))) when o.type = 'Product' then len(list_filter(['name', 'offers'], lambda x: not list_contains(o.props, x))) when o.type = 'FAQPage' then len(list_filter(['mainEntity'], lambda x: not list_contains(o.props, x))) else 0 end)), 0)",
]) + ")"


@query("tec_17_page_audit", P, f"select url, {INDEX_SQL} as indexability, {TECH_SCORE} as tech_score, cast({TECH_ISSUES} as int) as issue_count from fx_pages")
def _(spark, sf):
    audited = TE.audit_pages(fx_pages(spark, sf), parts=[])
    return audited.select("url", "indexability", "tech_score", F.size("all_issues").alias("issue_count"))


@query("tec_18_inbound_links", P, """WITH l AS (select url as src, unnest(links) as dst from fx_pages where not is_error),
 r AS (select *, row_number() over (partition by dst order by src) as rn from l)
 select p.url, cast(coalesce(c.n, 0) as bigint) as inbound_count, coalesce(s.refs, '') as inbound_urls, coalesce(c.n, 0) = 0 and not p.is_error as orphan
 from fx_pages p left join (select dst, count(*) as n from l group by dst) c on c.dst = p.url
 left join (select dst, string_agg(src, ' ' order by src) as refs from r where rn <= 10 group by dst) s on s.dst = p.url""")
def _(spark, sf):
    pages = fx_pages(spark, sf)
    links = pages.select(F.col("url").alias("src"), F.explode("links").alias("dst"))
    out = TE.with_inbound_links(pages.select("url", "is_error"), links)
    return out.select("url", "inbound_count", F.array_join("inbound_urls", " ").alias("inbound_urls"), "orphan")


RANKING_CTE = f"""lab AS (select url, list(issue) as ls from ({DUP_SQL}) t group by url), rk AS (select p.*, coalesce(lab.ls, []) as ls from fx_pages p left join lab using (url)),
 ranked AS (select url, is_error, title, ls, cast(case when is_error or status_code <> 200 then 0 else
 (case when trim(title) = '' then 0 when list_contains(ls, 'Title Too Long') then 12 else 20 end)
 + (case when trim(meta_description) = '' then 0 when list_contains(ls, 'Duplicate Meta Description') then 8 else 15 end)
 + (case when len(h1) = 0 then 0 when list_contains(ls, 'Multiple H1 Tags') then 12 else 20 end)
 + (case when len(h2) > 0 then 10 else 0 end)
 + (case when canonical = '' or list_contains(ls, 'Canonical Mismatch') then 0 else 10 end) + 15
 + (case when len(keywords) > 0 and trim(title) <> '' then least(10, 2 * len(list_filter(keywords[1:5], lambda k: contains(lower(trim(title)), lower(k)) or contains(lower(array_to_string(h1, ' ')), lower(k))))) else 0 end) end as int) as score from rk)"""


@query("tec_19_ranking_score", P, f"WITH {RANKING_CTE} select url, score, {LETTER.format('score')} as grade from ranked")
def _(spark, sf):
    pages = PI.detect_issues(fx_pages(spark, sf)).withColumn("score", TE.ranking_score())
    return pages.select("url", "score", S.letter_grade(F.col("score")).alias("grade"))


@query("tec_20_form_score", P, """WITH f AS (select url, trim(title) as t, trim(meta_description) as m, trim(coalesce(h1[1], '')) as h, lower(trim(coalesce(keywords[1], ''))) as k from fx_pages),
 c AS (select *, list_filter([case when length(t) = 0 then 0 when length(t) < 30 then 30 when length(t) > 65 then 55 else 100 end,
  case when k <> '' and t <> '' then case when contains(lower(t), k) then 100 else 20 end end,
  case when length(m) = 0 then 0 when length(m) < 70 then 30 when length(m) > 165 then 60 else 100 end,
  case when h = '' then 0 when k <> '' and contains(lower(h), k) then 100 else 70 end,
  case when t <> '' and h <> '' then case when lower(t) = lower(h) then 40 else 100 end end,
  case when k <> '' and m <> '' then case when contains(lower(m), k) then 100 else 50 end end], lambda x: x is not null) as cs from f),
 s AS (select url, case when t <> '' or m <> '' or h <> '' then cast(round(list_sum(cs) / cast(len(cs) as double), 0) as int) end as score from c)
 select url, score, case when score >= 90 then 'A' when score >= 75 then 'B' when score >= 55 then 'C' when score >= 35 then 'D' else 'F' end as grade from s""")
def _(spark, sf):
    rows = fx_pages(spark, sf).select(
        "url", "title", F.col("meta_description").alias("meta"), F.coalesce(F.get("h1", F.lit(0)), F.lit("")).alias("h1"),
        F.coalesce(F.get("keywords", F.lit(0)), F.lit("")).alias("keyword"))
    return TE.form_scores(rows).select("url", "score", "grade")


_Q = "'(?i)^(how|why|what|when|where|who|which|is|are|can)\\b'"
_ANS = "len(list_filter(list_filter(list_transform(regexp_split_to_array(body_text, '[.!?]'), lambda s: trim(s)), lambda s: s <> '')[1:30], lambda s: len(list_filter(regexp_split_to_array(s, '{WS}'), lambda w: w <> '')) between 20 and 80))".replace('{WS}', WS)


@query("tec_21_snippet_potential", P, f"""select url, score, case when score >= 60 then 'High' when score >= 35 then 'Medium' else 'Low' end as potential from (select url, cast(least(100,
 (case when {WC} >= 800 then 15 when {WC} >= 300 then 8 else 0 end) + (case when q >= 2 then 20 when q = 1 then 10 else 0 end)
 + (case when regexp_matches(body_text, '(?im)\\b(is|are|refers to|means|defined as|definition)\\b') then 8 else 0 end)
 + (case when regexp_matches(body_text, '(?im)^[-•*]\\s+\\w') then 10 else 0 end) + (case when regexp_matches(body_text, '(?im)^\\d+\\.\\s+\\w') then 10 else 0 end)
 + (case when regexp_matches(body_text, '(?im)\\bstep\\s+\\d+\\b') then 12 else 0 end) + (case when regexp_matches(body_text, '(?im)\\|.+\\|') then 8 else 0 end)
 + (case when regexp_matches(body_text, '(?im)[.!?]\\s+[A-Z]') then 5 else 0 end) + (case when {_ANS} >= 3 then 10 else 0 end)
 + (case when regexp_matches(title, {_Q}) then 8 else 0 end)) as int) as score from (select *, len(list_filter(list_concat(h2, h3), lambda h: regexp_matches(h, {_Q}))) as q from fx_pages) t) u""")
def _(spark, sf):
    rows = TE.with_word_count(fx_pages(spark, sf)).select("url", TE.snippet_potential().alias("s"))
    return rows.select("url", "s.score", "s.potential")


NOINDEX = "(robots_noindex or x_robots_noindex or contains(lower(robots_meta), 'noindex'))"
ALL_HEADERS = "(" + " and ".join(f"map_contains(response_headers, '{h}')" for h in L.SECURITY_HEADERS) + ")"
PAGE_SCORE = f"""least(100 - (case when title = '' then 20 else 0 end) - (case when viewport = '' then 15 else 0 end) - (case when url like 'https://%' then 0 else 15 end)
 - (case when len(h1) = 0 then 12 else 0 end) - (case when meta_description = '' then 10 else 0 end) - (case when canonical = '' then 8 else 0 end)
 - (case when {ALL_HEADERS} then 0 else 10 end) - (case when {NOINDEX} then 7 else 0 end), case when status_code // 100 = 4 then 30 when status_code // 100 = 5 then 20 else 100 end)"""


@query("tec_22_signal_score", P, f"select url, cast(s as int) as page_score, {SITE.format('s')} as grade, cast(100 - s as int) as lost from (select url, {PAGE_SCORE} as s from fx_pages) t")
def _(spark, sf):
    out = TE.with_signal_score(fx_pages(spark, sf))
    return out.select("url", "page_score", "grade", F.aggregate("deductions", F.lit(0), lambda a, d: a + d["points"]).alias("lost"))


# --- functions --------------------------------------------------------------------------------------------------------

@query("fn_01_url_normalisers", P, f"""select url, rtrim(url, '/') as stripped, lower(rtrim(url, '/')) as match_key,
 concat(lower(regexp_extract(url, '^([A-Za-z]+):', 1)), '://', lower(site), case when rtrim({PATH}, '/') = '' then '/' else rtrim({PATH}, '/') end) as node_key,
 concat(lower(regexp_extract(url, '^([A-Za-z]+):', 1)), '://', lower(site)) as root,
 regexp_replace(regexp_replace(lower(site), ':\\d+$', ''), '^www\\.', '') as bare_host from fx_pages""")
def _(spark, sf):
    u = F.col("url")
    return fx_pages(spark, sf).select("url", U.strip_slash(u).alias("stripped"), U.match_key(u).alias("match_key"), U.node_key(u).alias("node_key"), U.root(u).alias("root"), U.bare_host(u).alias("bare_host"))


@query("fn_02_url_facets", P, f"""select url, coalesce(nullif(list_filter(string_split({PATH}, '/'), lambda s: s <> '')[1], ''), '(root)') as silo, cast({DEPTH} as int) as depth,
 cast(len(list_distinct(list_transform(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '^[^=]*=.+')), lambda p: split_part(p, '=', 1)))) as int) as params, contains({PATH}, '//') as double_slash from fx_pages""")
def _(spark, sf):
    u = F.col("url")
    return fx_pages(spark, sf).select("url", U.silo(u).alias("silo"), U.depth(u).alias("depth"), U.param_count(u).alias("params"), F.contains(U.path(u), F.lit("//")).alias("double_slash"))


@query("fn_03_pixel_width", P, f"select url, {px('title')} as title_px, {px('meta_description')} as meta_px from fx_pages")
def _(spark, sf):
    def width(c):
        return F.floor(TX.pixel_width(F.col(c)) + 0.5).cast("int")
    return fx_pages(spark, sf).select("url", width("title").alias("title_px"), width("meta_description").alias("meta_px"))


_KW1 = "keywords[1]"


@query("fn_06_keyword_density", P, f"""select url, kw, cast((length(low) - length(replace(low, kw, ''))) / length(kw) as int) as occurrences, round(cast(100 as double) * len(list_filter(ws, lambda w: contains(w, kw))) / len(ws), 2) as containing,
 round(cast(100 as double) * len(list_filter(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+'), lambda w: w = kw)) / greatest(len(regexp_extract_all(low, '[a-z]{{3,}}')), 1), 2) as whole_word
 from (select url, lower({_KW1}) as kw, lower(trim(body_text)) as low, list_filter(regexp_split_to_array(lower(body_text), '{WS}'), lambda w: w <> '') as ws from fx_pages where len(keywords) > 0 and {_KW1} <> '') t""")
def _(spark, sf):
    rows = fx_pages(spark, sf).withColumn("kw", F.lower(F.get("keywords", F.lit(0)))).where("kw <> ''")
    body, kw = F.col("body_text"), F.col("kw")
    return rows.select("url", "kw", TX.count_of(F.lower(F.trim(body)), kw).alias("occurrences"), TX.density_containing(kw, body).alias("containing"), TX.density_whole_word(kw, body).alias("whole_word"))


@query("fn_07_whole_word", P, """select url, kw, regexp_matches(lower(title), concat('(^|[^\\p{L}\\p{N}_])', kw, '($|[^\\p{L}\\p{N}_])')) as in_title, regexp_matches(lower(body_text), concat('(^|[^\\p{L}\\p{N}_])', kw, '($|[^\\p{L}\\p{N}_])')) as in_body
 from (select url, title, body_text, lower(unnest(keywords)) as kw from fx_pages) t where kw <> ''""")
def _(spark, sf):
    rows = fx_pages(spark, sf).select("url", "title", "body_text", F.explode("keywords").alias("kw")).withColumn("kw", F.lower("kw")).where("kw <> ''")
    return rows.select("url", "kw", TX.in_text(F.col("kw"), F.lower("title")).alias("in_title"), TX.in_text(F.col("kw"), F.lower("body_text")).alias("in_body"))


@query("fn_08_word_count", ("fx_docs",), "select doc_id, cast(len(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')) as int) as words from fx_docs".replace('{WS}', WS))
def _(spark, sf):
    return fx_docs(spark, sf).select("doc_id", TX.word_count(F.col("text")).alias("words"))


def intent_sql(kw: str) -> str:
    def test(vocabulary, phrases):
        words = "len(list_filter(regexp_split_to_array(" + kw + f", '\\s+'), lambda w: w in {_sql_list(vocabulary)})) > 0"
        return "(" + " or ".join([words] + [f"contains({kw}, '{p}')" for p in phrases]) + ")"
    return (f"case when {test(L.TRANSACTIONAL_WORDS, L.TRANSACTIONAL_PHRASES)} then 'transactional' when {test(L.NAVIGATIONAL_WORDS, L.NAVIGATIONAL_PHRASES)} then 'navigational'"
            f" when {test(L.COMMERCIAL_WORDS, L.COMMERCIAL_PHRASES)} then 'commercial' else 'informational' end")


@query("fn_09_search_intent", P, f"select url, kw, {intent_sql('kw')} as intent from (select url, lower(trim(unnest(list_concat(keywords, h2)))) as kw from fx_pages) t")
def _(spark, sf):
    rows = fx_pages(spark, sf).select("url", F.explode(F.concat("keywords", "h2")).alias("kw")).withColumn("kw", F.lower(F.trim("kw")))
    return rows.select("url", "kw", TX.search_intent(F.col("kw")).alias("intent"))


def competition_sql(ks: str) -> str:
    high = " or ".join(f"contains(lower(array_to_string({ks}, ' ')), '{p}')" for p in L.HIGH_COMPETITION)
    low = " or ".join(f"regexp_matches(lower(array_to_string({ks}, ' ')), '{p}')" for p in L.LOW_COMPETITION)
    mean = f"list_sum(list_transform({ks}, lambda k: len(list_filter(regexp_split_to_array(trim(k), '\\s+'), lambda w: w <> '')))) / cast(len({ks}) as double)"
    return f"case when len({ks}) = 0 then 'Medium' when {high} then 'High' when {low} then 'Low' when {mean} >= 3 then 'Low' else 'Medium' end"


@query("fn_10_competition", P, f"select url, {competition_sql('ks')} as competition from (select url, list_concat(h2, keywords) as ks from fx_pages) t")
def _(spark, sf):
    return fx_pages(spark, sf).select("url", TX.competition(F.concat("h2", "keywords")).alias("competition"))


@query("fn_11_grades", P, f"select url, {LETTER.format('s')} as letter, {SITE.format('s')} as site_grade from (select url, {TECH_SCORE} as s from fx_pages) t")
def _(spark, sf):
    score = F.col("tech_score")
    return TE.audit_pages(fx_pages(spark, sf), parts=[]).select("url", S.letter_grade(score).alias("letter"), S.site_grade(score).alias("site_grade"))
