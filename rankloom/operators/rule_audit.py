"""The rule catalogue: every rule is a named condition; all row-wise rules are evaluated in one pass over the pages."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rankloom import lookups as L
from rankloom.functions import text as TX, urls as U
from rankloom.functions.scores import site_grade
from rankloom.operators import cross_page as CP, page_issues as PI
from rankloom.operators.skew import salted_join, with_group_size

ISSUE_COLUMNS = ["url", "type", "cluster", "severity", "explanation", "fix"]


@dataclass(frozen=True)
class Rule:
    type: str
    cluster: str
    severity: str | Column
    condition: Column

    def issue(self, scope: str) -> Column:
        severity = F.lit(self.severity) if isinstance(self.severity, str) else self.severity
        return F.when(self.condition, F.struct(F.lit(scope).alias("scope"), F.lit(self.type).alias("type"), F.lit(self.cluster).alias("cluster"), severity.alias("severity")))


# What to do about the issues of each cluster; a rule's own name says what was found.
FIXES = {
    "indexability": "Let the page answer with status 200, without blocking directives and with itself as canonical",
    "on_page": "Rewrite the named field so that it is present, unique and of the advised length",
    "technical": "Correct the named tag or address so that crawlers can follow it",
    "performance": "Reduce the named cost: fewer requests, smaller responses, faster answers, better caching",
    "security": "Serve over https with the named header and a current protocol version",
}


def has(column: str | Column, text: str) -> Column:
    return F.contains(column if isinstance(column, Column) else F.col(column), F.lit(text))


def indexability_rules() -> list[Rule]:
    meta, header, status = F.lower("robots_meta"), F.lower("x_robots_tag"), F.col("status_code")
    canonical, url = U.strip_slash(F.col("canonical")), U.strip_slash(F.col("url"))
    title, n = F.lower("title"), F.col("_words")
    error_title = F.rlike(title, F.lit("not found|404|error|doesn't exist"))
    soft = (status == 200) & (n < 50) & error_title
    noindex = has(meta, "noindex") | has(header, "noindex") | F.col("robots_noindex")
    c = "indexability"
    return [
        Rule("robots_blocked", c, "CRITICAL", F.col("_blocked")),
        Rule("meta_noindex", c, "CRITICAL", has(meta, "noindex")),
        Rule("meta_nofollow", c, "HIGH", has(meta, "nofollow")),
        Rule("meta_robots_none", c, "CRITICAL", has(meta, "none")),
        Rule("noindex_with_foreign_canonical", c, "CRITICAL", has(meta, "noindex") & (canonical != "") & (canonical != url)),
        Rule("x_robots_noindex", c, "CRITICAL", has(header, "noindex")),
        Rule("x_robots_nofollow", c, "HIGH", has(header, "nofollow")),
        Rule("x_robots_none", c, "CRITICAL", has(header, "none")),
        Rule("redirect_status", c, "HIGH", status.isin(301, 302, 303, 307, 308)),
        Rule("soft_404", c, "HIGH", soft),
        Rule("empty_200_page", c, "HIGH", (status == 200) & ~soft & (n < 20) & (F.size("h1") == 0) & (title == "")),
        Rule("redirect_single_hop", c, "MEDIUM", F.col("redirect_hops") == 1),
        Rule("redirect_chain", c, "HIGH", F.col("redirect_hops") >= 2),
        Rule("sitemap_noindex_conflict", c, "CRITICAL", F.col("_listed") & noindex),
        Rule("orphan_page", c, "HIGH", F.col("_listed") & ~F.col("_linked")),
    ]


def error_rules() -> list[Rule]:
    """Rules for pages that answered with an error; all others are for loaded pages."""
    status, c = F.col("status_code"), "indexability"
    return [
        Rule("page_not_found", c, "CRITICAL", status == 404),
        Rule("page_gone", c, "HIGH", status == 410),
        Rule("server_error", c, "CRITICAL", status >= 500),
        Rule("sitemap_error_page", c, "CRITICAL", F.col("_listed")),
    ]


def main_keyword() -> Column:
    return F.lower(F.coalesce(F.get("keywords", F.lit(0)), F.lit("")))


def on_page_rules() -> list[Rule]:
    title, meta = F.trim("title"), F.trim("meta_description")
    kw = main_keyword()
    n_title, n_meta, n1, n2 = F.length(title), F.length(meta), F.size("h1"), F.size("h2")
    path = F.lower(U.path(F.col("url")))
    slug, joined = F.replace(F.replace(kw, F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-")), F.replace(kw, F.lit(" "), F.lit(""))
    n = F.col("_words")
    anchors = F.transform("link_objects", lambda o: F.lower(F.trim(F.coalesce(o["text"], F.lit("")))))
    generic = F.size(F.filter(anchors, lambda a: a.isin(L.GENERIC_ANCHORS_AUDIT)))
    total, alt = F.col("img_total"), F.col("img_missing_alt")
    alt_pct = F.round(100.0 * alt / F.greatest(total, F.lit(1)), 0)
    og_missing = sum((F.when(F.col(x) == "", 1).otherwise(0) for x in ("og_title", "og_description", "og_image")), F.lit(0))
    unknown = F.array_except("schema_types", F.array(*map(F.lit, L.KNOWN_SCHEMA_TYPES)))
    c = "on_page"
    return [
        Rule("missing_title", c, "CRITICAL", n_title == 0),
        Rule("title_too_short", c, "MEDIUM", n_title.between(1, 29)),
        Rule("title_too_long", c, "MEDIUM", n_title > 60),
        Rule("duplicate_title", c, "HIGH", F.col("_same_title").isNotNull()),
        Rule("keyword_absent_from_title", c, "HIGH", (n_title > 0) & (kw != "") & ~F.contains(F.lower(title), kw)),
        Rule("title_keyword_stuffing", c, "HIGH", (n_title > 0) & (kw != "") & (TX.count_of(F.lower(title), F.when(kw != "", kw)) > 2)),
        Rule("missing_meta_description", c, "HIGH", n_meta == 0),
        Rule("meta_description_too_short", c, "MEDIUM", n_meta.between(1, 119)),
        Rule("meta_description_too_long", c, "MEDIUM", n_meta > 160),
        Rule("duplicate_meta_description", c, "HIGH", F.col("_same_meta").isNotNull()),
        Rule("missing_h1", c, "HIGH", n1 == 0),
        Rule("multiple_h1", c, "MEDIUM", n1 > 1),
        Rule("keyword_absent_from_h1", c, "HIGH", (n1 == 1) & (kw != "") & ~F.contains(F.lower(F.get("h1", F.lit(0))), kw)),
        Rule("missing_h2", c, "LOW", n2 == 0),
        Rule("broken_heading_hierarchy", c, "MEDIUM", (F.size("h3") > 0) & (n2 == 0)),
        Rule("keyword_absent_from_url", c, "MEDIUM", (kw != "") & ~F.contains(path, slug) & ~F.contains(path, joined)),
        Rule("keyword_stuffing_body", c, "HIGH", F.col("_stuffed")),
        Rule("no_content", c, "CRITICAL", n == 0),
        Rule("thin_content", c, F.when(n < 100, "HIGH").otherwise("MEDIUM"), n.between(1, 299)),
        Rule("generic_anchor_text", c, "MEDIUM", generic > 3),
        Rule("low_anchor_quality_score", c, "MEDIUM", F.col("anchor_quality_score") < 40),
        Rule("images_missing_alt", c, F.when(alt_pct > 50, "CRITICAL").when(alt_pct > 20, "HIGH").otherwise("MEDIUM"), (total > 0) & (alt > 0)),
        Rule("alt_text_keyword_stuffing", c, "MEDIUM", (total > 0) & F.exists("img_alts", lambda a: TX.word_count(a) > 15)),
        Rule("images_missing_dimensions", c, "MEDIUM", (total > 0) & (F.col("img_missing_dims") > 0)),
        Rule("legacy_image_formats", c, "MEDIUM", (total > 0) & (F.col("img_non_modern_count") > 0)),
        Rule("missing_og_tags", c, F.when(og_missing == 3, "HIGH").otherwise("MEDIUM"), og_missing > 0),
        Rule("missing_twitter_card", c, "LOW", F.col("twitter_card") == ""),
        Rule("no_structured_data", c, "MEDIUM", F.size("schema_types") == 0),
        Rule("invalid_schema_type", c, "MEDIUM", F.size(unknown) > 0),
    ]


def technical_rules() -> list[Rule]:
    url, depth, path = F.col("url"), U.depth(F.col("url")), U.path(F.col("url"))
    langs = F.transform("hreflang_tags", lambda t: t["lang"])
    view, nxt = F.lower(F.trim("viewport")), U.match_key(F.col("pagination_next"))
    c = "technical"
    return [
        Rule("deep_crawl_depth", c, F.when(depth > 5, "HIGH").otherwise("MEDIUM"), depth > 3),
        Rule("hreflang_missing_x_default", c, "MEDIUM", (F.size(langs) > 0) & ~F.array_contains(langs, "x-default")),
        Rule("hreflang_invalid_lang_code", c, "HIGH", F.exists(langs, lambda x: (x != "x-default") & ~F.rlike(x, F.lit(L.LANG_CODE_AUDIT)))),
        Rule("pagination_next_prev_same", c, "HIGH", (nxt != "") & (nxt == U.match_key(F.col("pagination_prev")))),
        Rule("missing_viewport", c, "CRITICAL", view == ""),
        Rule("viewport_missing_device_width", c, "HIGH", (view != "") & ~has(view, "width=device-width")),
        Rule("viewport_disables_zoom", c, "HIGH", has(view, "user-scalable=no") | has(view, "maximum-scale=1")),
        Rule("url_excessive_parameters", c, "MEDIUM", U.param_count(url) > 3),
        Rule("url_mixed_case", c, "LOW", F.rlike(path, F.lit("[A-Z]"))),
        Rule("url_double_slash", c, "LOW", has(path, "//")),
        Rule("url_underscores", c, "LOW", has(path, "_")),
    ]


def performance_rules() -> list[Rule]:
    size, n, rt = F.col("html_size_kb"), F.col("resource_count"), F.coalesce("response_time_ms", F.lit(0))
    lcp, cls, inp = F.col("_lcp_s"), F.col("_cls"), F.col("_inp_s")
    measured = F.col("_measured")
    control, kind = F.lower(PI.header("cache-control")), F.lower(PI.header("content-type"))
    squeezable = reduce(lambda a, b: a | b, [has(kind, t) for t in L.COMPRESSIBLE_TYPES])
    age = F.regexp_extract(control, r"max-age\s*=\s*(\d+)", 1).try_cast("bigint")
    c = "performance"
    return [
        Rule("cwv_lcp_poor", c, "CRITICAL", lcp > 4.0),
        Rule("cwv_lcp_needs_improvement", c, "HIGH", (lcp > 2.5) & (lcp <= 4.0)),
        Rule("cwv_cls_poor", c, "CRITICAL", cls > 0.25),
        Rule("cwv_cls_needs_improvement", c, "HIGH", (cls > 0.1) & (cls <= 0.25)),
        Rule("cwv_inp_poor", c, "CRITICAL", inp > 0.5),
        Rule("cwv_inp_needs_improvement", c, "HIGH", (inp > 0.2) & (inp <= 0.5)),
        Rule("slow_ttfb_proxy_lcp", c, "HIGH", ~measured & (rt > 2500)),
        Rule("elevated_ttfb", c, "MEDIUM", ~measured & (rt > 800) & (rt <= 2500)),
        Rule("oversized_html", c, "HIGH", size > 2048),
        Rule("large_html", c, "MEDIUM", (size > 500) & (size <= 2048)),
        Rule("excessive_resource_requests", c, "HIGH", n > 100),
        Rule("high_resource_requests", c, "MEDIUM", (n > 60) & (n <= 100)),
        Rule("compression_missing", c, "HIGH", squeezable & (PI.header("content-encoding") == "")),
        Rule("missing_cache_control", c, "HIGH", control == ""),
        Rule("low_cache_ttl", c, "MEDIUM", age < L.MIN_CACHE_TTL),
        Rule("missing_etag", c, "LOW", (control != "") & (PI.header("etag") == "") & ~has(control, "no-store")),
        Rule("render_blocking_risk", c, "HIGH", (n > 80) & (rt > 1500)),
    ]


def security_rules() -> list[Rule]:
    severity = {"strict-transport-security": "CRITICAL", "permissions-policy": "MEDIUM"}
    hsts, csp = PI.header("strict-transport-security"), F.lower(PI.header("content-security-policy"))
    age = F.regexp_extract(hsts, r"(?i)max-age\s*=\s*(\d+)", 1).try_cast("bigint")
    c = "security"
    return [
        Rule("http_page", c, "CRITICAL", F.startswith("url", F.lit("http://"))),
        *[Rule(f"missing_{h}", c, severity.get(h, "HIGH"), ~PI.has_header(h)) for h in L.SECURITY_HEADERS],
        Rule("hsts_weak_max_age", c, "HIGH", age < L.ONE_YEAR),
        Rule("hsts_missing_include_subdomains", c, "MEDIUM", (hsts != "") & ~has(F.lower(hsts), "includesubdomains")),
        Rule("csp_unsafe_inline", c, "HIGH", has(csp, "unsafe-inline")),
        Rule("csp_unsafe_eval", c, "HIGH", has(csp, "unsafe-eval")),
        Rule("legacy_tls", c, "CRITICAL", F.trim("tls_version").isin(L.WEAK_TLS)),
        Rule("mixed_content", c, "HIGH", F.startswith("url", F.lit("https://")) & (F.size("mixed_resources") > 0)),
    ]


def page_rules() -> list[Rule]:
    return indexability_rules() + on_page_rules() + technical_rules() + performance_rules() + security_rules()


def site_rules() -> list[Rule]:
    """Row-wise rules that are counted for the site and not for the page score."""
    rt, csp = F.coalesce("response_time_ms", F.lit(0)), F.lower(PI.header("content-security-policy"))
    heavy = (F.col("html_size_kb") > 500) & (F.col("resource_count") > 60) & (rt > 1000)
    return [
        Rule("sitemap_robots_conflict", "indexability", "CRITICAL", F.col("_listed") & F.col("_blocked")),
        Rule("compounding_performance_failure", "performance", "CRITICAL", heavy),
        Rule("csp_blocking_assets", "security", "HIGH", has(csp, "default-src 'none'") & (rt > 2000)),
    ]


def with_context(pages: DataFrame, sitemap: DataFrame, robots: DataFrame, vitals: DataFrame) -> DataFrame:
    """Pages with what the rules need from elsewhere: listed in the sitemap, linked, blocked, duplicates, page speed.

    Every lookup is reduced to one row per URL before it is joined.
    """
    key = U.match_key(F.col("url"))
    stuffed = F.coalesce(TX.density_containing(main_keyword(), F.col("body_text")) > 4, F.lit(False))
    base = PI.with_anchor_quality(pages).withColumns(
        {"_key": key, "_words": TX.word_count(F.col("body_text")), "_stuffed": stuffed, "_t": F.lower(F.trim("title")), "_m": F.lower(F.trim("meta_description"))}).drop("body_text")  # the text does not go through the joins
    listed = sitemap.select(U.match_key(F.col("url")).alias("_key")).distinct().withColumn("_listed", F.lit(True))
    linked = CP.link_rows(pages).select(U.match_key(F.col("dst")).alias("_key")).distinct().withColumn("_linked", F.lit(True))
    blocked = CP.robots_blocked(pages, robots).select(U.match_key(F.col("url")).alias("_key")).distinct().withColumn("_blocked", F.lit(True))
    speed = vitals.groupBy(U.match_key(F.col("url")).alias("_key")).agg(
        F.max("lcp_s").alias("_lcp_s"), F.max("cls").alias("_cls"), F.max("inp_s").alias("_inp_s")).withColumn("_measured", F.coalesce("_lcp_s", "_cls", "_inp_s").isNotNull())
    flags = listed.join(linked, "_key", "full_outer").join(blocked, "_key", "full_outer").join(speed, "_key", "full_outer")
    out = base.join(flags, "_key", "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_listed", "_linked", "_blocked", "_measured")})
    keys = pages.select("site", F.lower(F.trim("title")).alias("_t"), F.lower(F.trim("meta_description")).alias("_m"))
    out = with_group_size(out, "_t", F.col("url"), source=keys, by=["site"]).withColumnRenamed("n_rows", "_same_title")
    return with_group_size(out, "_m", F.col("url"), source=keys, by=["site"]).withColumnRenamed("n_rows", "_same_meta")


def _fired(rows: DataFrame, rules: dict[str, list[Rule]]) -> DataFrame:
    """One row per rule that applies, with the scope it is counted for; all rules in one pass."""
    issues = F.array(*[r.issue(scope) for scope, group in rules.items() for r in group])
    return rows.select("url", F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("i")).select("url", "i.*")


def _labelled(rows: DataFrame, kind: str, cluster: str, severity: str | Column) -> DataFrame:
    sev = F.lit(severity) if isinstance(severity, str) else severity
    return rows.select("url", F.lit(kind).alias("type"), F.lit(cluster).alias("cluster"), sev.alias("severity"))


def joined_page_issues(pages: DataFrame, crawled: DataFrame) -> DataFrame:
    """Issues of the loaded ``pages`` that come from comparing pages; canonical and link targets are looked up in all ``crawled`` pages."""
    lower = pages.withColumns({"_u": U.match_key(F.col("url")), "canonical": U.match_key(F.col("canonical"))})
    own = lower.select("url", F.col("_u").alias("start"))
    walks = CP.canonical_walks(lower.drop("url").withColumnRenamed("_u", "url")).where("state = 'loop' or hops > 1")
    chained = own.join(walks, "start")
    loop = F.col("state") == "loop"
    canon = chained.select("url", F.when(loop, "canonical_loop").otherwise("canonical_chain").alias("type"), F.lit("technical").alias("cluster"),
                           F.when(loop, "CRITICAL").otherwise("HIGH").alias("severity"))
    bad = CP.canonical_bad_target(pages, crawled).select("url", "type", F.lit("indexability").alias("cluster"), F.lit("CRITICAL").alias("severity"))
    langs = _labelled(CP.hreflang_not_returned(pages).withColumnRenamed("src", "url"), "hreflang_missing_reciprocal", "technical", "HIGH")
    back = CP.keyed_pages(pages, "pagination_prev").select(U.match_key(F.col("key")).alias("_n"), U.match_key(F.col("pagination_prev")).alias("_b"))
    ahead = pages.select("url", U.match_key(F.col("url")).alias("_u"), U.match_key(F.col("pagination_next")).alias("_n")).where("_n <> ''")
    pag = _labelled(salted_join(ahead, back, ["_n"], F.col("url")).where("_b <> '' and _b <> _u"), "pagination_non_reciprocal", "technical", "MEDIUM")
    targets = CP.bad_targets_by_page(CP.link_rows(pages), crawled, shown=1).withColumnRenamed("src", "url")
    dead = _labelled(targets.where("kind = 'broken'"), "broken_internal_link", "technical", "HIGH")
    hops = _labelled(targets.where("kind = 'redirect'"), "internal_link_redirect_chain", "technical", "MEDIUM")
    anchors = F.transform("link_objects", lambda o: F.lower(F.trim(F.coalesce(o["text"], F.lit("")))))
    specific = F.filter(anchors, lambda a: (a != "") & ~a.isin(L.GENERIC_ANCHORS_AUDIT))
    over = pages.select("url", F.explode(F.filter(PI.anchor_counts(specific), lambda u: u["uses"] > 3)).alias("o"))
    used = _labelled(over, "exact_match_anchor_overuse", "on_page", "HIGH")
    return reduce(DataFrame.unionByName, [canon, bad, langs, pag, dead, hops, used])


def joined_site_issues(pages: DataFrame, crawled: DataFrame) -> DataFrame:
    away = CP.hreflang_not_canonical(pages).withColumnRenamed("src", "url")
    dead = CP.widely_linked_dead(CP.link_rows(pages), crawled)
    return _labelled(away, "hreflang_non_canonical_target", "technical", "HIGH").unionByName(
        _labelled(dead, "widely_linked_dead_page", "technical", "CRITICAL"))


def rule_audit(pages: DataFrame, sitemap: DataFrame, robots: DataFrame, vitals: DataFrame) -> DataFrame:
    """All issues: ``scope`` (page or site), ``url, type, cluster, severity, explanation, fix``.

    Loaded pages are judged by all rules but those for error pages, and their links and canonicals against every crawled page.
    """
    real = pages.where("not is_error")
    context = with_context(real, sitemap, robots, vitals)
    fired = _fired(context, {"page": page_rules(), "site": site_rules()})
    listed = sitemap.select(U.match_key(F.col("url")).alias("_key")).distinct().withColumn("_hit", F.lit(True))
    errors = pages.where("is_error").select("url", "status_code", U.match_key(F.col("url")).alias("_key")).join(listed, "_key", "left")
    fired = fired.unionByName(_fired(errors.withColumn("_listed", F.coalesce("_hit", F.lit(False))), {"page": error_rules()}))
    page = joined_page_issues(real, pages).withColumn("scope", F.lit("page"))
    site = joined_site_issues(real, pages).withColumn("scope", F.lit("site"))
    fixes = F.create_map(*[F.lit(x) for pair in FIXES.items() for x in pair])
    return fired.unionByName(page).unionByName(site).select(
        "scope", "url", "type", "cluster", "severity", F.replace("type", F.lit("_"), F.lit(" ")).alias("explanation"),
        F.element_at(fixes, F.col("cluster")).alias("fix"))


def page_cluster_scores(pages: DataFrame, issues: DataFrame) -> DataFrame:
    """Per loaded page and cluster: 100 less the points of its issues, at least 0."""
    points = F.create_map(*[F.lit(x) for pair in L.SEVERITY_POINTS.items() for x in pair])
    lost = issues.where("scope = 'page'").groupBy("url", "cluster").agg(F.sum(F.element_at(points, F.col("severity"))).alias("lost"))
    grid = pages.where("not is_error").select("url", F.explode(F.array(*map(F.lit, L.CLUSTERS))).alias("cluster"))
    return grid.join(lost, ["url", "cluster"], "left").select(
        "url", "cluster", F.greatest(F.lit(0).cast("bigint"), 100 - F.coalesce("lost", F.lit(0))).alias("score"))


def site_summary(scores: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: issue counts by severity, the mean score of each cluster, the site score and grade."""
    means = scores.groupBy().pivot("cluster", L.CLUSTERS).agg(F.round(F.avg("score"), 0).cast("int"))
    counts = issues.agg(F.count(F.lit(1)).alias("total_issues"), *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in L.SEVERITY_POINTS])
    zero = F.lit(0).cast("bigint")
    count_names, mean_names = counts.columns, L.CLUSTERS
    both = means.select(*mean_names, *[zero.alias(c) for c in count_names]).unionByName(
        counts.select(*[F.lit(0).cast("int").alias(c) for c in mean_names], *count_names))
    row = both.agg(*[F.max(c).alias(c) for c in mean_names + count_names])
    score = F.round(sum((F.col(c) for c in L.CLUSTERS), F.lit(0)) / len(L.CLUSTERS), 0).cast("int")
    return row.withColumn("site_score", score).withColumn("site_grade", site_grade(F.col("site_score")))
