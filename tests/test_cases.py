"""The cases of the audited site: cross-page checks, scores, caps and edge cases."""

import pytest
from factory import SECURE, pages, values
from pyspark.sql import functions as F

from rankloom import lookups as L
from rankloom.functions import scores as S
from rankloom.operators import cross_page as CP, page_issues as PI, rule_audit as RA, site_audit as SA, technical as TE
from rankloom.plans.full_audit import run_full_audit
from rankloom.plans.validation_suite import validate_all
from rankloom.sources import robots as RB

U = "https://example.com"


def audit(spark, frame):
    labelled = PI.detect_issues(frame)
    return SA.audit_counts(labelled)


def test_broken_link(spark):
    p = pages(spark, {"url": f"{U}/", "links": [f"{U}/broken/", f"{U}/ok"]}, {"url": f"{U}/broken", "status_code": 404}, {"url": f"{U}/ok"})
    rows = CP.broken_links(CP.link_rows(p), p).collect()
    assert [(r.severity, r.source, r.target, r.status) for r in rows] == [("HIGH", f"{U}/", f"{U}/broken/", 404)]


def test_duplicate_title(spark):
    p = pages(spark, *[{"url": f"{U}/{i}", "title": "Same " if i else "SAME"} for i in range(3)], {"url": f"{U}/x", "title": "Other"})
    assert values(CP.duplicate_titles(p), "key", "n_rows") == [("same", 3)] * 3
    flagged = PI.detect_issues(p).where(F.array_contains("issues", "Duplicate Title"))
    assert flagged.count() == 3


def test_noindex(spark):
    p = pages(spark, {"url": f"{U}/a", "robots_meta": "noindex"}, {"url": f"{U}/b", "x_robots_tag": "noindex", "x_robots_noindex": True}, {"url": f"{U}/c"})
    found = PI.page_issue_rows(p, ["indexability"]).where("code = 'noindex'")
    assert values(found, "url", "detail") == [(f"{U}/a", "meta"), (f"{U}/b", "header")]


def test_hreflang(spark):
    tags = [("en", f"{U}/en"), ("de", f"{U}/de")]
    p = pages(spark, {"url": f"{U}/en", "hreflang_tags": tags}, {"url": f"{U}/de"})
    assert values(CP.hreflang_not_returned(p), "src", "dst") == [(f"{U}/en", f"{U}/de")]
    both = pages(spark, {"url": f"{U}/en", "hreflang_tags": tags}, {"url": f"{U}/de", "hreflang_tags": tags})
    assert CP.hreflang_not_returned(both).count() == 0


def test_headers_lower_the_security_score(spark):
    p = pages(spark, {"response_headers": {"X-Frame-Options": "DENY"}})
    score = {r.cluster: r.score for r in SA.cluster_scores(audit(spark, p)).collect()}
    assert score["security"] < 80


def test_clean_pages_have_no_critical_issue(spark):
    p = pages(spark, *[{"url": f"{U}/{i}", "title": f"A good descriptive page title {i}"} for i in range(5)])
    assert SA.all_issues(audit(spark, p)).where("severity = 'CRITICAL'").count() == 0


def test_http_pages_cap_the_site_score(spark):
    p = pages(spark, *[{"url": f"http://example.com/{i}"} for i in range(3)])
    row = SA.final_score(audit(spark, p)).head()
    assert row.site_score <= 90 and row.reason


def test_missing_viewport_caps_the_cluster(spark):
    p = pages(spark, *[{"url": f"{U}/{i}", "viewport": None} for i in range(5)])
    row = SA.cluster_scores(audit(spark, p)).where("cluster = 'technical'").head()
    assert row.score <= 85 and row.critical_signal_missing


@pytest.mark.parametrize("score,grade", [(100, "A+"), (90, "A+"), (89, "A"), (80, "A"), (79, "B"), (70, "B"), (69, "Needs Fix"), (0, "Needs Fix")])
def test_grades(spark, score, grade):
    assert spark.range(1).select(S.site_grade(F.lit(score)).alias("g")).head().g == grade


def test_empty_page(spark):
    p = pages(spark, {"title": None, "meta_description": None, "h1": None, "canonical": None, "viewport": None, "body_text": None, "robots_meta": None, "response_headers": None})
    scored = TE.with_signal_score(p).head()
    assert 0 <= scored.page_score <= 100
    gaps = {r.signal for r in SA.gap_list(audit(spark, p)).where("cluster = 'on_page'").collect()}
    assert {"title", "meta_description", "h1"} <= gaps


def test_canonical_loop_and_chain(spark):
    loop = pages(spark, {"url": f"{U}/a", "canonical": f"{U}/b"}, {"url": f"{U}/b", "canonical": f"{U}/a"})
    assert {r.type for r in CP.canonical_problems(loop).collect()} == {"canonical_loop"}
    chain = pages(spark, {"url": f"{U}/a", "canonical": f"{U}/b"}, {"url": f"{U}/b", "canonical": f"{U}/c"}, {"url": f"{U}/c"})
    rows = CP.canonical_problems(chain).collect()
    assert [(r.type, r.url, r.hops) for r in rows] == [("canonical_chain", f"{U}/a", 2)]
    assert dict(values(CP.canonical_status(chain), "url", "status")) == {f"{U}/a": "ok", f"{U}/b": "ok", f"{U}/c": "self"}


def test_long_chain_is_followed_to_its_end(spark):
    n = 12
    p = pages(spark, *[{"url": f"{U}/{i}", "canonical": f"{U}/{min(i + 1, n)}"} for i in range(n + 1)])
    longest = CP.canonical_problems(p).agg(F.max("hops")).head()[0]
    assert longest == n
    assert dict(values(CP.canonical_status(p), "url", "status"))[f"{U}/0"] == "too_deep"


def test_robots_file(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: Googlebot\nDisallow: /x\nCrawl-delay: 12\nSitemap: https://example.com/s.xml"
    files = spark.createDataFrame([("example.com", text), ("empty.com", "")], "site string, content string")
    row = {r.site: r for r in RB.robots_report(files).collect()}
    assert row["example.com"].disallowed == ["/"] and "whole site blocked" in row["example.com"].issues
    assert row["example.com"].sitemaps == ["https://example.com/s.xml"] and row["example.com"].has_googlebot_rules
    assert row["example.com"].user_agents == ["*", "Googlebot"]
    assert row["empty.com"].issues == ["empty file"]


def test_sitemap_conflict(spark):
    p = pages(spark, {"url": f"{U}/a", "robots_meta": "noindex"}, {"url": f"{U}/b"})
    sitemap = spark.createDataFrame([(f"{U}/a/",), (f"{U}/gone",)], "url string")
    assert values(CP.sitemap_conflicts(p, sitemap), "url", "type") == [
        (f"{U}/a", "sitemap_noindex"), (f"{U}/b", "not_in_sitemap"), (f"{U}/gone", "sitemap_missing")]


def test_page_score_names_its_deductions(spark):
    row = TE.with_signal_score(pages(spark, {"title": None, "meta_description": None, "viewport": None})).head()
    assert row.page_score < 60
    assert {d.signal for d in row.deductions} >= {"title", "meta_description", "viewport"} and "CRITICAL" in row.why


@pytest.mark.parametrize("value,status,weak", [
    ("max-age=31536000; includeSubDomains; preload", "good", False), (None, "missing", False), ("max-age=86400", "weak", True)])
def test_hsts(spark, value, status, weak):
    headers = {**SECURE, "strict-transport-security": value} if value else {k: v for k, v in SECURE.items() if not k.startswith("strict")}
    row = pages(spark, {"response_headers": headers}).select(PI.hsts_check().alias("h")).head().h
    assert row.status == status and ("max-age below one year" in row.issues) == weak


def test_technical_score_has_its_written_top(spark):
    body, title = "word. " * 900, "A title of a good length for a page"
    p = pages(spark, {"title": title, "meta_description": "d" * 120, "h2": ["Two"], "og_image": "x", "body_text": body, "img_alts": ["a"]})
    assert TE.audit_pages(p, parts=[]).head().tech_score == 94


def test_validation_suite(spark):
    p = pages(spark, {"url": f"{U}/", "links": [f"{U}/a", f"{U}/a"]}, {"url": f"{U}/a", "status_code": 500}, {"url": f"{U}/b", "body_text": "w " * 60}, {"url": f"{U}/c", "body_text": "w " * 60})
    result = validate_all(p, spark.createDataFrame([(f"{U}/zz",)], "url string"))
    kinds = {r.type for r in result["cross_page_issues"].collect()}
    assert {"broken_internal_link", "duplicate_content", "orphan_page", "sitemap_missing", "duplicate_title"} <= kinds
    stats = result["stats"].head()
    assert stats.pages_analysed == 4 and stats.cross_page_count == result["cross_page_issues"].count()


def test_full_audit_of_many_pages(spark):
    p = pages(spark, *[{"url": f"{U}/{i}", "title": f"Title number {i}", "canonical": f"{U}/{i}"} for i in range(100)])
    result = run_full_audit(p)
    assert result["scores"].where("level = 'page'").count() == 100
    assert 0 <= result["final"].head().site_score <= 100
    assert result["roadmap"].count() > 0


def test_rule_audit_names_rules_and_scores(spark):
    p = pages(spark, {"url": "http://example.com/A_b/c/d/e", "title": None, "viewport": None, "redirect_hops": 2}, {"url": f"{U}/ok"})
    nothing = spark.createDataFrame([], "url string")
    rules = spark.createDataFrame([("example.com", 1, "/A_b")], "site string, pos int, path string")
    vitals = spark.createDataFrame([(f"{U}/ok", 4.5, 0.2, None)], "url string, lcp_s double, cls double, inp_s double")
    issues = RA.rule_audit(p, nothing, rules, vitals)
    found = {(r.url, r.type) for r in issues.collect()}
    for kind in ("robots_blocked", "missing_title", "missing_viewport", "redirect_chain", "http_page", "url_mixed_case", "url_underscores", "deep_crawl_depth"):
        assert ("http://example.com/A_b/c/d/e", kind) in found
    assert (f"{U}/ok", "cwv_lcp_poor") in found and (f"{U}/ok", "cwv_cls_needs_improvement") in found
    scores = RA.page_cluster_scores(p, issues)
    assert scores.count() == 2 * len(L.CLUSTERS)
    assert scores.where("score < 0 or score > 100").count() == 0
