"""Raw pages, structured data, sitemaps, page-speed reports, stored pages."""

import pandas as pd
from factory import pages, values
from pyspark.sql import functions as F

from rankloom.sources import html_elements as HE, page_facts as PF, page_speed as SP, sitemaps as SM, stored_pages as ST, structured_data as SD
from rankloom.sources.result_pages import organic_results

HTML = """<!DOCTYPE html><html><head><title> A &amp; B </title><META NAME="Description" CONTENT="desc"><link rel="canonical" href="/x">
<script>var t="</p><h1>no</h1>";</script><script type="application/ld+json">{"@type":"Product","name":"P","author":["Ann"],"aggregateRating":{"ratingValue":4.2,"ratingCount":7}}</script>
<script type="application/ld+json">{broken</script></head><body><header>top</header><nav aria-label="breadcrumb"><li><a href="/">Home</a><li>Here</nav>
<h1>One <b>two</b></h1><h1></h1><h3>Deep</h3><p>Text <a href="sub/../p?q=1#f">first</a><a href="p?q=1">again</a><a href="https://www.other.org/z">out</a><a href="mailto:x@y">m</a>
<img src="a.jpg" loading="lazy"><img src="b.webp" alt="" width="1" height="2"><footer>bottom</footer></body></html>"""


def test_page_facts(spark):
    raw = spark.createDataFrame([("https://www.example.com/dir/page", HTML, 200), ("https://example.com/gone", HTML, 404), ("https://example.com/none", None, None)],
                                "url string, html string, status_code int")
    rows = {r.url: r for r in PF.extract_pages(raw).collect()}
    r = rows["https://www.example.com/dir/page"]
    assert (r.title, r.meta_description, r.canonical) == ("A & B", "desc", "https://www.example.com/x")
    assert r.h1 == ["Onetwo"] and [(h.level, h.text) for h in r.heading_sequence] == [(1, "Onetwo"), (3, "Deep")]
    assert [(o.href, o.text) for o in r.link_objects] == [("https://www.example.com/", "Home"), ("https://www.example.com/dir/p?q=1", "first")]
    assert r.external_links == ["https://www.other.org/z"]
    assert (r.img_total, r.img_lazy_count, r.img_missing_alt, r.img_missing_dims, r.img_non_modern_count) == (2, 1, 1, 1, 1)
    assert r.schema_types == ["Product"] and r.schema_rating == 4.2 and r.schema_review_count == 7 and r.schema_author == "Ann"
    assert r.breadcrumb_source == "html_nav" and [b.name for b in r.breadcrumbs] == ["Home", "Here"]
    assert "Text" in r.body_text and "top" not in r.body_text and "bottom" not in r.body_text and "var t" not in r.body_text
    assert rows["https://example.com/gone"].is_error and rows["https://example.com/gone"].links == []


def test_structured_data(spark):
    html = ('<script type="application/ld+json">[{"@context":"https://schema.org","@type":"FAQPage"},{"@graph":[{"@type":["Article","SaaS"],"headline":"h"}]}]</script>'
            "<SCRIPT TYPE='application/ld+json'>nope</SCRIPT>")
    p = spark.createDataFrame([("u", html), ("v", "<p>"), ("w", "")], "url string, html string")
    checks = {(r.block, r.pos, r.entry): r for r in SD.validate_blocks(SD.blocks(p)).collect()}
    assert checks[(0, 0, 0)].issues == ["FAQPage.mainEntity"] and checks[(0, 0, 0)].warnings == []
    assert checks[(0, 1, 0)].issues == ["Article.author", "Article.datePublished"] and "risky type SaaS" in checks[(0, 1, 0)].warnings
    assert checks[(1, 0, 0)].issues == ["syntax error"]
    assert dict(values(SD.page_report(p), "url", "status")) == {"u": "invalid", "v": "none", "w": "skipped"}


def test_sitemaps(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://a.com/x/ </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a.com/x</loc></url><url><loc>https://a.com/y</loc><priority>0.5</priority></url></urlset>")
    files = SM.read_sitemap_files(spark, str(tmp_path))
    assert [r.url for r in SM.sitemap_urls(files).orderBy("pos").collect()] == ["https://a.com/x", "https://a.com/y"]
    entries = SM.read_sitemap_entries(spark, str(tmp_path))
    assert entries.count() == 3 and entries.where("priority = 0.5").count() == 1


def test_result_pages(spark):
    html = '<a href="/url?q=https://a.com/p%20q&amp;sa=1"></a><a href="https://www.google.com/s"></a><a href="https://b.org/z"></a><cite>https://a.com/p q</cite><cite>https://c.net</cite>'
    rows = organic_results(spark.createDataFrame([(1, html)], "query_id int, html string"))
    assert [r.url for r in rows.orderBy("pos").collect()] == ["https://a.com/p q", "https://b.org/z", "https://c.net"]


def test_page_speed(spark):
    report = ('{"lighthouseResult":{"categories":{"performance":{"score":0.9},"seo":{"score":0.5}},"audits":{"largest-contentful-paint":{"numericValue":2600.04},'
              '"cumulative-layout-shift":{"numericValue":0.05},"document-title":{"score":1},"render-blocking-resources":{"details":{"items":[{"url":"u/a.css","totalBytes":5,"wastedMs":10.26},{"url":"u/b.css","wastedMs":30}]}}}}}')
    df = spark.createDataFrame([("https://a.com", "mobile", report), ("https://b.com", "mobile", "oops")], "url string, strategy string, report string")
    a, b = SP.flatten_reports(df).orderBy("url").collect()
    assert (a.perf_score, a.seo_score, a.lcp_ms, a.lcp_status, a.cls_status) == (90.0, 50.0, 2600.0, "Needs Improvement", "Needs Improvement")  # values are rounded to one digit first
    assert b.lcp_status == "Unknown"
    worst, totals = SP.render_blocking(df)
    assert values(worst, "rank", "resource", "wasted_ms") == [(1, "u/b.css", 30.0), (2, "u/a.css", 10.3)]
    assert values(totals, "url", "count") == [("https://a.com", 2), ("https://b.com", 0)]


def test_stored_pages_round_trip(spark, tmp_path):
    p = pages(spark, {"url": "https://a.com/", "h2": ["x"], "issues": ["Missing H2"]}).withColumn("response_headers", F.col("response_headers"))
    ST.write_job(p, str(tmp_path / "jobs"), "j1")
    ST.write_job(p, str(tmp_path / "jobs"), "j2")
    row = ST.read_job(spark, str(tmp_path / "jobs"), "j1").head()
    assert (row.url, row.h2, row.issues, row.response_headers["x-frame-options"]) == ("https://a.com/", ["x"], ["Missing H2"], "DENY")


def test_unclosed_elements_are_read_once():
    import time

    from rankloom.sources.html_elements import _read

    for page in ("<a href='/x'>text " * 20_000, "<h2>text " * 20_000, "<li>text " * 20_000, "<title>text " * 20_000):
        began = time.process_time()
        found = _read(page)
        assert time.process_time() - began < 2
        assert len(found["elements"]) == 20_000 or page.startswith("<title")
        assert sum(len(e["text"]) for e in found["elements"]) <= 2 * len(page)


def test_elements_are_given_back_in_bounded_slices(monkeypatch):
    monkeypatch.setattr(HE, "SLICE_CHARS", 100)
    html = pd.Series(["<p>one</p>"] * 25 + [None, "<h1>" + "x" * 500 + "</h1>", "", "<h1>last</h1>"])
    parts = list(HE.html_elements.func(iter([html])))
    assert [t for part in parts for t in part["text"]] == ["one"] * 25 + ["", "x" * 500, "", "last"]
    assert max(map(len, parts)) <= 12 and len(parts) >= 5
