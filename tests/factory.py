"""Pages for tests: a clean page with a few columns replaced."""

from rankloom.schema import PAGE_SCHEMA, normalise_pages

SECURE = {
    "strict-transport-security": "max-age=31536000", "content-security-policy": "default-src https:", "x-frame-options": "DENY",
    "x-content-type-options": "nosniff", "referrer-policy": "no-referrer", "permissions-policy": "camera=()",
}
CLEAN = {
    "url": "https://example.com/", "canonical": "https://example.com/", "site": "example.com", "status_code": 200, "title": "Example Page",
    "meta_description": "A description.", "h1": ["Main Heading"], "robots_meta": "index,follow", "viewport": "width=device-width, initial-scale=1",
    "body_text": "word " * 350, "links": ["https://example.com/about"], "internal_links_count": 1, "img_lazy_pct": 100.0, "og_title": "Example",
    "og_description": "Description", "response_headers": SECURE, "response_time_ms": 200, "resource_count": 20, "html_size_kb": 40.0,
    "tls_version": "TLSv1.3",
}


def pages(spark, *overrides):
    """A normalised page table, one row per dict of overrides; a page's canonical follows its url unless given."""
    rows = []
    for values in overrides:
        row = {**CLEAN, **values}
        if "url" in values and "canonical" not in values:
            row["canonical"] = values["url"]
        rows.append(tuple(row.get(f) for f in PAGE_SCHEMA.fieldNames()))
    names = [f.name for f in PAGE_SCHEMA.fields]
    frame = spark.createDataFrame(rows, PAGE_SCHEMA)
    given = {k for o in overrides for k in o} | set(CLEAN)
    return normalise_pages(frame.select(*[n for n in names if n in given]))


def values(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())
