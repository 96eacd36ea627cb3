"""Row-wise page checks: light labels, the page validator, priorities and markup checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rankloom import lookups as L
from rankloom.functions import text as TX, urls as U
from rankloom.functions.scores import labels, let, present
from rankloom.operators.skew import with_group_size

ISSUE_TYPE = "array<struct<category:string,severity:string,code:string,detail:string>>"


def finding(category: str, severity: str | Column, code: str, condition: Column, detail: Column | str = "") -> Column:
    """A structured issue, or null where the condition does not hold."""
    sev = F.lit(severity) if isinstance(severity, str) else severity
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.when(
        condition,
        F.struct(
            F.lit(category).alias("category"), sev.alias("severity"), F.lit(code).alias("code"),
            F.coalesce(text.cast("string"), F.lit("")).alias("detail"),
        ),
    )


def _findings(*items: Column) -> Column:
    return present(F.array(*items)).cast(ISSUE_TYPE)


# --- light labels -----------------------------------------------------------------------------------------------------

def light_labels() -> Column:
    title, meta = F.trim("title"), F.trim("meta_description")
    canonical = F.trim("canonical")
    n_title, n_meta, n_h1 = F.length(title), F.length(meta), F.size("h1")
    ok = labels(
        F.when(n_title == 0, "Missing Title")
        .when(n_title > 60, "Title Too Long")
        .when((n_title < 30) & ~U.is_homepage(F.col("url")), "Title Too Short"),
        F.when(n_meta == 0, "Missing Meta Description")
        .when(n_meta > 160, "Meta Description Too Long")
        .when(n_meta < 120, "Meta Description Too Short"),
        F.when(n_h1 == 0, "Missing H1").when(n_h1 > 1, "Multiple H1 Tags"),
        F.when(F.size("h2") == 0, "Missing H2"),
        F.when(F.coalesce(F.col("status_code") != 200, F.lit(True)), "Broken Page"),
        F.when(canonical == "", "Missing Canonical").when(
            U.strip_slash(canonical) != U.strip_slash(F.col("url")), "Canonical Mismatch"
        ),
    )
    return F.when(F.col("is_error"), F.array(F.lit("Broken Page"))).otherwise(ok)


def light_issues(pages: DataFrame) -> DataFrame:
    """Pages with their light labels in ``issues``."""
    return pages.withColumn("issues", light_labels())


def duplicate_key(column: str) -> Column:
    return F.lower(F.trim(column))


def detect_issues(pages: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """Light labels plus the labels for titles and descriptions found twice within ``by`` (the crawl of a site).

    Duplicates are found on keys alone, so the wide rows are joined once, by URL.
    """
    key_columns = {
        "_title_key": F.when(F.col("is_error"), "").otherwise(duplicate_key("title")),
        "_meta_key": F.when(F.col("is_error"), "").otherwise(duplicate_key("meta_description")),
    }
    keys = pages.select("url", *by, *[c.alias(name) for name, c in key_columns.items()])
    flags = None
    for name, label in (("_meta_key", "Duplicate Meta Description"), ("_title_key", "Duplicate Title")):
        hit = with_group_size(keys.where(F.col(name) != ""), name, F.col("url"), by=by).where("n_rows is not null")
        rows = hit.select("url", F.lit(label).alias("label"))
        flags = rows if flags is None else flags.unionByName(rows)
    found = flags.groupBy("url").agg(F.array_sort(F.collect_set("label")).alias("_found"))
    both = light_issues(pages).join(found, "url", "left")
    extra = F.coalesce("_found", F.array().cast("array<string>"))
    return both.withColumn("issues", F.array_union("issues", extra)).drop("_found")



def priority_label(issues: Column) -> Column:
    high = F.array(F.lit("Broken Page"), F.lit("Missing Title"))
    medium = F.array(
        F.lit("Missing Meta Description"), F.lit("Missing H1"), F.lit("Duplicate Meta Description"),
        F.lit("Multiple H1 Tags"),
    )
    return (
        F.when(F.size(issues) == 0, "")
        .when(F.arrays_overlap(issues, high), "High")
        .when(F.arrays_overlap(issues, medium), "Medium")
        .otherwise("Low")
    )


# --- page validator ---------------------------------------------------------------------------------------------------

def indexability_issues() -> Column:
    meta, header = F.lower("robots_meta"), F.lower("x_robots_tag")
    canonical, url = U.strip_slash(F.col("canonical")), U.strip_slash(F.col("url"))
    in_header = F.contains(header, F.lit("noindex"))
    source = F.when(in_header, "header").otherwise("meta")
    header_nofollow = F.col("x_robots_nofollow") | F.contains(header, F.lit("nofollow")) | F.contains(header, F.lit("none"))
    return _findings(
        finding("indexability", "CRITICAL", "noindex", in_header | F.contains(meta, F.lit("noindex")), source),
        finding("indexability", "HIGH", "header_nofollow", header_nofollow),
        finding("indexability", "HIGH", "canonical_conflict", (canonical != "") & (canonical != url), canonical),
    )


def _anchor_texts() -> Column:
    return F.transform("link_objects", lambda o: F.lower(F.trim(F.coalesce(o["text"], F.lit("")))))


def _generic(anchor: Column) -> Column:
    return anchor.isin(L.GENERIC_ANCHORS)


def anchor_counts(anchors: Column) -> Column:
    """Distinct anchor texts with their uses: runs of the sorted list, so long lists cost no more than the sort."""
    none = F.array().cast("array<struct<anchor:string,uses:int>>")

    def runs(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(s, i - 1) != F.get(s, i)))
        return let(
            ends,
            lambda e: F.transform(
                e, lambda end, k: F.struct(F.get(s, end - 1).alias("anchor"), (end - F.coalesce(F.get(e, k - 1), F.lit(0))).alias("uses"))),
        )

    return F.when(F.size(anchors) > 0, let(F.array_sort(anchors), runs)).otherwise(none)


def with_anchor_quality(pages: DataFrame) -> DataFrame:
    """Add anchor counts and ``anchor_quality_score``."""
    base = pages.withColumn("_anchors", _anchor_texts())
    base = base.withColumns(
        {
            "_generic": F.size(F.filter("_anchors", _generic)),
            "_specific": F.filter("_anchors", lambda a: (a != "") & ~_generic(a)),
        }
    )
    base = base.withColumn("_uses", anchor_counts(F.col("_specific")))
    base = base.withColumn("_overused", F.filter("_uses", lambda u: u["uses"] > 3))
    total, distinct = F.size("_anchors"), F.size("_uses")
    score = (
        100
        - F.least(F.lit(40), 8 * F.col("_generic"))
        - F.least(F.lit(30), 10 * F.size("_overused"))
        - F.when((total > 5) & (distinct / F.greatest(total, F.lit(1)) < 0.5), 10).otherwise(0)
    )
    return base.withColumn("anchor_quality_score", F.when(total == 0, 100).otherwise(F.greatest(F.lit(0), score)))


def anchor_issues() -> Column:
    """Needs the columns of :func:`with_anchor_quality`."""
    worst = F.get(F.array_sort(F.transform("_overused", lambda u: F.struct(-u["uses"], u["anchor"]))), F.lit(0))
    return _findings(
        finding("links", "MEDIUM", "generic_anchors", F.col("_generic") > 0, F.col("_generic")),
        finding("links", "HIGH", "anchor_overuse", F.size("_overused") > 0, worst["anchor"]),
    )


def content_issues() -> Column:
    body = F.trim("body_text")
    low = F.lower(body)
    n = F.col("_words")
    top5 = F.transform(F.slice("keywords", 1, 5), F.lower)
    first = F.get(F.filter(top5, lambda k: (k != "") & F.contains(low, k)), F.lit(0))
    density = 100.0 * TX.count_of(low, first) / n
    head = F.lower(F.array_join(F.slice(TX.words(body), 1, 100), " "))
    scored = (n >= 50) & first.isNotNull()
    is_top = first == F.get(top5, F.lit(0))
    return _findings(
        finding("content", "MEDIUM", "no_content", n == 0),
        finding("content", "MEDIUM", "thin_content", (n > 0) & (n < 300), n),
        finding("content", "MEDIUM", "keyword_overuse", scored & (density > 4), first),
        finding("content", "MEDIUM", "keyword_not_prominent", scored & is_top & ~F.contains(head, first), first),
    )


def heading_skips() -> Column:
    """One entry per missing level between consecutive headings: ``(from, to, missing)``."""
    levels = F.transform("heading_sequence", lambda h: h["level"])
    return F.flatten(
        F.transform(
            F.zip_with(levels, F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))), lambda a, b: F.struct(
                a.alias("prev"), b.alias("curr"))),
            lambda p: F.when(
                p["curr"] > p["prev"] + 1,
                F.transform(
                    F.sequence(p["prev"] + 1, p["curr"] - 1),
                    lambda m: F.struct(p["prev"].alias("prev"), p["curr"].alias("curr"), m.alias("missing")),
                ),
            ).otherwise(F.array().cast("array<struct<prev:int,curr:int,missing:int>>")),
        )
    )


def heading_issues() -> Column:
    return F.transform(
        heading_skips(),
        lambda s: F.struct(
            F.lit("headings").alias("category"), F.lit("MEDIUM").alias("severity"), F.lit("heading_skip").alias("code"),
            F.concat(F.lit("H"), s["prev"], F.lit(">H"), s["curr"], F.lit(" misses H"), s["missing"]).alias("detail"),
        ),
    ).cast(ISSUE_TYPE)


def hreflang_issues() -> Column:
    codes = F.transform("hreflang_tags", lambda t: F.trim(F.coalesce(t["lang"], F.lit(""))))
    lower = F.transform(codes, F.lower)
    bad = F.filter(codes, lambda c: (c != "") & ~F.rlike(c, F.lit(L.LANG_CODE)))
    repeated = F.filter(
        F.array_distinct(lower), lambda c: (c != "") & (F.size(F.filter(lower, lambda x: x == c)) > 1)
    )
    wrong = F.transform(
        bad,
        lambda c: F.struct(
            F.lit("hreflang").alias("category"), F.lit("MEDIUM").alias("severity"),
            F.lit("invalid_language_code").alias("code"), c.alias("detail"),
        ),
    ).cast(ISSUE_TYPE)
    return F.concat(
        wrong,
        _findings(
            finding("hreflang", "MEDIUM", "missing_x_default",
                    (F.size("hreflang_tags") > 0) & ~F.array_contains(lower, "x-default")),
            finding("hreflang", "MEDIUM", "repeated_language_code", F.size(repeated) > 0,
                    F.array_join(F.array_sort(repeated), ",")),
        ),
    )


def image_issues() -> Column:
    total, lazy = F.col("img_total"), F.col("img_lazy_count")
    return _findings(
        finding("images", "MEDIUM", "missing_alt", (total > 0) & (F.col("img_missing_alt") > 0), F.col("img_missing_alt")),
        finding("images", "MEDIUM", "missing_dimensions", (total > 0) & (F.col("img_missing_dims") > 0),
                F.col("img_missing_dims")),
        finding("images", "MEDIUM", "few_lazy_images", (total > 2) & (2 * lazy < total), F.concat_ws("/", lazy, total)),
    )


def has_header(name: str) -> Column:
    return F.map_contains_key("response_headers", name)


def header(name: str) -> Column:
    return F.coalesce(F.try_element_at("response_headers", F.lit(name)), F.lit(""))


def has_all_security_headers() -> Column:
    out = has_header(L.SECURITY_HEADERS[0])
    for name in L.SECURITY_HEADERS[1:]:
        out = out & has_header(name)
    return out


def weak_tls() -> Column:
    """Negotiated protocol below version 1.2, where the version is given in full."""
    version = F.regexp_extract(F.trim("tls_version"), r"(\d+\.\d+)", 1).try_cast("double")
    return F.coalesce(version < 1.2, F.lit(False))


def security_issues() -> Column:
    severity = {"referrer-policy": "HIGH", "permissions-policy": "HIGH"}
    missing = [
        finding("security", severity.get(name, "MEDIUM"), f"missing_{name}", ~has_header(name))
        for name in L.SECURITY_HEADERS[1:]
    ]
    return _findings(*missing, finding("security", "CRITICAL", "weak_tls", weak_tls(), F.col("tls_version")))


def hsts_check() -> Column:
    """Quality of the transport-security header: good, weak or missing."""
    value = header("strict-transport-security")
    age = F.regexp_extract(value, r"(?i)max-age\s*=\s*(\d+)", 1).try_cast("bigint")
    subdomains, preload = F.rlike(value, F.lit("(?i)includesubdomains")), F.rlike(value, F.lit("(?i)preload"))
    issues = labels(
        F.when(value == "", "header missing"),
        F.when((value != "") & age.isNull(), "max-age missing"),
        F.when(age < L.ONE_YEAR, "max-age below one year"),
        F.when((value != "") & ~subdomains, "includeSubDomains missing"),
        F.when((value != "") & ~preload, "preload missing"),
    )
    return F.struct(
        (value != "").alias("present"), age.alias("max_age"), subdomains.alias("includes_subdomains"),
        preload.alias("preload"),
        F.when(value == "", "missing").when(F.size(issues) == 0, "good").otherwise("weak").alias("status"),
        issues.alias("issues"),
    )


def viewport_issues() -> Column:
    view = F.lower(F.trim("viewport"))
    given = view != ""
    return _findings(
        finding("mobile", "HIGH", "missing_viewport", ~given),
        finding("mobile", "HIGH", "no_device_width", given & ~F.contains(view, F.lit("width=device-width"))),
        finding("mobile", "MEDIUM", "zoom_disabled", given & F.contains(view, F.lit("user-scalable=no"))),
        finding("mobile", "MEDIUM", "zoom_limited", given & F.contains(view, F.lit("maximum-scale=1"))),
    )


def performance_issues() -> Column:
    return _findings(
        finding("performance", "HIGH", "many_resources", F.col("resource_count") > 100, F.col("resource_count")),
        finding("performance", "HIGH", "large_html", F.col("html_size_kb") > 2048, F.col("html_size_kb")),
        finding("performance", "MEDIUM", "legacy_images", F.col("img_non_modern_count") > 0,
                F.col("img_non_modern_count")),
    )


def pagination_issues() -> Column:
    nxt, prv = F.trim("pagination_next"), F.trim("pagination_prev")
    return _findings(finding("pagination", "HIGH", "next_equals_prev", (nxt != "") & (nxt == prv), nxt))


def content_type() -> Column:
    return F.trim(F.substring_index(F.lower(header("content-type")), ";", 1))


def cache_issues() -> Column:
    control, encoding = header("cache-control"), F.lower(F.trim(header("content-encoding")))
    age = F.regexp_extract(control, r"(?i)max-age\s*=\s*(\d+)", 1).try_cast("bigint")
    squeezable = content_type().isin(L.COMPRESSIBLE_TYPES)
    category = "cache_compression"
    return _findings(
        finding(category, "HIGH", "no_cache_control", control == ""),
        finding(category, "HIGH", "max_age_zero", age == 0),
        finding(category, "MEDIUM", "short_max_age", (age > 0) & (age < L.MIN_CACHE_TTL), age),
        finding(category, "HIGH", "no_store", age.isNull() & F.contains(control, F.lit("no-store"))),
        finding(category, "MEDIUM", "no_etag", squeezable & (header("etag") == "")),
        finding(category, "HIGH", "not_compressed", squeezable & ~F.rlike(encoding, F.lit("gzip|br|deflate|zstd"))),
    )


VALIDATOR_PARTS = {
    "indexability": indexability_issues,
    "links": anchor_issues,
    "content": content_issues,
    "headings": heading_issues,
    "hreflang": hreflang_issues,
    "images": image_issues,
    "security": security_issues,
    "cache_compression": cache_issues,
    "mobile": viewport_issues,
    "performance": performance_issues,
    "pagination": pagination_issues,
}


def validate_pages(pages: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Page validator: one issue array per category, the anchor score and all issues together."""
    empty = F.array().cast(ISSUE_TYPE)
    parts = {n: p for n, p in VALIDATOR_PARTS.items() if categories is None or n in categories}
    base = with_anchor_quality(pages) if "links" in parts else pages.withColumn("anchor_quality_score", F.lit(None).cast("int"))
    base = base.withColumn("_words", TX.word_count(F.col("body_text"))) if "content" in parts else base
    cols = {
        name: part() if name == "indexability" else F.when(F.col("is_error"), empty).otherwise(part())
        for name, part in parts.items()
    }
    out = base.select(
        "url", "is_error",
        F.when(F.col("is_error"), 0).otherwise(F.col("anchor_quality_score")).alias("anchor_quality_score"),
        *[col.alias(name) for name, col in cols.items()],
    )
    out = out.withColumn("all_issues", F.concat(*parts))
    return out.withColumn("issue_count", F.size("all_issues"))


def page_issue_rows(pages: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """One row per issue of the page validator."""
    exploded = validate_pages(pages, categories).select("url", F.explode("all_issues").alias("i"))
    return exploded.select("url", "i.category", "i.severity", "i.code", "i.detail")
