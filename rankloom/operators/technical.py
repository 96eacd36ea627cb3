"""Technical audit: scored row-wise sub-audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom import lookups as L
from rankloom.functions import text as TX, urls as U
from rankloom.functions.scores import form_grade, labels, ladder, letter_grade, site_grade
from rankloom.operators.page_issues import has_all_security_headers, heading_skips


def with_word_count(pages: DataFrame) -> DataFrame:
    """Add ``_words``, so that the audits which read it scan the body once."""
    return pages.withColumn("_words", TX.word_count(F.col("body_text")))


def _none() -> Column:
    return F.array().cast("array<string>")


def _length_audit(text: Column, low: int, high: int, px_limit: int, px_score: int, what: str) -> Column:
    n, px = F.length(text), F.floor(TX.pixel_width(text) + 0.5).cast("int")
    status = (
        F.when(n == 0, "missing").when(n < low, "too_short").when(n > high, "too_long")
        .when(px > px_limit, "pixel_overflow").otherwise("ok")
    )
    score = F.when(n == 0, 0).when(n < low, 55).when(n > high, 65).when(px > px_limit, px_score).otherwise(100)
    issue = (
        F.when(n == 0, f"{what} missing").when(n < low, f"{what} too short").when(n > high, f"{what} too long")
        .when(px > px_limit, f"{what} may be cut off")
    )
    return F.struct(
        n.alias("length"), px.alias("px_est"), status.alias("status"), score.alias("score"), (n > 0).alias("present"),
        labels(issue).alias("issues"),
    )


def title_audit() -> Column:
    return _length_audit(F.trim("title"), 30, 60, 580, 75, "Title")


def meta_audit() -> Column:
    return _length_audit(F.trim("meta_description"), 120, 160, 920, 80, "Meta description")


def canonical_audit() -> Column:
    canonical = F.trim("canonical")
    own = U.strip_slash(canonical) == U.strip_slash(F.col("url"))
    return F.struct(
        F.when(canonical == "", "missing").when(own, "self").otherwise("points_elsewhere").alias("status"),
        F.when(canonical == "", 0).when(own, 100).otherwise(60).alias("score"),
        (canonical != "").alias("present"),
        labels(F.when(canonical == "", "Canonical missing").when(~own, "Canonical points elsewhere")).alias("issues"),
    )


def heading_audit() -> Column:
    n1, n2, n3 = F.size("h1"), F.size("h2"), F.size("h3")
    return F.struct(
        n1.alias("h1_count"), n2.alias("h2_count"), n3.alias("h3_count"),
        F.when(n3 > 0, 3).when(n2 > 0, 2).when(n1 > 0, 1).otherwise(0).alias("depth"),
        F.when(n1 == 0, "missing").when(n1 > 1, "multiple").otherwise("ok").alias("h1_status"),
        F.when(n2 == 0, "missing").otherwise("ok").alias("h2_status"),
        F.when(n1 == 0, 20).when(n1 > 1, 55).when(n2 == 0, 70).otherwise(100).alias("score"),
        labels(
            F.when(n1 == 0, "H1 missing").when(n1 > 1, "Several H1"),
            F.when(n2 == 0, "H2 missing"),
            F.when((n3 > 0) & (n2 == 0), "H3 without H2"),
        ).alias("issues"),
    )


def heading_flow_audit() -> Column:
    skips = F.transform(
        heading_skips(),
        lambda s: F.concat(F.lit("H"), s["prev"], F.lit(">H"), s["curr"], F.lit(" misses H"), s["missing"]),
    )
    return F.struct(F.size("heading_sequence").alias("sequence_length"), skips.alias("issues"))


def open_graph_audit() -> Column:
    title, desc, image = (F.trim(c) != "" for c in ("og_title", "og_description", "og_image"))
    return F.struct(
        (title | desc).alias("has_og"),
        F.when(title & desc & image, "complete").when(title | desc, "partial").otherwise("missing").alias("completeness"),
        F.when(title & desc & image, 100).when(title & desc, 75).when(title | desc, 55).otherwise(0).alias("score"),
        (F.trim("twitter_card") != "").alias("has_twitter"),
        labels(
            F.when(~title, "og:title missing"), F.when(~desc, "og:description missing"),
            F.when(~image, "og:image missing"),
        ).alias("issues"),
    )


def content_audit() -> Column:
    n, links = F.col("_words"), F.col("internal_links_count")
    density = F.when(n > 0, F.round(100.0 * links / n, 1)).otherwise(0.0)
    return F.struct(
        n.alias("word_count"),
        F.when(n < 300, "thin").when(n < 800, "medium").otherwise("rich").alias("depth"),
        F.when(n < 100, 30).when(n < 300, 55).when(n < 800, 80).otherwise(100).alias("score"),
        density.alias("link_density"),
        labels(
            F.when(n < 300, "Thin content"), F.when((density > 10) & (links > 5), "High link density"),
        ).alias("issues"),
    )


def url_audit() -> Column:
    url = F.col("url")
    path, depth = U.path(url), U.depth(url)
    issues = labels(
        F.when(U.scheme(url) != "https", "Not https"),
        F.when(F.length(url) > 115, "URL too long"),
        F.when(F.contains(path, F.lit("_")), "Underscores in path"),
        F.when(path != F.lower(path), "Upper case in path"),
        F.when(F.contains(url, F.lit("%20")) | F.contains(url, F.lit("+")), "Encoded spaces"),
        F.when(depth > 4, "Path too deep"),
    )
    n = F.size(issues)
    return F.struct(
        (U.scheme(url) == "https").alias("is_https"), F.length(url).alias("length"), depth.alias("depth"),
        (U.query(url) != "").alias("has_query"),
        F.when(n == 0, 100).when(n == 1, 75).otherwise(F.greatest(F.lit(30), 100 - 18 * n)).alias("score"),
        issues.alias("issues"),
    )


def image_alt_audit() -> Column:
    n = F.size("img_alts")
    filled = F.size(F.filter("img_alts", lambda a: F.trim(a) != ""))
    share = F.round(100.0 * filled / F.greatest(n, F.lit(1)), 0).cast("int")
    return F.struct(
        n.alias("captured"), filled.alias("with_text"),
        F.when(n == 0, "no_images").when(filled == n, "all_have_alt").when(filled > 0, "partial")
        .otherwise("none_have_alt").alias("status"),
        F.when((n == 0) | (filled == n), 100).when(filled > 0, F.greatest(F.lit(40), share)).otherwise(0).alias("score"),
        labels(
            F.when(filled < n, "Images with empty alt text"), F.when((n > 0) & (filled == 0), "No image has alt text"),
        ).alias("issues"),
    )


def status_audit() -> Column:
    hundred = F.floor(F.col("status_code") / 100).cast("int")
    failed = F.col("is_error") | F.col("status_code").isNull()
    return F.struct(
        F.when(failed, 0).when(hundred == 2, 100).when(hundred == 3, 70).when(hundred.isin(4, 5), 0).otherwise(50)
        .alias("score"),
        labels(
            F.when(failed, "Page failed to load").when(hundred == 3, "Redirect").when(hundred == 4, "Client error")
            .when(hundred == 5, "Server error"),
        ).alias("issues"),
    )


def viewport_audit() -> Column:
    view = F.lower("viewport")
    width, locked = F.contains(view, F.lit("width=device-width")), F.contains(view, F.lit("user-scalable=no"))
    issues = labels(
        F.when(view == "", "Viewport missing"),
        F.when((view != "") & ~width, "No device width"),
        F.when((view != "") & locked, "Zoom disabled"),
    )
    return F.struct(
        (view != "").alias("present"),
        F.when(view == "", "missing").when(F.size(issues) == 0, "ok").otherwise("warning").alias("status"),
        issues.alias("issues"),
    )


def readability_audit() -> Column:
    """Mean sentence length; texts under 30 words are not rated."""
    n = F.col("_words")
    sentences = F.filter(F.transform(F.split("body_text", "[.!?]"), TX.strip), lambda s: F.length(s) > 10)
    total = F.aggregate(sentences, F.lit(0), lambda acc, s: acc + TX.word_count(s))
    mean = F.when(F.size(sentences) > 0, F.round(total / F.size(sentences), 1))
    rated = (n >= 30) & mean.isNotNull()
    return F.struct(
        F.when(rated, mean).alias("avg_sentence_len"),
        F.when(~rated, "N/A").when(mean <= 18, "Easy").when(mean <= 25, "Standard").otherwise("Difficult").alias("label"),
        F.when(~rated, None).when(mean <= 18, 75).when(mean <= 25, 55).otherwise(30).alias("score"),
    )


def flesch_scores() -> Column:
    """Flesch reading ease, grade level and fog index; syllables are counted as vowel groups."""
    body = F.lower("body_text")
    n = F.greatest(F.regexp_count(body, F.lit(r"[a-z]+")), F.lit(1))
    sentences = F.greatest(F.size(F.filter(F.split("body_text", "[.!?]+"), lambda s: F.trim(s) != "")), F.lit(1))
    syllables = F.regexp_count(body, F.lit("[aeiouy]+"))
    long_words = F.regexp_count(body, F.lit(r"\b(?:[^aeiouy\W]*[aeiouy]+){3,}[^aeiouy\W]*\b"))
    return F.struct(
        F.round(206.835 - 1.015 * n / sentences - 84.6 * syllables / n, 1).alias("reading_ease"),
        F.round(0.39 * n / sentences + 11.8 * syllables / n - 15.59, 1).alias("grade_level"),
        F.round(0.4 * (n / sentences + 100.0 * long_words / n), 1).alias("fog"),
    )


def freshness_audit(now: Column) -> Column:
    """Age from the Last-Modified header, relative to ``now``."""
    value = F.trim("last_modified")
    when = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(value, r"^[A-Za-z]+,\s*", ""), r"\s*GMT$", ""),
                              F.lit("d MMM yyyy HH:mm:ss"))
    age = F.floor((F.unix_timestamp(now) - F.unix_timestamp(when)) / 86400).cast("int")
    status = (
        F.when(value == "", "unknown").when(when.isNull(), "parse_error").when(age < 30, "fresh")
        .when(age < 180, "recent").when(age < 365, "ageing").otherwise("stale")
    )
    return F.struct(age.alias("age_days"), status.alias("status"))


def rich_result_audit() -> Column:
    types = F.transform("schema_types", F.lower)
    eligible = F.array_intersect(types, F.array(*map(F.lit, L.RICH_TYPES)))
    articles = F.array(*map(F.lit, ["article", "newsarticle", "blogposting", "product"]))
    given = F.size(types) > 0
    return F.struct(
        given.alias("present"), eligible.alias("rich_types"),
        labels(
            F.when(~F.array_contains(types, "faqpage"), "FAQPage"),
            F.when(~F.array_contains(types, "breadcrumblist"), "BreadcrumbList"),
            F.when(~given, "Article").when(~F.arrays_overlap(types, articles), "Article or Product"),
        ).alias("suggested"),
        F.when(~given, "missing").when(F.size(eligible) > 0, "ok").otherwise("non_eligible").alias("status"),
    )


def schema_props_audit() -> Column:
    """Missing required properties of the audited structured-data types."""
    required = F.create_map(
        *[x for t, props in L.AUDIT_REQUIRED_PROPS.items() for x in (F.lit(t), F.array(*map(F.lit, props)))]
    )
    missing = F.flatten(
        F.transform(
            "schema_objects",
            lambda o: F.transform(
                F.array_except(F.coalesce(F.try_element_at(required, o["type"]), _none()), o["props"]),
                lambda p: F.concat(o["type"], F.lit("."), p),
            ),
        )
    )
    return F.struct(missing.alias("issues"))


def image_format_audit() -> Column:
    plain = F.transform("img_srcs", lambda s: F.substring_index(F.lower(s), "?", 1))
    modern = F.size(F.filter(plain, lambda s: F.rlike(s, F.lit(r"\.(webp|avif)$"))))
    legacy = F.size(F.filter(plain, lambda s: F.rlike(s, F.lit(r"\.(jpg|jpeg|png|gif|bmp|tif|tiff)$"))))
    total = modern + legacy
    return F.struct(
        total.alias("total"), modern.alias("next_gen"), legacy.alias("legacy"),
        F.when(F.size("img_srcs") == 0, None).when(total > 0, F.round(100.0 * modern / total, 1)).otherwise(0.0)
        .alias("next_gen_pct"),
        F.when(F.size("img_srcs") == 0, "no_images").when((legacy > 0) & (modern == 0), "legacy_only")
        .when(legacy > modern, "mostly_legacy").otherwise("ok").alias("status"),
        labels(F.when((legacy > 0) & (modern == 0), "Only legacy image formats").when(legacy > modern,
               "Mostly legacy image formats")).alias("issues"),
    )


def image_loading_audit() -> Column:
    total = F.col("img_total")
    lazy, srcset = (total > 2) & (F.col("img_lazy_pct") < 50), (total > 2) & (F.col("img_srcset_pct") < 30)
    return F.struct(
        F.when(total == 0, "no_images").when(lazy & srcset, "needs_work").when(lazy | srcset, "partial")
        .otherwise("ok").alias("status"),
        labels(F.when(lazy, "Few lazy images"), F.when(srcset, "Few responsive images")).alias("issues"),
    )


def breadcrumb_audit() -> Column:
    found, source = F.col("breadcrumb_detected"), F.col("breadcrumb_source")
    return F.struct(
        F.when(~found, "missing").when(source == "json_ld", "ok").otherwise("partial").alias("status"),
        F.when(found, F.size("breadcrumbs")).otherwise(0).alias("item_count"),
    )


def hreflang_audit() -> Column:
    langs = F.filter(F.transform("hreflang_tags", lambda t: F.lower(F.coalesce(t["lang"], F.lit("")))), lambda c: c != "")
    repeated = F.size(langs) > F.size(F.array_distinct(langs))
    default = F.array_contains(langs, "x-default")
    given = F.size("hreflang_tags") > 0
    return F.struct(
        F.size("hreflang_tags").alias("count"), F.array_sort(F.array_distinct(langs)).alias("langs"),
        default.alias("has_x_default"),
        F.when(~given, "not_implemented").when(repeated | ~default, "issues").otherwise("ok").alias("status"),
    )


def indexability() -> Column:
    """Likely indexability from the robots directive, the status and the canonical."""
    hundred = F.floor(F.col("status_code") / 100).cast("int")
    canonical = U.strip_slash(F.trim("canonical"))
    own = canonical == U.strip_slash(F.col("url"))
    return (
        F.when(F.col("robots_noindex"), "not_indexable_noindex")
        .when(F.col("is_error") | F.col("status_code").isNull(), "not_indexable_error")
        .when(hundred == 3, "not_indexable_redirect")
        .when(hundred.isin(4, 5), "not_indexable_error")
        .when((hundred == 2) & (canonical == ""), "likely_indexable")
        .when((hundred == 2) & own, "indexable")
        .when(hundred == 2, "canonical_mismatch")
        .otherwise("unknown")
    )


SCORED = {
    "title": title_audit, "meta": meta_audit, "canonical": canonical_audit, "headings": heading_audit,
    "og": open_graph_audit, "content": content_audit, "url": url_audit, "images": image_alt_audit,
    "status": status_audit,
}
UNSCORED = {
    "image_formats": image_format_audit, "viewport": viewport_audit, "heading_flow": heading_flow_audit,
    "schema_props": schema_props_audit, "image_loading": image_loading_audit, "breadcrumb": breadcrumb_audit,
    "hreflang": hreflang_audit, "rich_results": rich_result_audit, "readability": readability_audit,
}
LISTED = [
    "title", "meta", "canonical", "headings", "og", "content", "url", "images", "image_formats", "status", "viewport",
    "heading_flow", "schema_props",
]


def tech_score(audits: dict[str, Column]) -> Column:
    """Weighted mean of the nine scored audits, as a whole number."""
    total = sum((audits[name]["score"] * L.TECH_WEIGHTS[name] for name in SCORED), F.lit(0))
    return F.round(total / sum(L.TECH_WEIGHTS.values()), 0).cast("int")


def audit_pages(pages: DataFrame, now: Column | None = None, parts: list[str] | None = None) -> DataFrame:
    """Technical audit of every page: one struct per sub-audit, score, grade and the issue list.

    ``parts`` limits the unscored sub-audits kept in the result.
    """
    audits = {name: part() for name, part in {**SCORED, **UNSCORED}.items()}
    if now is not None:
        audits["freshness"] = freshness_audit(now)
    keep = [n for n in audits if parts is None or n in SCORED or n in LISTED or n in parts]
    out = with_word_count(pages).select(
        *[c for c in ("site",) if c in pages.columns], "url", "status_code", "is_error", indexability().alias("indexability"), *[audits[n].alias(f"a_{n}") for n in keep]
    )
    out = out.withColumn("tech_score", tech_score({n: F.col(f"a_{n}") for n in SCORED}))
    out = out.withColumn("tech_grade", letter_grade(F.col("tech_score")))
    return out.withColumn("all_issues", F.concat(*[F.col(f"a_{n}.issues") for n in LISTED]))


def with_inbound_links(audits: DataFrame, links: DataFrame, sample: int = 10) -> DataFrame:
    """Add the inbound link count, a sample of linking pages and the orphan flag.

    ``links`` has one row per link (``src``, ``dst``). Counts are summed before the join; the sample is
    cut by rank before it is collected, so no task ever holds all links of a popular page.
    """
    counts = links.groupBy("dst").agg(F.count(F.lit(1)).alias("inbound_count"))
    first = Window.partitionBy("dst").orderBy("src")
    ranked = links.select("src", "dst").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= sample)
    samples = ranked.groupBy("dst").agg(F.array_sort(F.collect_list("src")).alias("inbound_urls"))
    inbound = counts.join(samples, "dst")
    joined = audits.join(inbound, audits["url"] == inbound["dst"], "left").drop("dst")
    count = F.coalesce("inbound_count", F.lit(0))
    return joined.withColumns(
        {
            "inbound_count": count,
            "inbound_urls": F.coalesce("inbound_urls", _none()),
            "orphan": (count == 0) & ~F.col("is_error"),
        }
    )


def ranking_score() -> Column:
    """Score of the basic on-page facts; needs the light labels in ``issues``."""
    def has(label: str) -> Column:
        return F.array_contains("issues", label)

    title, meta, canonical = F.trim("title"), F.trim("meta_description"), F.trim("canonical")
    h1_text = F.lower(F.array_join("h1", " "))
    aligned = F.size(
        F.filter(
            F.slice(F.transform("keywords", F.lower), 1, 5),
            lambda k: F.contains(F.lower(title), k) | F.contains(h1_text, k),
        )
    )
    points = (
        F.when((title != "") & ~has("Missing Title"), F.when(has("Title Too Long"), 12).otherwise(20)).otherwise(0)
        + F.when((meta != "") & ~has("Missing Meta Description"),
                 F.when(has("Duplicate Meta Description"), 8).otherwise(15)).otherwise(0)
        + F.when((F.size("h1") > 0) & ~has("Missing H1"), F.when(has("Multiple H1 Tags"), 12).otherwise(20)).otherwise(0)
        + F.when(F.size("h2") > 0, 10).otherwise(0)
        + F.when((canonical != "") & ~has("Missing Canonical") & ~has("Canonical Mismatch"), 10).otherwise(0)
        + 15
        + F.when((F.size("keywords") > 0) & (title != ""), F.least(F.lit(10), 2 * aligned)).otherwise(0)
    )
    return F.when(F.col("is_error") | F.coalesce(F.col("status_code") != 200, F.lit(True)), 0).otherwise(points)


def form_score(title: Column, meta: Column, h1: Column, keyword: Column) -> Column:
    """Mean of the checks that apply to a title, meta description, first heading and keyword."""
    title, meta, h1, kw = F.trim(title), F.trim(meta), F.trim(h1), F.lower(F.trim(keyword))

    def holds(text: Column) -> Column:
        return F.contains(F.lower(text), kw)

    n_title, n_meta = F.length(title), F.length(meta)
    checks = F.array(
        F.when(n_title == 0, 0).when(n_title < 30, 30).when(n_title > 65, 55).otherwise(100),
        F.when((kw != "") & (title != ""), F.when(holds(title), 100).otherwise(20)),
        F.when(n_meta == 0, 0).when(n_meta < 70, 30).when(n_meta > 165, 60).otherwise(100),
        F.when(h1 == "", 0).when((kw != "") & holds(h1), 100).otherwise(70),
        F.when((title != "") & (h1 != ""), F.when(F.lower(title) == F.lower(h1), 40).otherwise(100)),
        F.when((kw != "") & (meta != ""), F.when(holds(meta), 100).otherwise(50)),
    )
    used = F.filter(checks, lambda c: c.isNotNull())
    mean = F.round(F.aggregate(used, F.lit(0), lambda a, c: a + c) / F.size(used), 0).cast("int")
    return F.when((title != "") | (meta != "") | (h1 != ""), mean)


def form_scores(rows: DataFrame) -> DataFrame:
    """Rows with ``title, meta, h1, keyword`` and their form score and grade."""
    score = form_score(F.col("title"), F.col("meta"), F.col("h1"), F.col("keyword"))
    return rows.withColumn("score", score).withColumn("grade", form_grade(F.col("score")))


def snippet_potential() -> Column:
    """Points, rating and signals of a page that may win a featured snippet."""
    body, n = F.col("body_text"), F.col("_words")
    questions = F.size(F.filter(F.concat("h2", "h3"), lambda h: F.rlike(h, F.lit(L.QUESTION_START))))
    sentences = F.slice(F.filter(F.transform(F.split(body, "[.!?]"), TX.strip), lambda s: s != ""), 1, 30)
    answers = F.size(F.filter(F.transform(sentences, TX.word_count), lambda k: k.between(20, 80)))
    checks = [
        (n >= 800, 15, "sufficient_word_count"),
        (questions >= 2, 20, "question_headings"),
        *[(F.rlike(body, F.lit(p)), points, label) for p, points, label in L.SNIPPET_SIGNALS],
        (answers >= 3, 10, "answer_length_paragraphs"),
        (F.rlike("title", F.lit(L.QUESTION_START)), 8, "question_title"),
    ]
    points = sum((F.when(c, p).otherwise(0) for c, p, _ in checks), F.lit(0))
    points = points + F.when((n >= 300) & (n < 800), 8).otherwise(0) + F.when(questions == 1, 10).otherwise(0)
    score = F.least(points, F.lit(100))
    return F.struct(
        score.alias("score"), ladder(score, [(60, "High"), (35, "Medium")], "Low").alias("potential"),
        labels(*[F.when(c, label) for c, _, label in checks]).alias("signals"),
    )


def noindexed() -> Column:
    return (
        F.col("robots_noindex") | F.col("x_robots_noindex") | F.contains(F.lower("robots_meta"), F.lit("noindex"))
    )


def signal_present(signal: str) -> Column:
    """Whether a page carries a signal of the site audit."""
    special = {
        "status_ok": lambda: F.coalesce(F.col("status_code").between(200, 399), F.lit(False)),
        "https": lambda: F.startswith("url", F.lit("https://")),
        "all_security_headers": has_all_security_headers,
        "no_noindex": lambda: ~noindexed(),
        "h1": lambda: F.size("h1") > 0,
    }
    return special[signal]() if signal in special else F.col(signal) != ""


def with_signal_score(pages: DataFrame) -> DataFrame:
    """Per-page score from missing signals, with the deductions and the grade."""
    lost = F.filter(
        F.array(
            *[
                F.when(
                    ~signal_present(signal),
                    F.struct(F.lit(signal).alias("signal"), F.lit(severity).alias("severity"),
                             F.lit(points).alias("points"), F.lit(reason).alias("reason")),
                )
                for signal, severity, points, reason in L.PAGE_SIGNALS
            ]
        ),
        lambda d: d.isNotNull(),
    )
    out = pages.withColumn("_lost", lost)
    raw = 100 - F.aggregate("_lost", F.lit(0), lambda acc, d: acc + d["points"])
    hundred = F.floor(F.col("status_code") / 100).cast("int")
    cap = F.when(hundred == 4, 30).when(hundred == 5, 20).otherwise(100)
    out = out.withColumn("_raw", raw).withColumn("page_score", F.greatest(F.lit(0), F.least("_raw", cap)))
    capped = F.when(
        F.col("_raw") > cap,
        F.array(F.struct(F.lit("status_code").alias("signal"), F.lit("CRITICAL").alias("severity"),
                         (F.col("_raw") - cap).alias("points"), F.lit("Error status").alias("reason"))),
    ).otherwise(F.array().cast("array<struct<signal:string,severity:string,points:int,reason:string>>"))
    out = out.withColumn("deductions", F.concat("_lost", capped)).drop("_lost", "_raw")

    def reasons(severity: str) -> Column:
        picked = F.filter("deductions", lambda d: d["severity"] == severity)
        return F.when(F.size(picked) > 0, F.concat(F.lit(f"{severity}: "), F.array_join(
            F.transform(picked, lambda d: d["reason"]), "; ")))

    why = F.when(F.size("deductions") == 0, "All required signals present").otherwise(
        F.concat_ws(" | ", reasons("CRITICAL"), reasons("HIGH"))
    )
    return out.withColumn("grade", site_grade(F.col("page_score"))).withColumn("why", why)
