"""Site audit: signal coverage, cluster scores and issues, gaps, security, performance, final score, roadmap.

The pages are read once: :func:`audit_counts` reduces them to one row of counts, and the tables of the audit are
small projections of that row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom import lookups as L
from rankloom.functions.scores import percent, site_grade
from rankloom.operators import page_issues as PI, technical as TE

_HEADER_NAMES = {h: h.replace("-", "_") for h in L.SECURITY_HEADERS}
_SIGNALS = list(dict.fromkeys(s for _, s, threshold, _ in L.CLUSTER_SIGNALS if threshold > 0))


def audit_counts(pages: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Everything the audit counts, in one aggregate; needs the light labels in ``issues``."""
    real = ~F.col("is_error")
    view, status = F.lower("viewport"), F.floor(F.col("status_code") / 100)
    rt = F.coalesce("response_time_ms", F.lit(0))
    total, lazy = F.col("img_total"), F.col("img_lazy_pct")
    locked = F.contains(view, F.lit("user-scalable=no"))
    counted = {
        **{f"sig_{s}": TE.signal_present(s) for s in _SIGNALS},
        "indexable": TE.indexability().isin("indexable", "likely_indexable"),
        "error_status": F.col("status_code") >= 400, "noindex": TE.noindexed(),
        "status_4xx": status == 4, "status_5xx": status == 5,
        "long_title": F.length("title") > 60, "long_meta": F.length("meta_description") > 160,
        "dup_title": F.array_contains("issues", "Duplicate Title"), "dup_meta": F.array_contains("issues", "Duplicate Meta Description"),
        "http": F.startswith("url", F.lit("http://")), "no_viewport": F.trim("viewport") == "", "locked_viewport": locked,
        "good_viewport": F.contains(view, F.lit("width=device-width")) & ~locked,
        "image_pages": total > 2, "good_lazy": (total > 2) & (lazy >= 50), "heavy": F.col("resource_count") > 100,
        "oversized": F.col("html_size_kb") > 2048, "legacy_images": F.col("img_non_modern_count") > 0, "slow": rt > 2500,
        "undimensioned": (total > 0) & (F.col("img_missing_dims") > 0), "all_lazy": (total > 0) & (F.col("img_lazy_count") > 0) & (lazy == 100),
        "timed": rt > 0, "legacy_tls": F.trim("tls_version").isin(L.WEAK_TLS), "weak_tls": PI.weak_tls(),
        "mixed": F.size("mixed_resources") > 0,
        **{f"with_{n}": PI.has_header(h) for h, n in _HEADER_NAMES.items()},
    }
    sums = {
        "mixed_total": F.size("mixed_resources"), "undimensioned_total": F.col("img_missing_dims"),
        "legacy_total": F.col("img_non_modern_count"), "time_total": rt,
    }
    aggs = [
        F.count(F.lit(1)).alias("pages"), F.count_if(real).alias("n"),
        F.count_if(F.size(TE.title_audit()["issues"]) > 0).alias("title_issues"), F.count_if(F.size(TE.meta_audit()["issues"]) > 0).alias("meta_issues"),
        *[F.count_if(real & c).alias(k) for k, c in counted.items()],
        *[F.coalesce(F.sum(F.when(real, c)), F.lit(0)).cast("bigint").alias(k) for k, c in sums.items()],
        F.max(F.when(real, F.col("html_size_kb"))).alias("largest_kb"),
    ]
    return pages.groupBy(*by).agg(*aggs) if by else pages.agg(*aggs)


def _n() -> Column:
    return F.greatest("n", F.lit(1))


def _share(column: str) -> Column:
    return percent(F.col(column), F.col("n"))


def signal_coverage(counts: DataFrame) -> DataFrame:
    """Coverage of each signal against its threshold (quality signals count as covered)."""
    entries = [
        F.struct(
            F.lit(cluster).alias("cluster"), F.lit(signal).alias("signal"), F.lit(severity).alias("severity"), F.lit(threshold).alias("threshold_pct"),
            (_share(f"sig_{signal}") if threshold > 0 else F.lit(100.0)).alias("coverage_pct"))
        for cluster, signal, threshold, severity in L.CLUSTER_SIGNALS
    ]
    rows = counts.select(F.inline(F.array(*entries)))
    return rows.withColumn("missing", F.col("coverage_pct") < F.col("threshold_pct"))


def raw_cluster_scores() -> dict[str, Column]:
    n = _n()

    def whole(x: Column) -> Column:
        return F.round(x, 0)

    cover = {s: _share(f"sig_{s}") for s in _SIGNALS}
    issue_rate = (F.col("title_issues") + F.col("meta_issues")) / (2 * n) * 100
    on_page = 0.35 * cover["title"] + 0.25 * cover["meta_description"] + 0.25 * cover["h1"] + 0.15 * cover["canonical"] - 0.3 * issue_rate
    lazy = F.when(F.col("image_pages") > 0, whole(100.0 * F.col("good_lazy") / F.greatest("image_pages", F.lit(1)))).otherwise(100.0)

    def budget(column: str, factor: float) -> Column:
        return F.greatest(F.lit(0.0), 100 - whole(factor * F.col(column) / n))

    speed = 0.35 * lazy + 0.30 * budget("heavy", 100.0) + 0.20 * budget("oversized", 100.0) + 0.15 * budget("legacy_images", 60.0)
    scores = {
        "indexability": whole(100.0 * F.col("indexable") / n) - whole(30.0 * F.col("error_status") / n),
        "on_page": F.least(F.lit(100.0), whole(on_page)),
        "technical": whole((40.0 * (F.col("n") - F.col("no_viewport")) + 40.0 * F.col("sig_https") + 20.0 * F.col("good_viewport")) / n),
        "performance": whole(speed),
        "security": whole(100.0 * F.col("sig_all_security_headers") / n),
    }
    return {c: F.greatest(F.lit(0), s.cast("int")) for c, s in scores.items()}


def cluster_scores(counts: DataFrame) -> DataFrame:
    """Raw and capped score of each cluster: 85 at most while a critical signal is below its threshold."""
    raw = raw_cluster_scores()
    entries = []
    for cluster in L.CLUSTERS:
        critical = [(s, t) for c, s, t, sev in L.CLUSTER_SIGNALS if c == cluster and sev == "CRITICAL" and t > 0]
        missing = reduce(lambda a, b: a | b, [_share(f"sig_{s}") < t for s, t in critical], F.lit(False))
        entries.append(F.struct(F.lit(cluster).alias("cluster"), raw[cluster].alias("raw_score"), missing.alias("critical_signal_missing")))
    rows = counts.select(F.inline(F.array(*entries)))
    capped = F.col("critical_signal_missing") & (F.col("raw_score") > 85)
    return rows.select("*", capped.alias("capped_at_85"), F.when(capped, 85).otherwise(F.col("raw_score")).alias("score"))


def _issue_rows(counts: DataFrame, entries: list[tuple[str, str, str, Column]]) -> DataFrame:
    """(cluster, type, severity, count) entries with a count above zero."""
    items = F.array(*[
        F.struct(F.lit(g).alias("cluster"), F.lit(t).alias("type"), F.lit(s).alias("severity"), c.cast("bigint").alias("pages")) for g, t, s, c in entries])
    return counts.select(F.inline(items)).where("pages > 0")


def cluster_issues(counts: DataFrame) -> DataFrame:
    """Issues of each cluster with their page counts; missing signals first count the pages without the signal."""
    n = F.col("n")
    missing = signal_coverage(counts).where("missing").select(
        "cluster", F.concat(F.lit("missing_signal:"), "signal").alias("type"), "severity", "signal")
    lost = _issue_rows(counts, [("", s, "", n - F.col(f"sig_{s}")) for s in _SIGNALS]).select(F.col("type").alias("signal"), "pages")
    gaps = missing.join(lost, "signal").select("cluster", "type", "severity", "pages")
    own = _issue_rows(counts, [
        ("indexability", "5xx_pages", "CRITICAL", F.col("status_5xx")), ("indexability", "4xx_pages", "CRITICAL", F.col("status_4xx")),
        ("indexability", "noindex_pages", "CRITICAL", F.col("noindex")),
        ("on_page", "duplicate_titles", "HIGH", F.col("dup_title")), ("on_page", "duplicate_meta", "HIGH", F.col("dup_meta")),
        ("on_page", "title_too_long", "MEDIUM", F.col("long_title")), ("on_page", "meta_too_long", "MEDIUM", F.col("long_meta")),
        ("technical", "http_pages", "CRITICAL", F.col("http")), ("technical", "missing_viewport", "CRITICAL", F.col("no_viewport")),
        ("technical", "restrictive_viewport", "HIGH", F.col("locked_viewport")),
        ("performance", "slow_response_time", "HIGH", F.col("slow")), ("performance", "excessive_resource_requests", "HIGH", F.col("heavy")),
        ("performance", "oversized_html", "HIGH", F.col("oversized")), ("performance", "legacy_image_formats", "MEDIUM", F.col("legacy_images")),
        *[("security", f"missing_header:{h}", "CRITICAL" if h == "strict-transport-security" else "HIGH", n - F.col(f"with_{x}")) for h, x in _HEADER_NAMES.items()],
        ("security", "legacy_tls", "CRITICAL", F.col("legacy_tls")),
    ])
    return gaps.unionByName(own)


def gap_list(counts: DataFrame) -> DataFrame:
    """Signals below their threshold, most severe and largest gap first."""
    rank = F.create_map(*[F.lit(x) for pair in L.SEVERITY_RANK.items() for x in pair])
    rows = signal_coverage(counts).where("missing").withColumn("gap", F.round(F.col("threshold_pct") - F.col("coverage_pct"), 1))
    return rows.orderBy(F.element_at(rank, F.col("severity")), F.desc("gap"), "cluster", "signal").drop("missing")


def security_issues(counts: DataFrame) -> DataFrame:
    """Site-wide security issues: unencrypted pages, rare headers, mixed content, weak protocol versions."""
    rules = [
        ("strict-transport-security", "hsts_missing", "HIGH", 80), ("content-security-policy", "csp_missing", "HIGH", 50),
        ("x-frame-options", "x_frame_options_missing", "MEDIUM", 80), ("x-content-type-options", "x_content_type_missing", "MEDIUM", 80),
        ("referrer-policy", "referrer_policy_missing", "HIGH", 80), ("permissions-policy", "permissions_policy_missing", "HIGH", 80),
    ]
    rare = [("security", kind, sev, F.when(_share(f"with_{_HEADER_NAMES[h]}") < least, F.col("n") - F.col(f"with_{_HEADER_NAMES[h]}")).otherwise(0))
            for h, kind, sev, least in rules]
    return _issue_rows(counts, [
        ("security", "http_pages", "CRITICAL", F.col("http")), *rare,
        ("security", "mixed_content", "HIGH", F.col("mixed")), ("security", "weak_tls", "CRITICAL", F.col("weak_tls")),
    ])


def hsts_quality(pages: DataFrame) -> DataFrame:
    """Weak transport security on the first page that sends the header, where at least 80 % of the pages do."""
    sends = PI.has_header("strict-transport-security")
    row = pages.where("not is_error").agg(
        F.avg(sends.cast("int")).alias("share"), F.min_by(F.when(sends, PI.hsts_check()), F.when(sends, F.col("url"))).alias("h"),
        F.min(F.when(sends, F.col("url"))).alias("url"))
    kinds = F.filter(F.array(F.when(F.col("h.max_age") < L.ONE_YEAR, "hsts_weak_max_age"), F.when(~F.col("h.includes_subdomains"), "hsts_no_subdomains")),
                     lambda k: k.isNotNull())
    return row.where("share >= 0.8").select("url", F.explode(kinds).alias("type"))


def security_summary(counts: DataFrame) -> DataFrame:
    cols = [_share(f"with_{x}").alias(f"{x}_pct") for x in _HEADER_NAMES.values()]
    whole = _share("sig_all_security_headers")
    return counts.select(
        *cols, _share("sig_https").alias("https_pct"), whole.alias("all_headers_pct"),
        F.when((whole >= 80) & (F.col("http") == 0), "secure").otherwise("needs_work").alias("status"))


def performance_issues(counts: DataFrame) -> DataFrame:
    c = "performance"
    return _issue_rows(counts, [
        (c, "slow_server_response", "HIGH", F.col("slow")), (c, "cls_risk_undimensioned_images", "MEDIUM", F.col("undimensioned")),
        (c, "lcp_risk_all_images_lazy", "MEDIUM", F.col("all_lazy")), (c, "excessive_resource_requests", "HIGH", F.col("heavy")),
        (c, "oversized_html_response", "HIGH", F.col("oversized")), (c, "legacy_image_formats", "MEDIUM", F.col("legacy_images")),
        (c, "missing_viewport", "HIGH", F.col("no_viewport")),
    ])


def web_vital_status(vitals: DataFrame) -> DataFrame:
    """Band of each measured page: good, needs_improvement or poor, with the values that exceed a threshold."""
    # Thresholds (good, poor) in seconds, shift units and seconds.
    bands = {"lcp_s": (2.5, 4.0), "cls": (0.1, 0.25), "inp_s": (0.2, 0.5)}
    worst = F.greatest(*[F.when(F.col(c) > poor, 2).when(F.col(c) > good, 1).otherwise(0) for c, (good, poor) in bands.items()])
    over = F.filter(F.array(*[F.when(F.col(c) > good, c) for c, (good, _) in bands.items()]), lambda x: x.isNotNull())
    measured = vitals.where("coalesce(lcp_s, cls, inp_s) is not null")
    return measured.select("*", F.when(worst == 2, "poor").when(worst == 1, "needs_improvement").otherwise("good").alias("status"), over.alias("exceeded"))


def web_vital_proxies(pages: DataFrame) -> DataFrame:
    """Estimates from crawl facts for pages that were not measured."""
    rt, dims = F.coalesce("response_time_ms", F.lit(0)), F.col("img_missing_dims")
    return pages.where("not is_error").select(
        "url", F.when(rt < 800, "likely_ok").when(rt < 2500, "at_risk").otherwise("likely_poor").alias("lcp_est"),
        F.when(dims == 0, "likely_ok").when(dims < 3, "at_risk").otherwise("likely_poor").alias("cls_est"), F.lit("unknown").alias("inp_est"))


def performance_summary(counts: DataFrame) -> DataFrame:
    return counts.select(
        F.col("slow").alias("slow_pages"), "timed", F.when(F.col("timed") > 0, F.round(F.col("time_total") / F.col("timed"), 0)).otherwise(0.0).cast("int")
        .alias("avg_response_time_ms"), "undimensioned_total", "legacy_total", "largest_kb")


def consistency(counts_by_check: DataFrame) -> DataFrame:
    """Violations per check (``check``, one row per violation) with their status, checks without any included."""
    found = counts_by_check.groupBy("check").agg(F.count(F.lit(1)).alias("violations"))
    spark = counts_by_check.sparkSession
    names = spark.createDataFrame([(c,) for c in ("sitemap_indexability", "canonical_noindex", "hreflang_reciprocity", "links_status")], "check string")
    out = names.join(found, "check", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    return out.withColumn("status", F.when(F.col("violations") > 0, "issues_found").otherwise("ok"))


def consistency_samples(violations: DataFrame, shown: int = 20) -> DataFrame:
    """The first pages, by URL, of each check (``check, url``): ``check, rank, url``."""
    order = Window.partitionBy("check").orderBy("url")
    return violations.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).select("check", "rank", "url")


def final_score(counts: DataFrame) -> DataFrame:
    """Site score: mean of the capped clusters, at most 90 while there is a critical issue."""
    scores = cluster_scores(counts).agg(
        F.round(F.avg("score"), 0).cast("int").alias("mean"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("capped_at_85"), F.col("cluster")))), ",").alias("capped_clusters"))
    critical = cluster_issues(counts).unionByName(security_issues(counts)).unionByName(performance_issues(counts)).agg(
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_issues"))
    row = scores.unionByName(critical, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("mean", "capped_clusters", "critical_issues")])
    over = (F.col("critical_issues") > 0) & (F.col("mean") > 90)
    score = F.when(over, 90).otherwise(F.col("mean"))
    reason = F.when(over, "capped at 90: critical issues").when(F.col("critical_issues") > 0, "critical issues present").otherwise("")
    return row.select(score.alias("site_score"), site_grade(score).alias("site_grade"), "critical_issues", reason.alias("reason"),
                      "capped_clusters")


def all_issues(counts: DataFrame) -> DataFrame:
    """Cluster, security and performance issues with the layer they come from, in the order the roadmap takes them."""
    return reduce(DataFrame.unionByName, [
        security_issues(counts).withColumn("layer", F.lit("security")), cluster_issues(counts).withColumn("layer", F.lit("cluster")),
        performance_issues(counts).withColumn("layer", F.lit("performance"))])


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy().pivot("severity", list(L.SEVERITY_POINTS)).count().na.fill(0)


def grade_distribution(pages: DataFrame) -> DataFrame:
    scored = TE.with_signal_score(pages.where("not is_error"))
    return scored.groupBy("grade").agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg("page_score"), 1).alias("avg_score"))


def audit_summary(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """Long table of the summary: section, name, value."""
    def long(rows: DataFrame, section: str, name: str, value: str) -> DataFrame:
        return rows.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("name"), F.col(value).cast("bigint").alias("value"))

    sizes = counts.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("name"), c.cast("bigint").alias("value")) for k, c in (
            ("pages_crawled", F.col("pages")), ("pages_analysed", F.col("n")), ("error_pages", F.col("pages") - F.col("n")))])))
    index = pages.select(TE.indexability().alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("value"))
    severity = all_issues(counts).groupBy(F.col("severity").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return reduce(DataFrame.unionByName, [
        long(sizes, "size", "name", "value"), long(index, "indexability", "name", "value"), long(severity, "severity", "name", "value"),
        long(cluster_scores(counts), "cluster_score", "cluster", "score"), long(grade_distribution(pages), "page_grade", "grade", "pages"),
        long(final_score(counts), "final", "site_grade", "site_score")])


def roadmap(counts: DataFrame, cross: DataFrame) -> DataFrame:
    """Actions in four buckets by severity; an action that occurs twice in one bucket is listed once.

    ``cross`` has ``type, severity, pages`` for the checks that compare pages.
    """
    order = {"security": 0, "cluster": 1, "cross": 2, "performance": 3}
    layers = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])
    rows = all_issues(counts).select("layer", "type", "severity", "pages").unionByName(
        cross.select(F.lit("cross").alias("layer"), "type", "severity", "pages"))
    rank = F.create_map(*[F.lit(x) for pair in L.SEVERITY_RANK.items() for x in pair])
    text = F.concat(F.col("pages").cast("string"), F.lit(" pages: "), F.regexp_replace("type", "[_:]", " "))
    rows = rows.select((F.element_at(rank, F.col("severity")) + 1).alias("priority"), text.alias("issue"), "type", "pages", F.element_at(layers, F.col("layer")).alias("_l"))
    first = Window.partitionBy("priority", "type").orderBy("_l", "issue")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("priority", "issue", "pages")
