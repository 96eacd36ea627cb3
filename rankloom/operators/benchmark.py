"""Competitor benchmark: seven scores per site, composite, matrix and actions. All sites are rows of one page table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rankloom import lookups as L
from rankloom.functions import text as TX, urls as U
from rankloom.operators import technical as TE


def loaded(pages: DataFrame) -> DataFrame:
    return pages.where("status_code = 200")


def _points(*rules: tuple[Column, float]) -> Column:
    return sum((F.when(c, p).otherwise(0) for c, p in rules), F.lit(0))


def _steps(value: Column, *steps: tuple[float, float]) -> Column:
    out = F.when(value >= steps[0][0], steps[0][1])
    for bound, points in steps[1:]:
        out = out.when(value >= bound, points)
    return out.otherwise(0)


def on_page_scores(pages: DataFrame) -> DataFrame:
    """Best page of each site."""
    n_title, n_meta = F.length("title"), F.length("meta_description")
    score = _points(
        (n_title > 0, 15), (n_title.between(50, 60), 10), (n_meta > 0, 15), (n_meta.between(120, 155), 10), (F.size("h1") > 0, 15),
        (F.size("h2") > 0, 10), (F.col("canonical") != "", 10), (F.size("issues") == 0, 15))
    return loaded(pages).groupBy("site").agg(F.max(score).cast("double").alias("on_page"))


def words_or_estimate() -> Column:
    """Words of the body, or of title, description and headings where there is none."""
    rest = F.concat_ws(" ", "title", "meta_description", F.array_join("h1", " "), F.array_join("h2", " "))
    return TX.word_count(F.when(F.col("body_text") != "", F.col("body_text")).otherwise(rest))


def content_scores(pages: DataFrame) -> DataFrame:
    """Mean depth points of the pages: words, headings, sentence length."""
    body, h2, h3 = F.col("body_text"), F.size("h2"), F.size("h3")
    sentences = F.filter(F.split(body, "[.!?]"), lambda s: TX.strip(s) != "")
    mean = F.aggregate(sentences, F.lit(0), lambda a, s: a + TX.word_count(s)) / F.greatest(F.size(sentences), F.lit(1))
    words = F.col("_words")
    score = (
        _steps(words, (1500, 30), (800, 20), (300, 10), (1, 5)) + _steps(h2, (4, 20), (2, 12), (1, 6)) + _steps(h3, (3, 15), (1, 8))
        + F.when(body != "", F.when(mean <= 18, 20).when(mean <= 25, 12).otherwise(5) + 15).otherwise(0))
    rows = loaded(pages).withColumn("_words", words_or_estimate())
    return rows.groupBy("site").agg(F.round(F.avg(F.least(score, F.lit(100))), 1).alias("content"))


def trust_scores(pages: DataFrame, authority: DataFrame | None = None) -> DataFrame:
    """Trust signals of each site from the addresses, texts, structured data and links of its pages.

    ``authority`` has ``site`` and ``authority`` (0 to 10) and adds up to 17 points.
    """
    url = F.lower("url")

    def named(pattern: str) -> Column:
        return F.bool_or(F.rlike(url, F.lit(pattern)))

    text = F.lower(F.when(F.col("body_text") != "", F.col("body_text")).otherwise(F.col("title")))
    links = F.transform("external_links", F.lower)
    hosts = "|".join(d.replace(".", r"\.") for d in L.AUTHORITY_DOMAINS)
    tlds = "|".join(t.replace(".", r"\.") for t in L.AUTHORITY_TLDS)
    rows = loaded(pages).withColumn("_words", words_or_estimate()).groupBy("site").agg(
        named("about").alias("about"), named("contact").alias("contact"), named("privacy|policy").alias("privacy"),
        named("team|people|staff|author").alias("team"), F.bool_or(F.startswith(url, F.lit("https://"))).alias("https"), F.avg("_words").alias("words"),
        F.bool_or(F.rlike(text, F.lit("author|written by|contributor|byline"))).alias("byline"),
        F.bool_or((F.col("schema_author") != "") | F.contains(text, F.lit('itemprop="author"'))).alias("author"),
        F.bool_or(F.col("schema_rating").isNotNull() | F.col("schema_review_count").isNotNull() | F.contains(text, F.lit('itemprop="ratingvalue"'))).alias("review"),
        F.coalesce(F.avg("schema_rating") >= 4.0, F.lit(False)).alias("high_rating"),
        F.bool_or(F.exists(links, lambda u: F.rlike(u, F.lit(hosts)))).alias("cited"), F.bool_or(F.exists(links, lambda u: F.rlike(u, F.lit(tlds)))).alias("academic"))
    bonus = F.lit(0.0)
    if authority is not None:
        rows = rows.join(authority, "site", "left")
        bonus = F.when(F.col("authority").between(0, 10), F.round(F.col("authority") * 1.7, 1)).otherwise(0.0)
    score = _points(
        (F.col("about"), 10), (F.col("contact"), 10), (F.col("privacy"), 8), (F.col("team"), 8), (F.col("https"), 8), (F.col("byline"), 10),
        (F.col("author"), 10), (F.col("review"), 8), (F.col("high_rating"), 5), (F.col("cited"), 7), (F.col("academic"), 8), (F.col("words") >= 1000, 8))
    return rows.select("site", F.least(F.round(score + bonus, 1), F.lit(100.0)).alias("eeat"))


def ctr_scores(pages: DataFrame, year: int) -> DataFrame:
    """Best of the titled pages: length, power word, digit, year, brackets, question, call to action."""
    title, meta = F.trim("title"), F.trim("meta_description")
    low, n_title, n_meta = F.lower(title), F.length(title), F.length(meta)
    power = F.arrays_overlap(TX.words(low), F.array(*map(F.lit, L.POWER_WORDS)))
    question = F.endswith(title, F.lit("?")) | F.rlike(low, F.lit(L.QUESTION_START))
    score = (
        F.when(n_title.between(50, 60), 20).when(n_title.between(40, 70), 12).when(n_title > 0, 5).otherwise(0)
        + _points((power, 15), (F.rlike(title, F.lit(r"\d")), 15), (F.rlike(title, F.lit(f"{year}|{year - 1}")), 10),
                  (F.rlike(title, F.lit(r"[\[(].{1,20}[\])]")), 10), (question, 8), (TX.any_phrase(F.lower(meta), L.CTA_WORDS), 20))
        + F.when(n_meta.between(120, 155), 20).when(n_meta.between(100, 170), 12).when(n_meta > 0, 5).otherwise(0))
    return loaded(pages).where("title <> ''").groupBy("site").agg(F.least(F.max(score), F.lit(100)).cast("double").alias("ctr"))


def keyword_scores(pages: DataFrame) -> DataFrame:
    """Breadth of the keywords, share of pages with keywords and with an important one.

    Distinct keywords are counted from distinct pairs, page shares from the pages, so no site gathers its keywords.
    """
    ok = loaded(pages)
    kinds = ok.select("site", F.explode("keywords").alias("k")).where("k <> ''").select("site", F.lower("k").alias("k")).distinct()
    counts = kinds.groupBy("site").agg(F.count(F.lit(1)).alias("_n"))
    important = F.exists("keywords_scored", lambda k: k["importance"] == "HIGH")
    shares = ok.groupBy("site").agg(F.avg((F.size("keywords") > 0).cast("int")).alias("_a"), F.avg(important.cast("int")).alias("_h"))
    score = _steps(F.coalesce("_n", F.lit(0)), (50, 40), (20, 30), (10, 20), (5, 10)) + 30 * F.col("_a") + 30 * F.col("_h")
    return shares.join(counts, "site", "left").select("site", F.least(F.round(score, 1), F.lit(100.0)).alias("keywords"))


def speed_score() -> Column:
    """Performance score, or a neutral 50 moved by paint time and layout shift."""
    lcp, cls = F.col("lcp_ms"), F.col("cls")
    guess = (
        50.0 + F.when(lcp < 2500, 20).when(lcp < 4000, 5).when(lcp.isNotNull(), -20).otherwise(0)
        + F.when(cls < 0.1, 10).when(cls < 0.25, 0).when(cls.isNotNull(), -10).otherwise(0))
    return F.coalesce(F.col("perf_score"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), guess)))


def speed_scores(reports: DataFrame) -> DataFrame:
    """Mean speed score per site (``site, perf_score, lcp_ms, cls``)."""
    return reports.groupBy("site").agg(F.round(F.avg(speed_score()), 1).alias("page_speed"))


def technical_scores(pages: DataFrame) -> DataFrame:
    """Mean technical score of the pages."""
    rows = loaded(pages)
    return TE.audit_pages(rows, parts=[]).groupBy("site").agg(F.round(F.avg("tech_score"), 1).alias("technical"))


def scores_from_report(reports: DataFrame) -> DataFrame:
    """All seven scores from the audits of a page-speed report (``url, seo_score, perf_score, audits``)."""
    def ok(audit: str) -> Column:
        return F.coalesce(F.try_element_at("audits", F.lit(audit))["score"] == 1, F.lit(False))

    seo = F.coalesce("seo_score", F.lit(0.0))
    dom = F.coalesce(F.try_element_at("audits", F.lit("dom-size"))["numericValue"], F.lit(0.0))
    tld = F.concat(F.lit("."), F.substring_index(U.host(F.col("url")), ".", -1))
    titled, described = (ok("document-title"), 25), (ok("meta-description"), 25)
    dims = {
        "technical": _points((ok("is-crawlable"), 25), (ok("robots-txt"), 20), (ok("canonical"), 20), (ok("structured-data"), 20), (ok("hreflang"), 10), (ok("plugins"), 5)),
        "on_page": _points(titled, described, (ok("heading-order"), 20), (ok("link-text"), 15), (ok("image-alt"), 10), (ok("crawlable-anchors"), 5)),
        "content": 15 + _steps(dom, (3000, 40), (1500, 30), (600, 15), (200, 5)) + _points((ok("font-size"), 15), (ok("tap-targets"), 10), (ok("heading-order"), 10)),
        "eeat": 15 + _points((tld.isin(L.AUTHORITY_TLDS), 35), (ok("structured-data"), 20), (ok("document-title"), 10), (ok("meta-description"), 10))
        + F.least(seo * 0.10, F.lit(10.0)),
        "ctr": _points((ok("document-title"), 35), (ok("meta-description"), 35)) + F.least(seo * 0.30, F.lit(30.0)),
        "keywords": F.least(_points(titled, described) + F.least(seo * 0.20, F.lit(20.0)), F.lit(70.0)),
        "page_speed": F.coalesce("perf_score", F.lit(0.0)),
    }
    return reports.select("url", *[F.round(F.least(v.cast("double"), F.lit(100.0)), 1).alias(k) for k, v in dims.items()])


def weighted_sum() -> Column:
    """Weighted sum of the seven scores; a missing score counts as 0."""
    return sum((F.coalesce(F.col(d), F.lit(0.0)) * w for d, w in L.DIMENSION_WEIGHTS.items()), F.lit(0.0))


def with_composite(scores: DataFrame) -> DataFrame:
    return scores.withColumn("composite", F.round(weighted_sum(), 1))


def dimension_matrix(scores: DataFrame) -> DataFrame:
    """Long form: ``site, dimension, score``."""
    filled = scores.select("site", *[F.coalesce(F.col(d).cast("double"), F.lit(0.0)).alias(d) for d in L.DIMENSION_WEIGHTS])
    return filled.unpivot(["site"], list(L.DIMENSION_WEIGHTS), "dimension", "score")


def action_list(scores: DataFrame, target: str, k: int = 5) -> DataFrame:
    """Dimensions in which the mean competitor leads the target by more than 5 points, largest lead first."""
    rows = dimension_matrix(scores)
    own = F.col("site") == target
    gaps = rows.groupBy("dimension").agg(F.max(F.when(own, F.col("score"))).alias("_t"), F.avg(F.when(~own, F.col("score"))).alias("_c"))
    gap = F.coalesce("_c", F.lit(0.0)) - F.coalesce("_t", F.lit(0.0))
    out = gaps.withColumn("_g", gap).where("_g > 5")
    out = out.select(
        "dimension", F.round(F.coalesce("_t", F.lit(0.0)), 1).alias("target_score"), F.round("_c", 1).alias("avg_competitor_score"), F.round("_g", 1).alias("gap"),
        F.when(F.col("_g") >= 20, "High").when(F.col("_g") >= 10, "Medium").otherwise("Low").alias("priority"))
    return out.orderBy(F.desc("gap"), "dimension").limit(k)


def site_scores(pages: DataFrame, speed: DataFrame, authority: DataFrame | None, year: int) -> DataFrame:
    """One row per site with its seven scores; sites without loaded pages keep what is known."""
    parts = [
        technical_scores(pages), on_page_scores(pages), content_scores(pages), trust_scores(pages, authority), ctr_scores(pages, year),
        keyword_scores(pages), speed_scores(speed)]
    return reduce(lambda a, b: a.join(b, "site", "full_outer"), parts)
