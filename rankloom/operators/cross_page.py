"""Checks that compare pages with each other, with the sitemap and with the robots rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions import text as TX, urls as U
from rankloom.operators.skew import hot_keys, salted_join, with_group_size
from rankloom.session import cut_lineage
from rankloom.sources.tables import kept


def link_rows(pages: DataFrame) -> DataFrame:
    """One row per internal link: ``src``, ``dst``."""
    return pages.select(F.col("url").alias("src"), F.explode("links").alias("dst"))


def keyed_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """Pages by URL without trailing slash, one row per key: of several rows, one whole row, that of the smallest status and values."""
    order = [c for c in ("status_code", *columns) if c in pages.columns]
    best = F.min(F.struct(*dict.fromkeys(order))).alias("_row")
    rows = pages.where("url <> ''").groupBy(U.strip_slash(F.col("url")).alias("key")).agg(best)
    return rows.select("key", *[F.col(f"_row.{c}").alias(c) for c in columns])


def broken_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose target is a page with an error status; a server error is critical."""
    bad = keyed_pages(nodes, "status_code").where("status_code >= 400")
    keyed = links.withColumn("key", U.strip_slash(F.col("dst")))
    hit = salted_join(keyed, bad, ["key"], F.col("src"))
    severity = F.when(F.col("status_code") >= 500, "CRITICAL").otherwise("HIGH")
    return hit.select(
        F.lit("broken_internal_link").alias("type"), severity.alias("severity"), F.col("src").alias("source"),
        F.col("dst").alias("target"), F.col("status_code").alias("status"),
    )


def bad_targets_by_page(links: DataFrame, nodes: DataFrame, shown: int = 20) -> DataFrame:
    """Per source page, the targets with an error status and those reached through several redirects."""
    bad = keyed_pages(nodes, "status_code", "redirect_hops").where("status_code >= 400 or redirect_hops > 1")
    hit = salted_join(links.withColumn("key", U.strip_slash(F.col("dst"))), bad, ["key"], F.col("src"))
    hit = hit.withColumn("kind", F.when(F.col("status_code") >= 400, "broken").otherwise("redirect"))
    counts = hit.groupBy("src", "kind").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("src", "kind").orderBy("key")
    first = hit.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= shown)
    lists = first.groupBy("src", "kind").agg(F.array_sort(F.collect_list("key")).alias("targets"))
    return counts.join(lists, ["src", "kind"])


def widely_linked_dead(links: DataFrame, nodes: DataFrame, more_than: int = 5) -> DataFrame:
    """Error pages linked from more than a few pages."""
    sources = (
        links.select("src", U.strip_slash(F.col("dst")).alias("key")).distinct()
        .groupBy("key").agg(F.count(F.lit(1)).alias("sources")).where(F.col("sources") > more_than)
    )
    bad = keyed_pages(nodes, "status_code").where("status_code >= 400")
    return sources.join(bad, "key").select(F.col("key").alias("url"), F.col("status_code").alias("status"), "sources")


# --- canonical --------------------------------------------------------------------------------------------------------

def canonical_targets(pages: DataFrame) -> DataFrame:
    """``src``, ``nxt``: canonical of each page that names another page (of several rows, the first value)."""
    src, nxt = U.strip_slash(F.col("url")), U.strip_slash(F.trim("canonical"))
    return (
        pages.where((src != "") & (nxt != "") & (src != nxt)).groupBy(src.alias("src")).agg(F.min(nxt).alias("nxt"))
    )


def _ahead(walks: DataFrame, table: DataFrame) -> DataFrame:
    """``walks`` with the state of the page each has reached, in columns with an underscore; null where that page goes nowhere."""
    reached = table.select(F.col("start").alias("target"), *[F.col(c).alias(f"_{c}") for c in ("target", "hops", "least", "state")])
    return salted_join(walks, reached.withColumnRenamed("_target", "_next"), ["target"], F.col("start"), "left")


def _follow(walks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pointer doubling on ``start, target, hops, least, state`` until no walk is open, and the open pointers of each round.

    ``least`` is the smallest page behind the start. A start that finds itself there lies on a loop, whose smallest page it is (its
    state says ``head``); who has such a page behind itself or reaches a loop is on the way into one.
    """
    rounds = []
    while not (open_ := walks.where("state = 'open'")).isEmpty():
        rounds.append(open_.select("start", "target"))
        met = _ahead(open_, walks)
        state = F.when(F.col("_state").isin("head", "loop"), "loop").otherwise(F.coalesce("_state", F.lit("end")))
        met = met.select("start", F.coalesce("_next", "target").alias("target"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
                         F.least("least", "_least").alias("least"), state.alias("state"))
        met = met.withColumn("state", F.when((F.col("state") == "open") & (F.col("least") == F.col("start")), "head").otherwise(F.col("state")))
        walks = cut_lineage(walks.where("state <> 'open'").unionByName(met))
        heads = walks.where("state = 'head'").select(F.col("start").alias("least"), F.lit(True).alias("_on"))
        if not heads.isEmpty():
            found = salted_join(walks.where("state = 'open'"), heads, ["least"], F.col("start"), "left")
            found = found.withColumn("state", F.when(F.col("_on"), "loop").otherwise("open")).select(*walks.columns)
            walks = cut_lineage(walks.where("state <> 'open'").unionByName(found))
    return walks, rounds


def _loop_hops(steps: DataFrame, loops: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """``start, hops``: pages met before the first one is met again, for each walk into a loop."""
    on = loops.where("state = 'head'").select("start", F.col("start").alias("head"))
    # the pointers of the rounds lead from the smallest page of each loop over all its pages
    for table in rounds:
        more = on.join(table, "start").select(F.col("target").alias("start"), "head")
        on = cut_lineage(on.unionByName(more).distinct())
    length = on.groupBy("head").agg(F.count(F.lit(1)).cast("int").alias("length"))
    members = cut_lineage(on.join(length, "head").select("start", "length"))
    tails = steps.join(loops.select("start"), "start", "left_semi").join(members, "start", "left_anti")
    entered = members.select(F.col("start").alias("nxt"), F.lit("end").alias("_in"))
    tails = salted_join(tails, entered, ["nxt"], F.col("start"), "left")
    tails, _ = _follow(cut_lineage(tails.select("start", F.col("nxt").alias("target"), F.lit(1).alias("hops"), F.col("nxt").alias("least"), F.coalesce("_in", F.lit("open")).alias("state"))))
    ahead = members.select(F.col("start").alias("target"), "length")
    return members.select("start", F.col("length").alias("hops")).unionByName(
        salted_join(tails, ahead, ["target"], F.col("start")).select("start", (F.col("hops") + F.col("length")).alias("hops")))


def canonical_walks(pages: DataFrame) -> DataFrame:
    """Follow the canonical of every page that names another one: ``start, last, hops, state, is_head``.

    ``state``: ``end`` (``last`` names itself or none), ``left`` (``last`` is not crawled) or ``loop`` (``hops`` are the pages met before one is met
    again); ``is_head`` marks the smallest page of a loop. Each round doubles the steps of an open walk, so n pages take about log2(n) rounds,
    and a walk is one row of fixed size whatever its length.
    """
    known = pages.where("url <> ''").select(U.strip_slash(F.col("url")).alias("nxt")).distinct().withColumn("_known", F.lit(True))
    steps = cut_lineage(salted_join(canonical_targets(pages), known, ["nxt"], F.col("src"), "left").withColumnRenamed("src", "start"))
    state = F.when(F.col("_known").isNull(), "left").otherwise("open")
    walks, rounds = _follow(steps.select("start", F.col("nxt").alias("target"), F.lit(1).alias("hops"), F.col("nxt").alias("least"), state.alias("state")))
    loops = walks.where("state in ('head', 'loop')")
    rows = walks.where("state not in ('head', 'loop')").select("start", F.col("target").alias("last"), "hops", "state", F.lit(False).alias("is_head"))
    if loops.isEmpty():
        return rows
    turned = _loop_hops(steps, loops, rounds)
    return rows.unionByName(loops.join(turned.withColumnRenamed("hops", "_hops"), "start").select(
        "start", F.col("target").alias("last"), F.col("_hops").alias("hops"), F.lit("loop").alias("state"), (F.col("state") == "head").alias("is_head")))


def canonical_paths(pages: DataFrame, shown: int) -> DataFrame:
    """``start, path``: each page that names another one and the next pages on its walk, ``shown`` or a few more steps, at most twice as many."""
    paths = canonical_targets(pages).select(F.col("src").alias("start"), F.array("src", "nxt").alias("path"))
    steps = 1
    while steps < shown:
        ahead = paths.select(F.col("start").alias("cur"), F.slice("path", 2, steps).alias("_more"))
        rows = salted_join(paths.withColumn("cur", F.element_at("path", -1)), ahead, ["cur"], F.col("start"), "left")
        paths = cut_lineage(rows.select("start", F.concat("path", F.coalesce("_more", F.array().cast("array<string>"))).alias("path")))
        steps *= 2
    return paths


def canonical_problems(pages: DataFrame, shown: int = 64) -> DataFrame:
    """Canonical loops and chains of two hops or more, one row per start page.

    A walk that leaves the crawled pages ends before the unknown page. ``hops`` counts the whole walk, ``path`` lists its first ``shown`` hops.
    ``is_head`` marks one page of each loop.
    """
    walks = canonical_walks(pages).withColumn("hops", F.col("hops") - (F.col("state") == "left").cast("int"))
    loop = F.col("state") == "loop"
    rows = walks.where(loop | (F.col("hops") > 1)).join(canonical_paths(pages, shown), "start")
    return rows.select(
        F.when(loop, "canonical_loop").otherwise("canonical_chain").alias("type"),
        F.when(loop, "CRITICAL").otherwise("HIGH").alias("severity"),
        F.col("start").alias("url"), F.slice("path", 1, F.least(F.col("hops"), F.lit(shown)) + 1).alias("path"), "hops", "is_head",
    )


def canonical_status(pages: DataFrame, max_hops: int = 5) -> DataFrame:
    """Per page the outcome of its canonical chain: ok, self, loop, broken_target, or too_deep if it is not known after ``max_hops`` pages.

    ``length`` counts the pages looked at.
    """
    walks = canonical_walks(pages).select(F.col("start").alias("key"), "hops", "state")
    deep = F.col("hops") - (F.col("state") == "loop").cast("int") >= max_hops
    base = pages.select("url", U.strip_slash(F.col("url")).alias("key"), U.strip_slash(F.trim("canonical")).alias("_c"))
    state = (
        F.when(deep, "too_deep").when(F.col("state") == "loop", "loop").when(F.col("state") == "left", "broken_target")
        .when(F.col("state") == "end", "ok").when(F.col("_c") == F.col("key"), "self").otherwise("ok")
    )
    length = F.when(deep, F.lit(max_hops)).otherwise(F.coalesce("hops", F.lit(0))) + 1
    return base.join(walks, "key", "left").select("url", state.alias("status"), length.alias("length"))


def canonical_bad_target(pages: DataFrame, crawled: DataFrame | None = None) -> DataFrame:
    """Canonicals that point to a page, of ``crawled``, which is kept out of the index or returns an error."""
    meta = F.contains(F.lower("robots_meta"), F.lit("noindex"))
    noindex = meta | F.col("robots_noindex") | F.contains(F.lower("x_robots_tag"), F.lit("noindex"))
    targets = (
        (pages if crawled is None else crawled).groupBy(U.match_key(F.col("url")).alias("target"))
        .agg(F.bool_or(noindex).alias("noindex"), F.max("status_code").alias("status"))
        .where("noindex or status >= 400")
    )
    rows = pages.select("url", U.match_key(F.col("canonical")).alias("target")).where(
        (F.col("target") != "") & (F.col("target") != U.match_key(F.col("url")))
    )
    hit = salted_join(rows, targets, ["target"], F.col("url"))
    kinds = F.filter(
        F.array(F.when(F.col("noindex"), "canonical_to_noindex"), F.when(F.col("status") >= 400, "canonical_to_error_page")),
        lambda k: k.isNotNull(),
    )
    return hit.select("url", "target", F.explode(kinds).alias("type"))


def canonical_and_noindex(pages: DataFrame) -> DataFrame:
    """Pages that name another page as canonical and are kept out of the index."""
    canonical, url = U.strip_slash(F.col("canonical")), U.strip_slash(F.col("url"))
    noindex = F.col("robots_noindex") | F.contains(F.lower("robots_meta"), F.lit("noindex")) | F.contains(
        F.lower("x_robots_tag"), F.lit("noindex"))
    return pages.where((canonical != "") & (canonical != url) & noindex).select(url.alias("url"), canonical.alias("canonical"))


# --- hreflang ---------------------------------------------------------------------------------------------------------

def hreflang_rows(pages: DataFrame) -> DataFrame:
    """One row per language link: ``src``, ``lang``, ``dst``."""
    tags = pages.select(U.strip_slash(F.col("url")).alias("src"), F.explode("hreflang_tags").alias("t"))
    return tags.select("src", F.col("t.lang").alias("lang"), U.strip_slash(F.col("t.href")).alias("dst")).where("dst <> ''")


def hreflang_not_returned(pages: DataFrame, direct: bool = False) -> DataFrame:
    """Language links to a crawled page that has no link back.

    ``direct``: ignore ``x-default``, keep links to the page itself and to pages that were not crawled.
    """
    tags = hreflang_rows(pages)
    back = tags.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    if direct:
        return tags.where("lang <> 'x-default'").join(back, ["src", "dst"], "left_anti").select("src", "lang", "dst")
    known = pages.select(U.strip_slash(F.col("url")).alias("dst")).distinct()
    away = salted_join(tags.where("src <> dst"), known, ["dst"], F.col("src"), "left_semi")
    return away.join(back, ["src", "dst"], "left_anti").select("src", "lang", "dst")


def hreflang_without_default(pages: DataFrame) -> DataFrame:
    """Pages with language links but no ``x-default`` among them."""
    langs = F.transform("hreflang_tags", lambda t: F.lower(t["lang"]))
    rows = pages.where((F.size("hreflang_tags") > 0) & ~F.array_contains(langs, "x-default"))
    return rows.select("url", F.size(F.array_distinct(langs)).alias("languages"))


def hreflang_not_canonical(pages: DataFrame) -> DataFrame:
    """Language links to a crawled page that names another page as canonical."""
    targets = keyed_pages(pages.withColumn("canonical", U.strip_slash(F.col("canonical"))), "canonical")
    targets = targets.where("canonical <> '' and canonical <> key").withColumnRenamed("key", "dst")
    return salted_join(hreflang_rows(pages), targets, ["dst"], F.col("src")).select("src", "lang", "dst", "canonical")


# --- pagination, orphans, sitemap, robots -----------------------------------------------------------------------------

def pagination_breaks(pages: DataFrame) -> DataFrame:
    """Broken sequences: next page unknown, next page without a link back, previous page unknown."""
    known = keyed_pages(pages, "pagination_prev")
    rows = pages.where("not is_error").select(
        U.strip_slash(F.col("url")).alias("source"), U.strip_slash(F.trim("pagination_next")).alias("nxt"),
        U.strip_slash(F.trim("pagination_prev")).alias("prv"),
    ).where("nxt <> '' or prv <> ''")
    forward = known.select(F.col("key").alias("nxt"), U.strip_slash(F.trim("pagination_prev")).alias("back"), F.lit(True).alias("has_next"))
    backward = known.select(F.col("key").alias("prv"), F.lit(True).alias("has_prev"))
    ahead = salted_join(rows, forward, ["nxt"], F.col("source"), "left")
    joined = salted_join(ahead, backward, ["prv"], F.col("source"), "left", hot=hot_keys(rows, ["prv"]))
    lost_next = (F.col("nxt") != "") & F.col("has_next").isNull()
    no_return = (F.col("nxt") != "") & F.col("has_next") & (F.col("back") != F.col("source"))
    lost_prev = ~lost_next & (F.col("prv") != "") & F.col("has_prev").isNull()

    def case(condition, kind, severity, target):
        return F.when(condition, F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), target.alias("target")))

    cases = F.array(
        case(lost_next, "pagination_next_not_crawled", "HIGH", F.col("nxt")),
        case(no_return, "pagination_missing_reciprocal", "HIGH", F.col("nxt")),
        case(lost_prev, "pagination_prev_not_crawled", "MEDIUM", F.col("prv")),
    )
    return joined.select("source", F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c")).select(
        "c.type", "c.severity", "source", "c.target"
    )


def orphan_pages(pages: DataFrame) -> DataFrame:
    """Pages no crawled page links to; error pages and the page with most links of each site are left out."""
    linked = link_rows(pages).select(U.strip_slash(F.col("dst")).alias("key")).distinct()
    first = F.min(F.struct((-F.size("links")).alias("n"), F.col("url").alias("u")))
    root = pages.groupBy("site").agg(first.alias("_f")).select(U.strip_slash(F.col("_f.u")).alias("key"))
    rows = pages.where("not is_error").select(U.strip_slash(F.col("url")).alias("key"))
    alone = rows.join(linked, "key", "left_anti").join(root, "key", "left_anti")
    return alone.select(F.col("key").alias("url"))


def sitemap_conflicts(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Differences between the sitemap (``url``) and the crawl, one row per URL and kind."""
    meta = F.contains(F.lower("robots_meta"), F.lit("noindex"))
    crawled = pages.groupBy(U.strip_slash(F.col("url")).alias("key")).agg(
        F.bool_or(F.col("robots_noindex") | meta).alias("noindex"),
        F.bool_or(F.col("is_error") | (F.col("status_code") >= 400)).alias("error"),
        F.bool_or(~F.col("is_error")).alias("loaded"),
    )
    listed = sitemap.select(U.strip_slash(F.col("url")).alias("key")).where("key <> ''").distinct().withColumn("listed", F.lit(True))
    both = crawled.join(listed, "key", "full_outer")
    in_map = F.coalesce("listed", F.lit(False))
    kinds = [
        ("sitemap_noindex", "CRITICAL", in_map & F.col("noindex")),
        ("sitemap_error_page", "CRITICAL", in_map & F.col("error")),
        ("sitemap_missing", "MEDIUM", in_map & ~F.coalesce("loaded", F.lit(False))),
        ("not_in_sitemap", "LOW", ~in_map),
    ]
    cases = F.array(*[F.when(c, F.struct(F.lit(k).alias("type"), F.lit(s).alias("severity"))) for k, s, c in kinds])
    return both.select(F.col("key").alias("url"), F.explode(F.filter(cases, lambda c: c.isNotNull())).alias("c")).select(
        "url", "c.type", "c.severity"
    )


def robots_blocked(pages: DataFrame, rules: DataFrame, sitemap: DataFrame | None = None) -> DataFrame:
    """Pages whose path starts with a Disallow rule of their site, with the first rule that matches.

    ``rules`` has ``site``, ``pos``, ``path``. The rules of one site are those of one robots file, so they are kept
    as one array per site, and the pages of a large site are spread.
    """
    per_site = rules.where("path <> ''").groupBy("site").agg(
        F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("rules")
    )
    path = F.when(U.path(F.col("url")) == "", "/").otherwise(U.path(F.col("url")))
    rows = pages.select("site", "url", path.alias("path"))
    joined = salted_join(rows, per_site, ["site"], F.col("url"))
    match = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    hit = joined.withColumn("rule", match["path"]).where("rule is not null")
    if sitemap is None:
        return hit.select("site", "url", "path", "rule")
    listed = sitemap.select(U.match_key(F.col("url")).alias("key")).distinct().withColumn("in_sitemap", F.lit(True))
    return (
        hit.withColumn("key", U.match_key(F.col("url"))).join(listed, "key", "left")
        .select("site", "url", "path", "rule", F.coalesce("in_sitemap", F.lit(False)).alias("in_sitemap"))
    )


# --- duplicates -------------------------------------------------------------------------------------------------------

def _shared(keyed: DataFrame, by: Sequence[str]) -> DataFrame:
    return with_group_size(keyed, "key", F.col("url"), by=by).where("n_rows is not null").select("key", "url", "n_rows")


def duplicate_titles(pages: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    """Pages that share their title with another one within ``by`` (the crawl of a site): ``key``, ``url``, ``n_rows``."""
    return _shared(pages.where("not is_error").select("url", *by, F.lower(F.trim("title")).alias("key")), by)


def duplicate_descriptions(pages: DataFrame, by: Sequence[str] = ("site",)) -> DataFrame:
    return _shared(pages.where("not is_error").select("url", *by, F.lower(F.trim("meta_description")).alias("key")), by)


def duplicate_content(pages: DataFrame, min_words: int = 50, by: Sequence[str] = ("site",)) -> DataFrame:
    """Pages with the same body text, byte for byte. The texts are read once; counts and join work on the stored keys."""
    body = TX.strip(F.col("body_text"))
    hashed = pages.where("not is_error").where(TX.word_count(F.col("body_text")) >= min_words).select(
        "url", *by, F.md5(body.cast("binary")).alias("key"))
    return _shared(kept(hashed, "content-keys"), by)


def cross_issue_union(*parts: DataFrame) -> DataFrame:
    """Issue tables with different columns as one table."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
