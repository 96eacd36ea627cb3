"""Page facts from raw HTML: the page record as column expressions over the element stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom import lookups as L
from rankloom.functions import urls as U
from rankloom.functions.scores import let
from rankloom.schema import empty_value, lower_keys, normalise_pages, PAGE_SCHEMA
from rankloom.sources.html_elements import html_elements

# Image formats.
LEGACY_IMAGE = r"(?i)\.(jpe?g|png|gif|bmp|tiff?)(\?|#|$)"
MODERN_IMAGE = r"(?i)\.(webp|avif|jxl)($|\?)"
MIXED = r"""(?i)(?:src|href|action|data|poster)\s*=\s*['"](http://[^'"]{4,})['"]"""
MIXED_SRCSET = r"""(?i)srcset\s*=\s*['"]([^'"]*http://[^'"]+)['"]"""
MIXED_CSS = r"""(?i)url\s*\(\s*['"]?(http://[^)'"]+)['"]?\s*\)"""


def _attr(element: Column, name: str) -> Column:
    return F.coalesce(F.try_element_at(element["attrs"], F.lit(name)), F.lit(""))


def _tags(*names: str) -> Column:
    return F.filter("elements", lambda e: e["tag"].isin(*names))


def _first(values: Column, otherwise: str = "") -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(otherwise))


def _meta(attribute: str, name: str, exact: bool = False) -> Column:
    """Trimmed content of the first meta tag with that name."""
    def match(e: Column) -> Column:
        value = _attr(e, attribute)
        return value.isin(name, name.capitalize()) if exact else F.lower(value) == name

    hits = F.filter(_tags("meta"), match)
    return F.trim(_first(F.transform(hits, lambda e: _attr(e, "content"))))


def resolve(base: Column, ref: Column) -> Column:
    """Absolute form of a reference found on the page ``base``."""
    plain = F.substring_index(F.substring_index(base, "#", 1), "?", 1)
    root = F.substring_index(plain, "/", 3)
    folder = F.when(plain == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(plain, r"[^/]*$", ""))

    def join(r: Column) -> Column:
        return (
            F.when(r == "", F.substring_index(base, "#", 1))
            .when(F.rlike(r, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:")), r)
            .when(F.startswith(r, F.lit("//")), F.concat(F.substring_index(base, "//", 1), r))
            .when(F.startswith(r, F.lit("/")), F.concat(root, r))
            .when(F.startswith(r, F.lit("?")), F.concat(plain, r))
            .when(F.startswith(r, F.lit("#")), F.concat(F.substring_index(base, "#", 1), r))
            .otherwise(F.concat(folder, r))
        )

    return let(let(F.trim(ref), join), _without_dots)


def _without_dots(url: Column) -> Column:
    """Resolve ``.`` and ``..`` path segments where there are any."""
    path = U.path(url)
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when((s == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1))))
        .when(s == "..", acc).otherwise(F.concat(acc, F.array(s))),
    )
    ends = F.rlike(path, F.lit(r"/\.\.?$"))
    clean = F.concat(F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    dotted = F.contains(url, F.lit("/.")) & F.rlike(path, F.lit(r"(^|/)\.\.?(/|$)"))
    return F.when(dotted, F.concat(F.substring_index(url, "/", 3), clean, tail)).otherwise(url)


_SKIP = r"^(#|mailto:|tel:|javascript:)"


def _anchors(base: Column) -> Column:
    """Anchors with a usable reference: ``href`` (absolute), ``text``."""
    usable = F.filter(
        _tags("a"), lambda e: F.map_contains_key(e["attrs"], F.lit("href")) & ~F.rlike(F.trim(_attr(e, "href")), F.lit(_SKIP)))
    return F.transform(usable, lambda e: F.struct(resolve(base, _attr(e, "href")).alias("href"), e["text"].alias("text")))


def link_columns() -> dict[str, Column]:
    """Internal links (first anchor text per address) and external links; needs ``_anchors`` and ``url``."""
    own = U.bare_host(F.col("url"))
    web = F.filter("_anchors", lambda a: F.rlike(a["href"], F.lit("(?i)^https?://")) & (U.bare_host(a["href"]) != ""))
    inside = F.transform(
        F.filter(web, lambda a: U.bare_host(a["href"]) == own),
        lambda a: F.struct(F.regexp_replace(a["href"], "#.*$", "").alias("href"), a["text"].alias("text")))
    numbered = F.array_sort(F.transform(inside, lambda a, i: F.struct(a["href"].alias("href"), i.alias("pos"), a["text"].alias("text"))))
    # Sorted by address and position, the first anchor of an address follows another address.
    unique = let(numbered, lambda s: F.filter(s, lambda a, i: (i == 0) | (F.get(s, i - 1)["href"] != a["href"])))
    in_order = F.array_sort(F.transform(unique, lambda a: F.struct(a["pos"].alias("pos"), a["href"].alias("href"), a["text"].alias("text"))))
    first = F.transform(in_order, lambda a: F.struct(a["href"].alias("href"), a["text"].alias("text")))
    outside = F.transform(F.filter(web, lambda a: U.bare_host(a["href"]) != own), lambda a: a["href"])
    return {"link_objects": first, "external_links": outside}


def image_columns() -> dict[str, Column]:
    """Counts over the images; needs ``_imgs``."""
    def n(test) -> Column:
        return F.size(F.filter("_imgs", test))

    total = F.size("_imgs")
    lazy, srcset = n(lambda e: F.lower(_attr(e, "loading")) == "lazy"), n(lambda e: F.trim(_attr(e, "srcset")) != "")

    def listed(name: str) -> Column:
        values = F.transform("_imgs", lambda e: F.trim(_attr(e, name)))
        return F.filter(values, lambda v: v != "")

    def share(part: Column) -> Column:
        return F.when(total > 0, F.round(100.0 * part / F.greatest(total, F.lit(1)), 1)).otherwise(0.0)

    return {
        "img_total": total, "img_lazy_count": lazy, "img_srcset_count": srcset, "img_lazy_pct": share(lazy),
        "img_srcset_pct": share(srcset), "img_missing_alt": n(lambda e: ~F.map_contains_key(e["attrs"], F.lit("alt"))),
        "img_missing_dims": n(lambda e: (_attr(e, "width") == "") | (_attr(e, "height") == "")),
        "img_alts": listed("alt"), "img_srcs": listed("src"),
        "img_non_modern_count": F.size(F.filter(listed("src"), lambda s: F.rlike(s, F.lit(LEGACY_IMAGE)) & ~F.rlike(s, F.lit(MODERN_IMAGE)))),
    }


def _rel(element: Column) -> Column:
    return F.split(F.lower(F.trim(_attr(element, "rel"))), r"\s+")


def head_link_columns() -> dict[str, Column]:
    """Canonical, language links and pagination from the link tags; needs ``url``."""
    links, base = _tags("link"), F.col("url")

    def first_rel(*names: str) -> Column:
        hits = F.filter(links, lambda e: F.arrays_overlap(_rel(e), F.array(*map(F.lit, names))) & (F.trim(_attr(e, "href")) != ""))
        ref = F.get(F.transform(hits, lambda e: F.trim(_attr(e, "href"))), F.lit(0))
        return F.when(ref.isNotNull(), resolve(base, ref)).otherwise("")

    canonical = F.filter(links, lambda e: F.array_contains(_rel(e), "canonical"))
    ref = F.get(F.transform(canonical, lambda e: _attr(e, "href")), F.lit(0))
    langs = F.filter(
        links, lambda e: F.array_contains(_rel(e), "alternate") & (F.trim(_attr(e, "hreflang")) != "") & (F.trim(_attr(e, "href")) != ""))
    return {
        "canonical": F.when(ref.isNotNull(), resolve(base, ref)).otherwise(""),
        "hreflang_tags": F.transform(langs, lambda e: F.struct(F.trim(_attr(e, "hreflang")).alias("lang"), F.trim(_attr(e, "href")).alias("href"))),
        "pagination_next": first_rel("next"), "pagination_prev": first_rel("prev", "previous"),
    }


def head_columns() -> dict[str, Column]:
    out = {"title": _first(F.transform(_tags("title"), lambda e: e["text"]))}
    for column, name in (("meta_description", "description"), ("meta_keywords", "keywords")):
        out[column] = _meta("name", name, exact=True)
    for column, name in (("og_title", "og:title"), ("og_description", "og:description"), ("og_image", "og:image"), ("og_type", "og:type")):
        out[column] = _meta("property", name)
    for part in ("card", "title", "description", "image"):
        out[f"twitter_{part}"] = _meta("name", f"twitter:{part}")
    out["viewport"] = _meta("name", "viewport")
    out["robots_meta"] = F.lower(_meta("name", "robots"))
    return out


def heading_columns() -> dict[str, Column]:
    headings = F.filter(_tags(*[f"h{i}" for i in range(1, 7)]), lambda e: e["text"] != "")

    def texts(tag: str) -> Column:
        return F.transform(F.filter(headings, lambda e: e["tag"] == tag), lambda e: e["text"])

    out = {tag: texts(tag) for tag in ("h1", "h2", "h3")}
    out["heading_sequence"] = F.transform(
        headings, lambda e: F.struct(F.substring(e["tag"], 2, 1).cast("int").alias("level"), e["text"].alias("text")))
    return out


def robots_columns() -> dict[str, Column]:
    """Robots directives of meta tag and header; needs ``robots_meta`` and ``x_robots_tag``."""
    both = F.concat_ws(" ", "robots_meta", "x_robots_tag")
    header = F.col("x_robots_tag")
    out = {f"robots_{d}": F.contains(both, F.lit(d)) for d in ("noindex", "nofollow")}
    out.update({f"x_robots_{d}": F.rlike(header, F.lit(f"{d}|none")) for d in ("noindex", "nofollow")})
    return out


def resource_count() -> Column:
    def with_src(e: Column) -> Column:
        return F.map_contains_key(e["attrs"], F.lit("src"))

    counted = F.filter(
        "elements",
        lambda e: e["tag"].isin("video", "audio", "img", "source") | (e["tag"].isin("script", "iframe") & with_src(e))
        | ((e["tag"] == "link") & F.array_contains(_rel(e), "stylesheet")))
    return F.size(counted)


def mixed_content(url: Column, html: Column, full: bool = False) -> Column:
    """Sorted distinct http addresses loaded by an https page; ``full`` adds srcset and style references."""
    found = F.regexp_extract_all(html, F.lit(MIXED), F.lit(1))
    if full:
        sets = F.flatten(F.transform(F.regexp_extract_all(html, F.lit(MIXED_SRCSET), F.lit(1)),
                                     lambda s: F.regexp_extract_all(s, F.lit(r"(http://[^\s,]+)"), F.lit(1))))
        found = F.concat(found, sets, F.regexp_extract_all(html, F.lit(MIXED_CSS), F.lit(1)))
    unique = F.array_sort(F.array_distinct(found))
    return F.when(F.startswith(url, F.lit("https://")), unique).otherwise(
        F.array().cast("array<string>"))


# --- structured data --------------------------------------------------------------------------------------------------

def _json_blocks() -> Column:
    scripts = F.filter(_tags("script"), lambda e: F.lower(F.trim(_attr(e, "type"))) == "application/ld+json")
    return F.filter(F.transform(scripts, lambda e: F.trim(e["text"])), lambda t: F.try_parse_json(t).isNotNull())


def _objects(block: Column) -> Column:
    """The objects of one block: those of ``@graph``, else the block itself, as JSON texts."""
    graph = F.get_json_object(block, "$['@graph']")
    return F.when(graph.isNotNull(), F.from_json(graph, "array<string>")).otherwise(F.array(block))


def structured_data_columns() -> dict[str, Column]:
    """Types, property names, rating, author and breadcrumb trail of the structured-data objects; needs ``_objects``."""
    def types_of(o: Column) -> Column:
        kind = F.get_json_object(o, "$['@type']")
        return F.when(F.startswith(kind, F.lit("[")), F.from_json(kind, "array<string>")).when(kind.isNotNull(), F.array(kind)).otherwise(
            F.array().cast("array<string>"))

    typed = F.flatten(
        F.transform("_objects", lambda o: F.transform(types_of(o), lambda t: F.struct(t.alias("type"), F.json_object_keys(o).alias("props")))))

    def first(read) -> Column:
        return F.get(F.filter(F.transform("_objects", read), lambda v: v.isNotNull()), F.lit(0))

    def author(o: Column) -> Column:
        value = F.get_json_object(o, "$.author")
        name = F.coalesce(
            F.get_json_object(o, "$.author.name"), F.get_json_object(o, "$.author[0].name"),
            F.when(F.startswith(value, F.lit("[")), F.get_json_object(o, "$.author[0]")),
            F.when(~F.rlike(value, F.lit(r"^[\[{]")), value))
        return F.when(name != "", name)

    trail = F.flatten(
        F.transform(
            F.filter("_objects", lambda o: F.lower(F.get_json_object(o, "$['@type']")) == "breadcrumblist"),
            lambda o: F.coalesce(F.from_json(F.get_json_object(o, "$.itemListElement"), "array<struct<position:int,name:string,item:string>>"),
                                 F.array().cast("array<struct<position:int,name:string,item:string>>"))))
    return {
        "schema_types": F.transform(typed, lambda t: t["type"]), "schema_objects": typed,
        "schema_rating": first(lambda o: F.get_json_object(o, "$.aggregateRating.ratingValue").try_cast("double")),
        "schema_review_count": first(lambda o: F.coalesce(F.get_json_object(o, "$.aggregateRating.reviewCount"),
                                                          F.get_json_object(o, "$.aggregateRating.ratingCount")).try_cast("int")),
        "schema_author": F.coalesce(first(author), F.lit("")),
        "_trail": F.transform(
            F.array_sort(F.filter(trail, lambda b: F.coalesce(b["name"], F.lit("")) != "")),
            lambda b: F.struct(F.coalesce(b["position"], F.lit(0)).alias("position"), b["name"].alias("name"), F.coalesce(b["item"], F.lit("")).alias("item"))),
    }


def breadcrumb_columns() -> dict[str, Column]:
    """Trail from structured data, else from a navigation list labelled as breadcrumb; needs ``_trail``."""
    in_nav = F.filter("elements", lambda e: F.rlike(F.coalesce(e["nav"], F.lit("")), F.lit("(?i)breadcrumb")))
    items = F.filter(in_nav, lambda e: e["tag"] == "li")
    anchors = F.filter(in_nav, lambda e: (e["tag"] == "a") & e["item"].isNotNull())

    def entry(li: Column, pos: Column) -> Column:
        link = F.get(F.filter(anchors, lambda a: a["item"] == li["item"]), F.lit(0))
        return F.struct((pos + 1).alias("position"), F.coalesce(link["text"], li["text"]).alias("name"),
                        F.coalesce(_attr(link, "href"), F.lit("")).alias("item"))

    listed = F.filter(F.transform(items, entry), lambda b: b["name"] != "")
    trail = F.when(F.size("_trail") > 0, F.col("_trail")).otherwise(listed)
    return {
        "breadcrumbs": trail, "breadcrumb_detected": F.size(trail) > 0,
        "breadcrumb_source": F.when(F.size("_trail") > 0, "json_ld").when(F.size(listed) > 0, "html_nav").otherwise(""),
    }


def extract_pages(raw: DataFrame, max_body: int | None = None) -> DataFrame:
    """Page records from raw pages.

    ``raw`` has ``url`` and ``html`` and may have ``site, status_code, response_headers, redirect_hops, tls_version``.
    The raw text goes to the tokeniser once and is dropped here; ``max_body`` limits the kept body text.
    """
    have = set(raw.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in have else default

    headers = lower_keys(given("response_headers", empty_value(PAGE_SCHEMA["response_headers"].dataType)))
    parsed = raw.select(
        "url", given("site", U.host(F.col("url"))).alias("site"), given("status_code", F.lit(200)).cast("int").alias("status_code"),
        headers.alias("_headers"), given("redirect_hops", F.lit(0)).alias("redirect_hops"), given("tls_version", F.lit("")).alias("tls_version"),
        html_elements(F.col("html")).alias("_p"), mixed_content(F.col("url"), F.col("html")).alias("mixed_resources"),
        F.round(F.octet_length("html") / 1024, 1).alias("html_size_kb"))
    flat = parsed.select("*", "_p.elements", F.col("_p.text").alias("body_text")).drop("_p")
    if max_body is not None:
        flat = flat.withColumn("body_text", F.substring("body_text", 1, max_body))
    flat = flat.withColumns(
        {"_anchors": _anchors(F.col("url")), "_imgs": _tags("img"), "_objects": F.flatten(F.transform(_json_blocks(), _objects)),
         "x_robots_tag": F.lower(F.trim(F.coalesce(F.try_element_at("_headers", F.lit("x-robots-tag")), F.lit("")))),
         "last_modified": F.coalesce(F.try_element_at("_headers", F.lit("last-modified")), F.lit("")),
         "response_headers": F.map_filter("_headers", lambda k, v: k.isin(L.KEPT_HEADERS))})
    facts = flat.withColumns({
        **head_columns(), **head_link_columns(), **heading_columns(), **image_columns(), **link_columns(),
        **structured_data_columns(), "resource_count": resource_count()})
    facts = facts.withColumns({**robots_columns(), **breadcrumb_columns(), "links": F.transform("link_objects", lambda a: a["href"])})
    facts = facts.withColumn("internal_links_count", F.size("links"))
    return normalise_pages(facts.drop("_headers", "_anchors", "_imgs", "_objects", "_trail", "elements"))
