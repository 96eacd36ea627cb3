"""Result views: filters, searches, cluster views, field fixes, sorting and paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rankloom.functions.scores import labels


def real_pages(pages: DataFrame, only_ok: bool = False) -> DataFrame:
    return pages.where("not is_error and status_code = 200" if only_ok else "not is_error")


def result_filter(pages: DataFrame, with_issues: bool = False, priority: str | None = None,
                  urls: Sequence[str] | None = None) -> DataFrame:
    out = pages.where(F.size("issues") > 0) if with_issues else pages
    out = out.where(F.col("priority") == priority) if priority else out
    return out.where(F.col("url").isin(list(urls))) if urls is not None else out


def text_search(rows: DataFrame, needle: str, columns: Sequence[str], **equal: str) -> DataFrame:
    """Rows that hold the needle in one of the columns, ignoring case, and equal the given values."""
    haystack = F.lower(F.concat_ws(" ", *columns))
    out = rows.where(F.contains(haystack, F.lit(needle.lower())))
    for column, value in equal.items():
        out = out.where(F.col(column) == value)
    return out


# Label patterns of the issue views.
LABEL_VIEWS = {
    "headings": r"(?i)\bh1\b|\bh2\b|heading",
    "canonical": r"(?i)canonical",
    "images": r"(?i)image|alt",
    "content": r"(?i)content|thin|word",
    "links": r"(?i)\blink",
}


def view_conditions() -> dict[str, Column]:
    def any_label(pattern: str) -> Column:
        return F.exists("issues", lambda i: F.rlike(i, F.lit(pattern)))

    out = {
        "all": F.lit(True),
        "title": (F.col("title") == "") | any_label("(?i)title"),
        "meta": (F.col("meta_description") == "") | any_label("(?i)meta"),
    }
    out.update({name: any_label(pattern) for name, pattern in LABEL_VIEWS.items()})
    out["status"] = F.coalesce((F.col("status_code") >= 400) | (F.col("status_code") < 200), F.lit(False))
    return out


def cluster_views(pages: DataFrame) -> DataFrame:
    """Per issue view: pages, clean pages, pages with issues, high priority and health in percent."""
    member = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in view_conditions().items()]), lambda x: x.isNotNull())
    rows = pages.select("issues", "priority", F.explode(member).alias("view"))
    out = rows.groupBy("view").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.size("issues") == 0).alias("clean"),
        F.count_if(F.size("issues") > 0).alias("with_issues"), F.count_if(F.col("priority") == "High").alias("high_priority"))
    return out.withColumn("health", F.round(100.0 * F.col("clean") / F.col("pages"), 0).cast("int"))


def sitemap_rows(sitemap: DataFrame, status: str | None = None, search: str = "") -> DataFrame:
    """Sitemap entries (``url, status_code, lastmod, changefreq``) with their flags, filtered like the sitemap view."""
    code = F.coalesce("status_code", F.lit(200))
    flags = labels(
        F.when(code >= 400, "Error").when(code >= 300, "Redirect"),
        F.when(F.coalesce("lastmod", F.lit("")) == "", "No Lastmod"),
        F.when(F.coalesce("changefreq", F.lit("")) == "", "No Changefreq"),
    )
    tests = {
        "2xx": code.between(200, 299), "3xx": code.between(300, 399), "4xx": code >= 400,
        "no-lastmod": F.coalesce("lastmod", F.lit("")) == "",
    }
    out = sitemap.withColumn("flags", flags)
    out = out.where(tests[status]) if status else out
    return out.where(F.contains(F.lower("url"), F.lit(search.lower()))) if search else out


def sitemap_kpis(sitemap: DataFrame) -> DataFrame:
    live_code, code = F.coalesce("status_code", F.lit(200)), F.coalesce("status_code", F.lit(0))
    row = sitemap.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(live_code.between(200, 299)).alias("live"),
        F.count_if(code.between(300, 399)).alias("redirects"), F.count_if(code >= 400).alias("errors"),
        F.count_if(F.coalesce("lastmod", F.lit("")) == "").alias("no_lastmod"))
    return row.withColumn("live_pct", F.round(100.0 * F.col("live") / F.greatest("total", F.lit(1)), 0).cast("int"))


def worth_rewriting(pages: DataFrame) -> DataFrame:
    """Loaded pages with text and at least one issue."""
    return pages.where("not is_error and status_code = 200").where((F.trim("body_text") != "") & (F.size("issues") > 0))


# --- field fixes ------------------------------------------------------------------------------------------------------

# Light label to field and status.
LABEL_FIELDS = {
    "Missing Title": ("Title", "Missing"),
    "Title Too Long": ("Title", "Too Long"),
    "Title Too Short": ("Title", "Too Short"),
    "Missing Meta Description": ("Meta Description", "Missing"),
    "Duplicate Meta Description": ("Meta Description", "Duplicate"),
    "Meta Description Too Long": ("Meta Description", "Too Long"),
    "Meta Description Too Short": ("Meta Description", "Too Short"),
    "Missing H1": ("H1", "Missing"),
    "Multiple H1 Tags": ("H1", "Multiple"),
    "Missing H2": ("H2", "Missing"),
    "Missing Canonical": ("Canonical", "Missing"),
    "Canonical Mismatch": ("Canonical", "Mismatch"),
}
# Advice per field and status: why it matters and what to do.
FIELD_ADVICE = {
    ("Title", "Missing"): ("Results show a guessed headline", "Write a title", "Blue running shoes for wide feet | Shop", "High"),
    ("Title", "Too Long"): ("The headline is cut off", "Shorten to 60 characters", "Blue running shoes for wide feet | Shop", "Medium"),
    ("Title", "Too Short"): ("The topic stays unclear", "Extend to 30 characters or more", "Shoes becomes Blue running shoes for wide feet", "Medium"),
    ("Meta Description", "Missing"): ("The snippet is picked at random", "Write a description", "Two sentences on what the page offers and for whom", "High"),
    ("Meta Description", "Duplicate"): ("Results cannot be told apart", "Write one description per page", "Name the product or place of the page", "Medium"),
    ("Meta Description", "Too Long"): ("The snippet is cut off", "Shorten to 160 characters", "Keep the offer, drop the list of brands", "Low"),
    ("Meta Description", "Too Short"): ("Snippet space is left unused", "Extend to 120 characters or more", "Add the price, the place or the next step", "Low"),
    ("H1", "Missing"): ("The topic heading is absent", "Add one H1", "Blue running shoes", "High"),
    ("H1", "Multiple"): ("Several headings compete", "Keep one H1", "Turn the second heading into an H2", "Medium"),
    ("H2", "Missing"): ("The text has no sections", "Add H2 headings", "Sizes, Materials, Delivery", "Low"),
    ("Canonical", "Missing"): ("URL variants split the signals", "Name the page itself", "The address of the page without parameters", "Medium"),
    ("Canonical", "Mismatch"): ("The page counts as a copy", "Check the canonical target", "The address of the page unless it is a copy", "Medium"),
}


def _first(column: str, otherwise: str = "") -> Column:
    return F.coalesce(F.get(column, F.lit(0)), F.lit(otherwise))


def _advice() -> Column:
    """Map from ``field/status`` to its advice."""
    names = ("why", "fix", "example", "impact")
    pairs = [x for (f, s), texts in FIELD_ADVICE.items()
             for x in (F.lit(f"{f}/{s}"), F.struct(*[F.lit(t).alias(n) for n, t in zip(names, texts)]))]
    return F.create_map(*pairs)


def field_rows(pages: DataFrame) -> DataFrame:
    """Six rows per page (title, meta, H1, H2, canonical, URL) with value, status and advice."""
    def status(field: str) -> Column:
        out = F.when(F.lit(False), "")
        for label, (f, s) in LABEL_FIELDS.items():
            if f == field:
                out = out.when(F.array_contains("issues", label), s)
        return out.otherwise("OK")

    values = {
        "Title": F.col("title"), "Meta Description": F.col("meta_description"), "H1": _first("h1"),
        "H2": F.array_join(F.slice("h2", 1, 2), " | "), "Canonical": F.col("canonical"), "URL": F.col("url"),
    }
    entries = F.array(
        *[F.struct(F.lit(f).alias("field"), v.alias("current"), status(f).alias("status")) for f, v in values.items()])
    rows = pages.select("url", F.explode(entries).alias("e")).select("url", "e.*")
    advice = F.try_element_at(_advice(), F.concat_ws("/", "field", "status"))
    return rows.select("*", *[F.coalesce(advice[n], F.lit("")).alias(n) for n in ("why", "fix", "example", "impact")])


def optimisation_rows(pages: DataFrame) -> DataFrame:
    """One row per field with an issue: the first label of the field decides."""
    pairs = [x for label, (f, s) in LABEL_FIELDS.items()
             for x in (F.lit(label), F.struct(F.lit(f).alias("field"), F.lit(s).alias("status")))]
    mapped = F.filter(F.transform("issues", lambda i: F.try_element_at(F.create_map(*pairs), i)), lambda m: m.isNotNull())
    fields = F.array_distinct(F.transform(mapped, lambda m: m["field"]))
    firsts = F.transform(fields, lambda f: F.get(F.filter(mapped, lambda m: m["field"] == f), F.lit(0)))
    rows = pages.select("url", "title", "meta_description", "h1", "h2", "canonical", F.explode(firsts).alias("m"))
    field = F.col("m.field")
    value = (
        F.when(field == "Title", F.col("title")).when(field == "Meta Description", F.col("meta_description"))
        .when(field == "H1", _first("h1")).when(field == "H2", _first("h2")).otherwise(F.col("canonical")))
    advice = F.try_element_at(_advice(), F.concat_ws("/", field, F.col("m.status")))
    return rows.select("url", field.alias("field"), F.col("m.status").alias("status"),
                       F.when(value == "", "MISSING").otherwise(value).alias("current_value"), advice["why"].alias("logic"))


# Texts that are placeholders rather than values, and the notice that replaces them.
PLACEHOLDER = (
    r"\[.*?\]|\{.*?\}|<[^>]+>|(?i)\b(insert|your[\s_-]?brand|your[\s_-]?keyword|example\.com|company[\s_-]?name"
    r"|placeholder|todo|tbd)\b"
)
PLACEHOLDER_NOTICE = "Insufficient data: the proposed value was a placeholder"


def without_placeholder(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit(PLACEHOLDER)), PLACEHOLDER_NOTICE).otherwise(value)


def structured_pages(pages: DataFrame, snippet: int = 1000) -> DataFrame:
    """Export projection of a page."""
    return pages.select(
        "url", "title", F.col("meta_description").alias("meta"), _first("h1").alias("h1"), "h2", "h3",
        F.col("keywords_scored").alias("keywords"), "issues", F.substring("body_text", 1, snippet).alias("content_snippet"))


def merge_details(results: DataFrame, details: DataFrame) -> DataFrame:
    """Results with the columns of ``details`` (one row per url) laid over them."""
    over = [c for c in details.columns if c != "url"]
    renamed = details.select("url", F.lit(True).alias("_d"), *[F.col(c).alias(f"_d_{c}") for c in over])
    joined = results.join(renamed, "url", "left")
    keep = [F.col(c) for c in results.columns if c not in over]
    laid = [F.when(F.col("_d"), F.col(f"_d_{c}")).otherwise(F.col(c) if c in results.columns else F.lit(None)).alias(c) for c in over]
    return joined.select(*keep, *laid)


# --- sorting and paging -----------------------------------------------------------------------------------------------

def sorted_by(rows: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Numbers as numbers, arrays by their joined text, ties by URL."""
    kind = rows.schema[column].dataType.typeName()
    key = F.array_join(column, ",") if kind == "array" else F.col(column)
    return rows.orderBy(key.asc() if ascending else key.desc(), "url")


def page_of(rows: DataFrame, order: Sequence[str], limit: int = 0, offset: int = 0) -> DataFrame:
    """``limit`` rows from ``offset`` on; a limit of 0 means all."""
    out = rows.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out


def listing(rows: DataFrame, like: str | None, column: str, newest: str, limit: int, tie: str) -> DataFrame:
    """Newest rows whose column contains a text."""
    out = rows.where(F.contains(F.lower(column), F.lit(like.lower()))) if like else rows
    return out.orderBy(F.desc(newest), tie).limit(limit)


def latest_two(rows: DataFrame, group: str, when: str) -> DataFrame:
    """Newest and second newest value of ``when`` per group, as ``newer`` and ``older``.

    Distinct moments are formed first, so only those reach the ranking.
    """
    moments = rows.select(group, when).distinct()
    order = Window.partitionBy(group).orderBy(F.desc(when))
    ranked = moments.withColumn("_r", F.row_number().over(order)).where("_r <= 2")
    return ranked.groupBy(group).agg(
        F.max(F.when(F.col("_r") == 1, F.col(when))).alias("newer"), F.max(F.when(F.col("_r") == 2, F.col(when))).alias("older"))


