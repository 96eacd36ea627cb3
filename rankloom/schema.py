"""The page record and the entry normaliser."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

STR, INT, DBL, BOOL = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
STRS = T.ArrayType(STR)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_FIELDS: dict[str, T.DataType] = {
    "site": STR,
    "url": STR,
    "status_code": INT,
    "fetch_error": STR,
    "title": STR,
    "meta_description": STR,
    "meta_keywords": STR,
    "canonical": STR,
    "og_title": STR,
    "og_description": STR,
    "og_image": STR,
    "og_type": STR,
    "twitter_card": STR,
    "twitter_title": STR,
    "twitter_description": STR,
    "twitter_image": STR,
    "h1": STRS,
    "h2": STRS,
    "h3": STRS,
    "heading_sequence": T.ArrayType(_struct(level=INT, text=STR)),
    "robots_meta": STR,
    "x_robots_tag": STR,
    "robots_noindex": BOOL,
    "robots_nofollow": BOOL,
    "x_robots_noindex": BOOL,
    "x_robots_nofollow": BOOL,
    "body_text": STR,
    "img_alts": STRS,
    "img_srcs": STRS,
    "img_total": INT,
    "img_lazy_count": INT,
    "img_srcset_count": INT,
    "img_missing_alt": INT,
    "img_missing_dims": INT,
    "img_non_modern_count": INT,
    "img_lazy_pct": DBL,
    "img_srcset_pct": DBL,
    "schema_types": STRS,
    "schema_objects": T.ArrayType(_struct(type=STR, props=STRS)),
    "schema_rating": DBL,
    "schema_review_count": INT,
    "schema_author": STR,
    "breadcrumbs": T.ArrayType(_struct(position=INT, name=STR, item=STR)),
    "breadcrumb_detected": BOOL,
    "breadcrumb_source": STR,
    "external_links": STRS,
    "links": STRS,
    "mixed_resources": STRS,
    "link_objects": T.ArrayType(_struct(href=STR, text=STR)),
    "hreflang_tags": T.ArrayType(_struct(lang=STR, href=STR)),
    "response_headers": T.MapType(STR, STR),
    "last_modified": STR,
    "viewport": STR,
    "tls_version": STR,
    "pagination_next": STR,
    "pagination_prev": STR,
    "redirect_hops": INT,
    "resource_count": INT,
    "crawl_depth": INT,
    "internal_links_count": INT,
    "html_size_kb": DBL,
    "issues": STRS,
    "keywords": STRS,
    "keywords_ngrams": STRS,
    "keywords_scored": T.ArrayType(
        _struct(
            keyword=STR, freq=T.LongType(), importance=STR, score=INT, density=DBL,
            prominent=BOOL, serp_position=INT, expected_ctr=DBL, ctr_tier=STR,
        )
    ),
    "competition": STR,
    "priority": STR,
    "is_error": BOOL,
    "response_time_ms": INT,
}

PAGE_SCHEMA = T.StructType([T.StructField(name, kind) for name, kind in _FIELDS.items()])

# Numbers and texts for which "unknown" differs from zero or empty.
_KEEP_NULL = {
    "status_code", "fetch_error", "schema_rating", "schema_review_count", "response_time_ms", "crawl_depth", "site",
}


def empty_value(kind: T.DataType) -> Column:
    """The value that stands for "missing" in a column of this type."""
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    return F.lit(0).cast(kind)


def normalise_pages(df: DataFrame) -> DataFrame:
    """Complete a page table: absent columns are added, nulls become empty values.

    A page whose fetch failed (no status, or status >= 400) is an error page, loses its links and
    keeps its other columns, so later rules never see a null.
    """
    have = set(df.columns)
    cols = []
    for name, kind in _FIELDS.items():
        if name in ("is_error", "links", "link_objects"):
            continue
        if name not in have:
            value = F.lit(None).cast(kind) if name in _KEEP_NULL else empty_value(kind)
        elif name in _KEEP_NULL:
            value = F.col(name).cast(kind)
        elif name == "response_headers":
            value = lower_keys(F.coalesce(F.col(name), empty_value(kind)))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            value = F.coalesce(F.col(name), empty_value(kind))
        else:
            value = F.coalesce(F.col(name).cast(kind), empty_value(kind))
        cols.append(value.alias(name))
    failed = F.col("status_code").isNull() | (F.col("status_code") >= 400)
    error = F.coalesce(F.col("is_error"), failed) if "is_error" in have else failed
    cols.append(error.alias("is_error"))
    for name in ("links", "link_objects"):
        empty = empty_value(_FIELDS[name])
        value = F.when(error, empty).otherwise(F.coalesce(F.col(name), empty)) if name in have else empty
        cols.append(value.alias(name))
    extra = [F.col(c) for c in df.columns if c not in _FIELDS]
    return df.select(*extra, *cols)


def lower_keys(headers: Column) -> Column:
    """Header names lower-cased; of two spellings of one name the first is kept."""
    keys = F.transform(F.map_keys(headers), F.lower)
    unique = F.array_distinct(keys)
    values = F.transform(unique, lambda k: F.get(F.map_values(headers), F.array_position(keys, k).cast("int") - 1))
    return F.map_from_arrays(unique, values)


def error_record(url: Column, note: Column, site: Column | None = None) -> list[Column]:
    """Columns of the row that stands for a page which could not be fetched."""
    cols = []
    for name, kind in _FIELDS.items():
        if name == "url":
            value = url
        elif name == "site":
            value = site if site is not None else F.lit(None).cast(STR)
        elif name == "title":
            value = note
        elif name == "fetch_error":
            value = note
        elif name == "is_error":
            value = F.lit(True)
        elif name == "competition":
            value = F.lit("Medium")
        elif name in _KEEP_NULL:
            value = F.lit(None).cast(kind)
        else:
            value = empty_value(kind)
        cols.append(value.alias(name))
    return cols
