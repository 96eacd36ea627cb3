"""Structured-data blocks of raw pages and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom import lookups as L
from rankloom.functions.scores import labels

BLOCK = r"""(?is)<script[^>]+type=["']application/ld\+json["'][^>]*>(.*?)</script>"""


def blocks(pages: DataFrame) -> DataFrame:
    """``url, block, pos, json, error``: objects of each block; a list gives one row per entry, a bad block one error row."""
    raw = F.transform(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(1)), lambda b: F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")))
    rows = pages.select("url", F.posexplode(raw).alias("block", "raw"))
    valid = F.try_parse_json("raw").isNotNull()
    listed = F.when(valid & F.startswith("raw", F.lit("[")), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    out = rows.select("url", "block", valid.alias("_valid"), F.posexplode(listed).alias("pos", "json"))
    return out.select("url", "block", "pos", F.when(F.col("_valid"), F.col("json")).alias("json"),
                      F.when(~F.col("_valid"), F.substring("json", 1, 300)).alias("error"))


def _read(name: str, json: str = "json") -> Column:
    return F.get_json_object(json, f"$['{name}']")


def unfold_graphs(objects: DataFrame) -> DataFrame:
    """Objects with those that only wrap a graph replaced by the graph's entries."""
    graph = _read("@graph")
    parts = F.when(_read("@type").isNull() & graph.isNotNull(), F.from_json(graph, "array<string>")).otherwise(F.array("json"))
    rows = objects.select("url", "block", "pos", "error", F.posexplode(F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("string")))
                          .otherwise(parts)).alias("entry", "json"))
    return rows.select("url", "block", "pos", "entry", "json", "error")


def validate_blocks(objects: DataFrame) -> DataFrame:
    """Type, issues and warnings of every object: missing fields, type and context, risky types."""
    kind, context = _read("@type"), _read("@context")
    rows = unfold_graphs(objects).withColumn(
        "_types", F.when(F.startswith(kind, F.lit("[")), F.from_json(kind, "array<string>")).when(kind.isNotNull(), F.array(kind)))
    required = F.create_map(*[x for t, fs in L.REQUIRED_PROPS.items() for x in (F.lit(t), F.array(*map(F.lit, fs)))])
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.json_object_keys("json"), none)
    missing = F.flatten(F.transform(
        F.coalesce("_types", none),
        lambda t: F.transform(F.array_except(F.coalesce(F.try_element_at(required, t), none), keys), lambda f: F.concat(t, F.lit("."), f))))
    risky = F.array_intersect(F.coalesce("_types", none), F.array(*map(F.lit, L.RISKY_SCHEMA_TYPES)))
    untyped = F.col("error").isNull() & (F.coalesce(F.size("_types"), F.lit(0)) < 1)
    issues = F.concat(labels(F.when(F.col("error").isNotNull(), "syntax error"), F.when(untyped, "missing @type")), missing)
    typed = F.size("_types") > 0
    warnings = F.concat(
        labels(F.when(typed & (F.coalesce(context, F.lit("")) == ""), "missing @context"),
               F.when(typed & (context != "") & ~F.contains(context, F.lit("schema.org")), "unexpected @context")),
        F.transform(risky, lambda t: F.concat(F.lit("risky type "), t)))
    return rows.select("url", "block", "pos", "entry", F.get("_types", F.lit(0)).alias("type"), (F.size(issues) == 0).alias("valid"),
                       issues.alias("issues"), warnings.alias("warnings"))


def page_report(pages: DataFrame) -> DataFrame:
    """Per page: objects found, their types, issues and warnings, status; pages without HTML are skipped."""
    checked = validate_blocks(blocks(pages.where("html <> ''")))
    found = checked.groupBy("url").agg(
        F.count(F.lit(1)).alias("objects"), F.sum(F.size("issues")).alias("issues"), F.sum(F.size("warnings")).alias("warnings"),
        F.array_sort(F.collect_set("type")).alias("types"))
    out = pages.select("url", (F.coalesce("html", F.lit("")) == "").alias("_skip")).join(found, "url", "left")
    zero = F.lit(0).cast("bigint")
    status = F.when(F.col("_skip"), "skipped").when(F.col("objects").isNull(), "none").when(F.col("issues") > 0, "invalid").otherwise("valid")
    return out.select("url", *[F.coalesce(c, zero).alias(c) for c in ("objects", "issues", "warnings")],
                      F.coalesce("types", F.array().cast("array<string>")).alias("types"), status.alias("status"))


def site_report(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("objects") > 0).alias("with_data"), F.sum("objects").alias("objects"),
        F.sum("issues").alias("issues"), F.sum("warnings").alias("warnings"), F.count_if(F.col("status") == "skipped").alias("skipped"))
