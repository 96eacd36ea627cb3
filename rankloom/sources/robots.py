"""robots.txt files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rankloom.functions.scores import labels


def robots_lines(files: DataFrame) -> DataFrame:
    """``site, pos, key, value``: directives and blank lines of each file (``site``, ``content``), comments dropped."""
    lines = files.select("site", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("pos", "raw"))
    line = F.trim(F.col("raw"))
    rows = lines.select("site", "pos", F.lower(F.regexp_extract(line, r"^([A-Za-z\-]+):", 1)).alias("key"),
                        F.trim(F.regexp_replace(line, r"^[^:]*:", "")).alias("value"), line.alias("line"))
    return rows.where(~F.startswith("line", F.lit("#"))).drop("line")


def disallow_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """``site, pos, kind, path``: rules in the blocks of the agent or of all agents.

    The block of a line is that of the last User-agent line before it in its file.
    """
    agents = F.transform(F.split(F.lower("value"), ","), lambda a: F.trim(a))
    meant = F.arrays_overlap(agents, F.array(F.lit(agent.lower()), F.lit("*")))
    order = Window.partitionBy("site").orderBy("pos")
    marked = robots_lines(files).withColumn("_in", F.last(F.when(F.col("key") == "user-agent", meant), ignorenulls=True).over(order))
    kept = marked.where(F.col("_in") & F.col("key").isin("disallow", "allow", "crawl-delay") & (F.col("value") != ""))
    return kept.select("site", "pos", F.col("key").alias("kind"), F.col("value").alias("path"))


def robots_report(files: DataFrame, agent: str = "*") -> DataFrame:
    """Per site the rules for the agent, sitemaps, delay and problems. A file is small, so its rules form arrays."""
    rules = disallow_rules(files, agent).select("site", "pos", "kind", "path")
    others = robots_lines(files).where(F.col("key").isin("sitemap", "user-agent")).select("site", "pos", F.col("key").alias("kind"), F.col("value").alias("path"))

    def listed(kind: str):
        pairs = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "path"))))
        return F.transform(pairs, lambda p: p["path"])

    delay = F.max_by(F.when(F.col("kind") == "crawl-delay", F.col("path").try_cast("double")), F.when(F.col("kind") == "crawl-delay", F.col("pos")))
    out = rules.unionByName(others).groupBy("site").agg(
        listed("disallow").alias("disallowed"), listed("allow").alias("allowed"), listed("sitemap").alias("sitemaps"),
        F.array_distinct(listed("user-agent")).alias("user_agents"), delay.alias("crawl_delay"))
    empty = F.array().cast("array<string>")
    out = files.select("site", "content").join(out, "site", "left").withColumns(
        {c: F.coalesce(c, empty) for c in ("disallowed", "allowed", "sitemaps", "user_agents")})
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    problems = labels(
        F.when(blank, "empty file"),
        F.when(F.array_contains("disallowed", "/"), "whole site blocked"),
        F.when(~blank & (F.size("sitemaps") == 0), "no sitemap"),
        F.when(F.col("crawl_delay") > 10, "high crawl delay"))
    bots = F.exists("user_agents", lambda a: F.lower(a) == "googlebot")
    return out.select("site", "disallowed", "allowed", "sitemaps", "user_agents", "crawl_delay", bots.alias("has_googlebot_rules"), problems.alias("issues"))


def blocked_sites(files: DataFrame, allow_counts: bool = True) -> DataFrame:
    """Whether a file keeps the main crawler out of the whole site.

    Consecutive User-agent lines form one group, a blank line ends it. As in the rules this report follows, a rule for
    the path ``/`` counts whether it is a Disallow or an Allow line, unless ``allow_counts`` is off.
    """
    order = Window.partitionBy("site").orderBy("pos")
    lines = robots_lines(files).where((F.col("key") == "") & (F.col("value") == "") | F.col("key").isin("user-agent", "disallow", "allow"))
    before = F.lag("key").over(order)
    starts = (F.col("key") == "") | ((F.col("key") == "user-agent") & (F.coalesce(before, F.lit("")) != "user-agent"))
    grouped = lines.withColumn("_g", F.sum(F.when(starts, 1).otherwise(0)).over(order))
    kinds = ["disallow", "allow"] if allow_counts else ["disallow"]
    groups = grouped.groupBy("site", "_g").agg(
        F.bool_or((F.col("key") == "user-agent") & F.lower("value").isin("*", "googlebot")).alias("_bot"),
        F.bool_or(F.col("key").isin(kinds) & (F.col("value") == "/")).alias("_all"))
    return groups.groupBy("site").agg(F.bool_or(F.col("_bot") & F.col("_all")).alias("blocks_crawler"))
