"""Search ranks: click-through curve, latest and past positions, drops, visibility, difficulty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from rankloom import lookups as L
from rankloom.functions import urls as U
from rankloom.functions.scores import ctr_tier, difficulty_label, expected_ctr


def ctr_curve(spark: SparkSession) -> DataFrame:
    """The fixed curve with the change from the position before."""
    rows = spark.createDataFrame(L.CTR_CURVE, "position int, ctr_pct double, tier string")
    before = F.lag("ctr_pct").over(Window.orderBy("position"))
    return rows.select("position", "ctr_pct", F.round(F.col("ctr_pct") / 100, 4).alias("ctr_frac"),
                       F.round(F.col("ctr_pct") - before, 1).alias("delta_vs_prev"), "tier")


def with_expected_ctr(rows: DataFrame, position: str = "position", intent: Column | None = None) -> DataFrame:
    intent = intent if intent is not None else F.lit("informational")
    return rows.withColumns({"expected_ctr": expected_ctr(F.col(position), intent), "tier": ctr_tier(F.col(position))})


def ctr_opportunity(rows: DataFrame, target: Column, intent: Column) -> DataFrame:
    """Gain from moving each ranked keyword to the target position, largest first."""
    here, there = expected_ctr(F.col("position"), intent), expected_ctr(target, intent)
    out = rows.where("position >= 1").withColumns({"current_ctr": here, "target_ctr": there})
    out = out.withColumns({
        "uplift_abs": F.round(F.col("target_ctr") - F.col("current_ctr"), 4),
        "uplift_rel": F.when(F.col("current_ctr") > 0, F.round(F.col("target_ctr") / F.col("current_ctr"), 1)).otherwise(0.0),
        "tier_change": F.concat(ctr_tier(F.col("position")), F.lit(" > "), ctr_tier(target)),
    })
    return out.orderBy(F.desc("uplift_abs"), "keyword")


def latest_positions(checks: DataFrame) -> DataFrame:
    """Newest check per domain and keyword; the newest is kept while aggregating, so nothing is sorted."""
    last = F.max_by(F.struct("position", "checked_at", "check_id"), F.struct("checked_at", "check_id"))
    return checks.groupBy("domain", "keyword").agg(last.alias("c")).select("domain", "keyword", "c.*")


def history(checks: DataFrame, last: int) -> DataFrame:
    """Newest ``last`` checks per domain and keyword, numbered from the newest."""
    order = Window.partitionBy("domain", "keyword").orderBy(F.desc("checked_at"), F.desc("check_id"))
    return checks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= last)


def history_since(checks: DataFrame, now: Column, days: int) -> DataFrame:
    """Checks of the last days, oldest first."""
    since = now - F.make_dt_interval(F.lit(days))
    return checks.where(F.col("checked_at") >= since).orderBy("domain", "keyword", "checked_at", "check_id")


def cwv_history(rows: DataFrame, url: str | None, strategy: str | None, now: Column, days: int, span: int = 3, unit: str = "day") -> DataFrame:
    """Page-speed series of a URL and strategy, or of all, with a running mean of the performance score.

    The rows of a series are handled per time slice, so that a series with very many rows is spread over many tasks; the
    last ``span - 1`` rows before a slice are carried into it.
    """
    since = now - F.make_dt_interval(F.lit(days))
    out = rows.where(F.col("created_at") >= since)
    out = out.where(F.col("url") == url) if url else out
    out = out.where(F.col("strategy") == strategy) if strategy else out
    keys, order = ["url", "strategy"], ["created_at", "check_id"]
    sliced = out.withColumns({"_slice": F.date_trunc(unit, "created_at"), "_carried": F.lit(False)})
    both = sliced
    if span > 1:
        newest = Window.partitionBy(*keys, "_slice").orderBy(*[F.desc(c) for c in order])
        tail = sliced.select(*keys, "_slice", *order, "perf_score", F.row_number().over(newest).alias("_r")).where(F.col("_r") < span)
        tails = tail.groupBy(*keys, "_slice").agg(F.array_sort(F.collect_list(F.struct(*order, "perf_score"))).alias("_tail"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(1 - span, -1)  # so many slices hold enough rows
        met = F.flatten(F.collect_list("_tail").over(before))
        carried = tails.select(*keys, "_slice", met.alias("_met")).select(
            *keys, "_slice", F.inline(F.slice("_met", F.greatest(F.size("_met") - span + 2, F.lit(1)), span - 1)))
        both = sliced.unionByName(carried.withColumn("_carried", F.lit(True)), allowMissingColumns=True)
    frame = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(1 - span, 0)
    return both.withColumn("perf_mean", F.round(F.avg("perf_score").over(frame), 2)).where(~F.col("_carried")).drop("_slice", "_carried")


def with_previous_position(checks: DataFrame, unit: str = "day") -> DataFrame:
    """Add ``previous``, the last known position before each check of the same domain and keyword.

    The checks of a keyword are handled per time slice, so that a keyword with very many checks is spread over
    many tasks; the last known position of each slice is carried to the next ones through a small table.
    """
    keys = ["domain", "keyword"]
    sliced = checks.withColumn("_slice", F.date_trunc(unit, "checked_at"))
    carried = sliced.where("position is not null").groupBy(*keys, "_slice").agg(
        F.max_by("position", F.struct("checked_at", "check_id")).alias("_end"))
    slices = sliced.select(*keys, "_slice").distinct().join(carried, [*keys, "_slice"], "left")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    inside = Window.partitionBy(*keys, "_slice").orderBy("checked_at", "check_id").rowsBetween(Window.unboundedPreceding, -1)
    here = sliced.withColumn("_prev", F.last("position", ignorenulls=True).over(inside))
    out = here.join(slices, [*keys, "_slice"], "left")
    return out.withColumn("previous", F.coalesce("_prev", "_carry")).drop("_slice", "_prev", "_carry")


def rank_drops(checks: DataFrame, threshold: int = 5) -> DataFrame:
    """Checks whose position is worse than the last known one by the threshold or more."""
    delta = F.col("position") - F.col("previous")
    out = with_previous_position(checks).withColumn("delta", delta)
    return out.where(F.col("delta") >= threshold).select(
        "domain", "keyword", "checked_at", F.col("previous").alias("old_position"), F.col("position").alias("new_position"), "delta")


def visibility(positions: DataFrame, by: list[str]) -> DataFrame:
    """Keywords in the top 3, 10 and 30 and the weighted visibility score."""
    ranked = positions.where("position > 0")
    p = F.col("position")
    out = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_keywords"), F.count_if(p <= 3).alias("in_top_3"), F.count_if(p <= 10).alias("in_top_10"),
        F.count_if(p <= 30).alias("in_top_30"))
    t3, t10, t30, n = (F.col(c) for c in ("in_top_3", "in_top_10", "in_top_30", "total_keywords"))
    score = F.round((t3 * 28.5 + (t10 - t3) * 7.2 + (t30 - t10) * 1.5) / (n * 28.5) * 100, 1)
    return out.withColumns({"not_ranked": n - t30, "visibility_score": F.least(score, F.lit(100.0))})


def domain_positions(results: DataFrame, targets: DataFrame, top: tuple[int, int] = (10, 30)) -> DataFrame:
    """Best position of each target domain in each result list.

    ``results`` has ``query_id, pos, url``; ``targets`` has ``query_id, domain``. A result counts for the domain
    itself and for its subdomains: each host is taken apart into its parent domains, which keeps the join an equi join.
    """
    host = U.bare_host(F.col("url"))
    labels = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = results.select("query_id", "pos", F.explode(parents).alias("domain"))
    best = hosts.groupBy("query_id", "domain").agg(F.min("pos").alias("position"))
    out = targets.join(best, ["query_id", "domain"], "left")
    return out.withColumns({f"in_top_{n}": F.coalesce(F.col("position") <= n, F.lit(False)) for n in top})


def keyword_difficulty(results: DataFrame, authority: DataFrame) -> DataFrame:
    """Difficulty of each keyword from the authority (0 to 10) of the domains in its first ten results.

    ``results`` has ``keyword, pos, url``; ``authority`` has ``domain, authority``. Without any known authority
    the number of results decides.
    """
    first = results.where("pos <= 10").select("keyword", U.bare_host(F.col("url")).alias("domain"))
    counts = first.groupBy("keyword").agg(F.count(F.lit(1)).alias("n_results"))
    known = first.distinct().join(authority, "domain").groupBy("keyword").agg(F.avg("authority").alias("mean"))
    guess = F.when(F.col("n_results") == 0, 50).otherwise(F.least(40 + 5 * F.floor(F.col("n_results") / 5), F.lit(70)))
    score = F.when(F.col("mean").isNull(), guess).otherwise(F.least(F.round(F.col("mean") * 10, 0), F.lit(100))).cast("int")
    out = counts.join(known, "keyword", "left").withColumn("difficulty_score", score)
    return out.select("keyword", "n_results", F.round("mean", 2).alias("avg_authority"), "difficulty_score",
                      difficulty_label(F.col("difficulty_score")).alias("difficulty_label"))
