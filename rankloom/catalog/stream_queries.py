"""Streaming queries, run over the driver tables as file streams, and the report and snapshot tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import fx_pages, table
from rankloom.catalog.page_queries import DEPTH, DUP_SQL, INDEX_SQL, LETTER, P, RANKING_CTE, TECH_SCORE, WC, _MM, _TT, _len_status
from rankloom.catalog.rank_queries import R, checks
from rankloom.catalog.registry import query
from rankloom.catalog.site_queries import LABELS_CTE, labelled
from rankloom.operators import ranks as RK
from rankloom.session import scratch_path
from rankloom.sinks import reports as RP
from rankloom.streaming import crawl_feed as CF, rank_alerts as RA


def stream_of(spark, sf, name):
    """A table of the driver as a stream of files."""
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def check_stream(spark, sf):
    e = stream_of(spark, sf, "events")
    position = F.when(F.col("value") > 60, None).otherwise(F.floor("value").cast("int") + 1)
    return e.select(F.concat(F.lit("d"), F.col("user_id") % 5, F.lit(".example.com")).alias("domain"), F.concat(F.lit("kw"), "user_id").alias("keyword"),
                    position.alias("position"), F.col("ts").cast("timestamp").alias("checked_at"), F.col("event_id").alias("check_id"))


def _run(spark, stream, name, mode="append"):
    return CF.run_to_table(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint"), mode)


@query("str_01_rank_drop_alerts", R, """WITH p AS (select *, last_value(position ignore nulls) over (partition by domain, keyword order by checked_at, check_id rows between unbounded preceding and 1 preceding) as prev from fx_rank_checks)
 select domain, keyword, checked_at, prev as old_position, position as new_position, position - prev as delta from p where position - prev >= 5""")
def _(spark, sf):
    # the checks arrive in four spans of days, each of which is one batch however many files it has: what comes after a later check would be ignored
    checks_, folder, out, checkpoint = checks(spark, sf), scratch_path(spark, "rank-checks"), scratch_path(spark, "rank-alerts"), scratch_path(spark, "rank-alerts-checkpoint")
    day = F.to_date("checked_at")
    first, last = checks_.agg(F.min(day), F.max(day)).first()
    span = F.lit(((last - first).days if first else 0) // 4 + 1)
    for part in range(4):
        checks_.where(F.floor(F.datediff(day, F.lit(first)) / span) == part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(checks_.schema).parquet(folder)
        stream = stream.withColumn("checked_at", F.col("checked_at").cast("timestamp"))
        RA.start_rank_drop_alerts(stream, out, checkpoint, lateness="3650 days").awaitTermination()
    return spark.read.parquet(out).withColumn("checked_at", F.col("checked_at").cast("timestamp_ntz"))


_WEEK = "time_bucket(interval 7 day, checked_at, timestamp '1970-01-01')"


@query("str_02_weekly_digest", R, f"""WITH l AS (select {_WEEK} as week_start, domain, keyword, max_by(coalesce(position, -1), (checked_at, check_id)) as p from fx_rank_checks group by 1, 2, 3), m AS (select max(checked_at) - interval 1 day as w from fx_rank_checks)
 select week_start, domain, count(*) as tracked, count(*) filter (p between 1 and 10) as top_10, count(*) filter (p between 11 and 30) as top_30, count(*) filter (p < 0 or p > 30) as rest from l, m where week_start + interval 7 day <= w group by 1, 2""")
def _(spark, sf):
    digest = _run(spark, RA.weekly_digest(check_stream(spark, sf)), "weekly-digest")
    return digest.withColumn("week_start", F.col("week_start").cast("timestamp_ntz"))


@query("str_02_digest_examples", R, """WITH l AS (select domain, keyword, position from fx_rank_checks qualify row_number() over (partition by domain, keyword order by checked_at desc, check_id desc) = 1),
 b AS (select *, case when coalesce(position, 1000) <= 10 then 'top_10' when coalesce(position, 1000) <= 30 then 'top_30' else 'rest' end as band from l)
 select domain, band, cast(row_number() over (partition by domain, band order by coalesce(position, 1000), keyword) as int) as rank, keyword, position from b qualify rank <= 5""")
def _(spark, sf):
    return RA.digest_examples(RK.latest_positions(checks(spark, sf)))


@query("str_03_issue_status_upsert", (), """WITH s AS (select o_custkey % 50 as project_id, concat('u', cast(o_orderkey % 40 as varchar)) as url, o_orderpriority as issue_type, o_orderstatus as status, o_orderdate as updated_at from orders)
 select project_id, url, issue_type, max(updated_at) as updated_at, max_by(status, (updated_at, status)) as status from s group by 1, 2, 3""")
def _(spark, sf):
    o = stream_of(spark, sf, "orders")
    rows = o.select((F.col("o_custkey") % 50).alias("project_id"), F.concat(F.lit("u"), F.col("o_orderkey") % 40).alias("url"), F.col("o_orderpriority").alias("issue_type"),
                    F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    path = scratch_path(spark, "issue-status")
    CF.start_status_upsert(rows, path, scratch_path(spark, "issue-status-checkpoint")).awaitTermination()
    return CF.statuses(spark, path)


@query("str_04_crawl_progress", (), "select event_type as job_id, count(*) as crawled, count(*) filter (value > 60) as errors, min(ts) as started_at, max(ts) as last_at, round(epoch(max(ts)) - epoch(min(ts)), 3) as elapsed_s, greatest(max(user_id) - count(*), 0) as queued from events group by 1")
def _(spark, sf):
    e = stream_of(spark, sf, "events").select(F.col("event_type").alias("job_id"), (F.col("value") > 60).alias("is_error"), F.col("ts").cast("timestamp").alias("arrived_at"), F.col("user_id").alias("known"))
    out = _run(spark, CF.crawl_progress(e), "crawl-progress", "update")
    last = F.max_by(F.struct("crawled", "errors", "started_at", "last_at", "elapsed_s", "queued"), "epoch")
    rows = out.groupBy("job_id").agg(last.alias("s")).select("job_id", "s.*")
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("started_at", "last_at")})


_TITLE = "trim(regexp_extract(html, '<title>([^<]*)</title>', 1))"
_TITLE = f"replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"


@query("str_05_page_ingest", (), f"""WITH p AS (select regexp_replace(url, '', '') as url, {_TITLE} as t, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) as h from pages), l AS (select case when length(t) = 0 then 'Missing Title' when length(t) > 60 then 'Title Too Long' when length(t) < 30 and regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) not in ('', '/') then 'Title Too Short' end as label from p
 UNION ALL select 'Missing Meta Description' from p UNION ALL select case when h = '' then 'Missing H1' end from p UNION ALL select 'Missing H2' from p UNION ALL select 'Missing Canonical' from p) select label, count(*) as n from l where label is not null group by 1""")
def _(spark, sf):
    pages = stream_of(spark, sf, "pages").select("url", "html")
    out = _run(spark, CF.ingest(pages).select("url", "issues"), "page-ingest")
    return out.select(F.explode("issues").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- reports and snapshots --------------------------------------------------------------------------------------------

@query("snk_01_page_report", P, f"""WITH {RANKING_CTE}, {LABELS_CTE} select lp.url, lp.status_code as status, lp.title, array_to_string(h1, ' | ') as h1, array_to_string(h2[1:3], ' | ') as h2, array_to_string(keywords, ', ') as keywords, priority, r.score as ranking_score, {LETTER.format('r.score')} as grade
 from lp join ranked r using (url)""")
def _(spark, sf):
    return RP.page_report(labelled(spark, sf)).select("url", "status", "title", "h1", "h2", "keywords", "priority", "ranking_score", "grade")


@query("snk_01_issue_detail", P, f"WITH {LABELS_CTE} select lp.url, lp.title, priority, r.issue from lp join ({DUP_SQL}) r using (url)")
def _(spark, sf):
    return RP.issue_detail(labelled(spark, sf))


@query("snk_02_technical_report", P, f"""select url, {TECH_SCORE} as tech_score, {LETTER.format(TECH_SCORE)} as tech_grade, {INDEX_SQL} as indexability, {_len_status(_TT, 30, 60, 580)} as title, {_len_status(_MM, 120, 160, 920)} as meta,
 case when canonical = '' then 'missing' when rtrim(canonical, '/') = rtrim(url, '/') then 'self' else 'points_elsewhere' end as canonical, case when len(h1) = 0 then 'missing' when len(h1) > 1 then 'multiple' else 'ok' end as h1,
 case when og_title <> '' and og_description <> '' and og_image <> '' then 'complete' when og_title <> '' or og_description <> '' then 'partial' else 'missing' end as open_graph, case when {WC} < 300 then 'thin' when {WC} < 800 then 'medium' else 'rich' end as content, cast({DEPTH} as int) as url_depth from fx_pages""")
def _(spark, sf):
    folder = scratch_path(spark, "technical-report")
    RP.write_tables(RP.technical_tables(labelled(spark, sf)), folder)
    return spark.read.parquet(f"{folder}/technical").drop("issues")


@query("snk_03_snapshot_totals", P, f"""WITH {RANKING_CTE}, {LABELS_CTE} select 'p1' as project_id, count(*) as page_count, count(*) filter (n_issues > 0) as issue_count, round(avg(r.score), 1) as health_score from lp join ranked r using (url) where not lp.is_error""")
def _(spark, sf):
    folder = scratch_path(spark, "snapshots")
    RP.append_snapshot(labelled(spark, sf), folder, F.lit("p1"), F.lit("2026-11-28 00:00:00").cast("timestamp"))
    return spark.read.parquet(f"{folder}/totals").drop("crawled_at")


@query("snk_03_snapshot_pages", P, f"WITH {RANKING_CTE} select url, substr(title, 1, 100) as title, score from ranked where not is_error order by score, url limit 100")
def _(spark, sf):
    _, worst = RP.snapshot(labelled(spark, sf), F.lit("p1"), F.current_timestamp())
    return worst.select("url", "title", "score")
