"""Queries over rank checks, snapshots, result pages and search analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom import lookups as L
from rankloom.catalog.fixtures import fx_pages, table, view
from rankloom.catalog.registry import once, query
from rankloom.operators import keyword_sets as KS, ranks as RK, summaries as SU, views as VW
from rankloom.sources.result_pages import organic_results

R = ("fx_rank_checks",)
S = ("fx_snapshots",)
NOW = "2024-01-31 00:00:00"
CURVE = "cv AS (select p, cast(ctr as double) as ctr, tier from (values " + ", ".join(f"({p}, {c}, '{t}')" for p, c, t in L.CTR_CURVE) + ") v(p, ctr, tier))"
INTENT = "case when event_type = 'view' then 'commercial' when event_type = 'purchase' then 'transactional' when event_type = 'click' then 'navigational' else 'informational' end"
FACTOR = "case when event_type = 'view' then cast(0.75 as double) when event_type = 'purchase' then cast(0.65 as double) when event_type = 'click' then cast(0.9 as double) else cast(1 as double) end"


def checks(spark, sf):
    return view(spark, sf, "fx_rank_checks")


def intent():
    e = F.col("event_type")
    return F.when(e == "view", "commercial").when(e == "purchase", "transactional").when(e == "click", "navigational").otherwise("informational")


@query("win_01_ctr_curve", R, f"WITH {CURVE}, l AS (select *, ctr - lag(ctr) over (order by p) as d from cv) select domain, keyword, check_id, position, ctr as ctr_pct, round(ctr / 100, 4) as ctr_frac, round(d, 1) as delta_vs_prev, tier from fx_rank_checks c join l on c.position = l.p")
def _(spark, sf):
    return checks(spark, sf).select("domain", "keyword", "check_id", "position").join(F.broadcast(RK.ctr_curve(spark)), "position")


@query("win_02_latest_positions", R, "select domain, keyword, position, checked_at, check_id from fx_rank_checks qualify row_number() over (partition by domain, keyword order by checked_at desc, check_id desc) = 1")
def _(spark, sf):
    return RK.latest_positions(checks(spark, sf))


@query("win_03_history", R, "select domain, keyword, check_id, position, cast(row_number() over (partition by domain, keyword order by checked_at desc, check_id desc) as int) as rank from fx_rank_checks qualify rank <= 5")
def _(spark, sf):
    return RK.history(checks(spark, sf), 5).select("domain", "keyword", "check_id", "position", "rank")


@query("win_03_history_since", R, f"select domain, keyword, check_id, position from fx_rank_checks where checked_at >= timestamp '{NOW}' - interval 7 day")
def _(spark, sf):
    return RK.history_since(checks(spark, sf), F.lit(NOW).cast("timestamp"), 7).select("domain", "keyword", "check_id", "position")


def cwv(spark, sf):
    e = table(spark, sf, "events")
    strategy = F.when(F.col("event_type").isin("view", "click"), "mobile").otherwise("desktop")
    return e.select(F.concat(F.lit("https://site"), F.col("user_id") % 10, F.lit(".example.com/")).alias("url"), strategy.alias("strategy"),
                    (F.col("value") * 50).alias("lcp_ms"), (F.col("value") / 400).alias("cls"), F.least(F.col("value"), F.lit(100.0)).alias("perf_score"),
                    F.col("ts").alias("created_at"), F.col("event_id").alias("check_id"))


@query("win_04_cwv_history", (), f"""WITH h AS (select concat('https://site', user_id % 10, '.example.com/') as url, case when event_type in ('view', 'click') then 'mobile' else 'desktop' end as strategy, least(value, 100) as perf_score, ts, event_id from events where ts >= timestamp '{NOW}' - interval 20 day)
 select url, strategy, event_id as check_id, perf_score, round(avg(perf_score) over (partition by url, strategy order by ts, event_id rows between 2 preceding and current row), 2) as perf_mean from h""")
def _(spark, sf):
    out = RK.cwv_history(cwv(spark, sf), None, None, F.lit(NOW).cast("timestamp"), 20)
    return out.select("url", "strategy", "check_id", "perf_score", "perf_mean")


@query("win_05_rank_drops", R, """WITH p AS (select *, last_value(position ignore nulls) over (partition by domain, keyword order by checked_at, check_id rows between unbounded preceding and 1 preceding) as prev from fx_rank_checks)
 select domain, keyword, checked_at, prev as old_position, position as new_position, position - prev as delta from p where position - prev >= 5""")
def _(spark, sf):
    return RK.rank_drops(checks(spark, sf))


_TWO = "mo AS (select project_id, max(d) filter (r = 1) as newer, max(d) filter (r = 2) as older from (select project_id, crawled_at as d, row_number() over (partition by project_id order by crawled_at desc) as r from (select distinct project_id, crawled_at from fx_snapshots) a) b where r <= 2 group by 1)"


@query("win_06_latest_two_snapshots", S, f"WITH {_TWO} select * from mo")
def _(spark, sf):
    return VW.latest_two(view(spark, sf, "fx_snapshots"), "project_id", "crawled_at")


@query("set_01_issue_diff", S, f"""WITH {_TWO}, n AS (select distinct s.project_id, url, issue from fx_snapshots s join mo using (project_id) where crawled_at = newer and older is not null), o AS (select distinct s.project_id, url, issue from fx_snapshots s join mo using (project_id) where crawled_at = older)
 select *, 'new' as type from (select * from n except select * from o) a UNION ALL select *, 'fixed' as type from (select * from o except select * from n) b""")
def _(spark, sf):
    snaps = view(spark, sf, "fx_snapshots")
    return KS.issue_diff(snaps, VW.latest_two(snaps, "project_id", "crawled_at"))


@query("jon_14_expected_ctr", R, f"WITH {CURVE} select check_id, round(coalesce(ctr / 100, 0.002) * {FACTOR}, 4) as expected_ctr, coalesce(tier, 'below') as tier from fx_rank_checks c left join cv on cv.p = c.position where position is not null")
def _(spark, sf):
    rows = checks(spark, sf).where("position is not null")
    return RK.with_expected_ctr(rows, intent=intent()).select("check_id", "expected_ctr", "tier")


@query("jon_15_ctr_opportunity", R, f"""WITH {CURVE}, l AS (select * from fx_rank_checks qualify row_number() over (partition by domain, keyword order by checked_at desc, check_id desc) = 1),
 o AS (select domain, keyword, round(coalesce(ctr / 100, 0.002), 4) as current_ctr, 0.11 as target_ctr, concat(coalesce(tier, 'below'), ' > gold') as tier_change from l left join cv on cv.p = l.position where position >= 1)
 select domain, keyword, current_ctr, round(cast(target_ctr as double) - current_ctr, 4) as uplift_abs, round(cast(target_ctr as double) / current_ctr, 1) as uplift_rel, tier_change from o""")
def _(spark, sf):
    out = RK.ctr_opportunity(RK.latest_positions(checks(spark, sf)), F.lit(3), F.lit("informational"))
    return out.select("domain", "keyword", "current_ctr", "uplift_abs", "uplift_rel", "tier_change")


@query("agg_15_visibility", R, """WITH l AS (select * from fx_rank_checks qualify row_number() over (partition by domain, keyword order by checked_at desc, check_id desc) = 1),
 c AS (select domain, count(*) as n, count(*) filter (position <= 3) as a, count(*) filter (position <= 10) as b, count(*) filter (position <= 30) as d from l where position > 0 group by 1)
 select domain, n as total_keywords, a as in_top_3, b as in_top_10, d as in_top_30, n - d as not_ranked, least(round(cast(a * 28.5 + (b - a) * 7.2 + (d - b) * 1.5 as double) / (n * cast(28.5 as double)) * 100, 1), 100) as visibility_score from c""")
def _(spark, sf):
    return RK.visibility(RK.latest_positions(checks(spark, sf)), ["domain"])


def analytics(spark, sf):
    """Search analytics rows: per keyword the clicks (checks in the top 10), impressions and mean position."""
    p = F.col("position")
    return checks(spark, sf).groupBy("keyword").agg(F.count_if(p <= 10).alias("clicks"), F.count(F.lit(1)).alias("impressions"), F.avg(p).alias("position"))


_SA = "sa AS (select keyword, count(*) filter (position <= 10) as clicks, count(*) as impressions, avg(position) as position from fx_rank_checks group by 1)"


@query("agg_16_search_summary", R, f"WITH {_SA} select cast(sum(clicks) as bigint) as clicks, cast(sum(impressions) as bigint) as impressions, round(avg(position), 1) as avg_position, round(cast(100 as double) * sum(clicks) / sum(impressions), 2) as ctr from sa")
def _(spark, sf):
    return SU.search_analytics_summary(analytics(spark, sf))


@query("agg_16_top_queries", R, f"WITH {_SA} select keyword, clicks, impressions, round(cast(100 as double) * clicks / impressions, 2) as ctr, round(position, 1) as position from sa order by clicks desc, keyword limit 25")
def _(spark, sf):
    return SU.top_queries(analytics(spark, sf))


def _domain_keywords(spark, sf, event):
    return checks(spark, sf).where(F.col("event_type") == event).select(F.concat("domain", F.lit(" "), F.col("position").cast("string")).alias("keyword")).where("keyword is not null")


def _dk(event):
    return f"(select distinct concat(domain, ' ', cast(position as varchar)) as keyword from fx_rank_checks where event_type = '{event}' and position is not null)"


@query("agg_18_gap_metrics", R, f"""WITH g AS (select case when y.keyword is null then 'missing' when t.keyword is null then 'strong' else 'weak' end as type, case when y.keyword is null then 75 when t.keyword is null then 15 else 40 end as s from {_dk('view')} y full join {_dk('click')} t on y.keyword = t.keyword)
 select count(*) as total, count(*) filter (type = 'missing') as missing, count(*) filter (type = 'weak') as weak, count(*) filter (type = 'strong') as strong, cast(round(avg(s), 0) as int) as avg_gap from g""")
def _(spark, sf):
    return SU.gap_metrics(KS.keyword_gap(_domain_keywords(spark, sf, "view"), _domain_keywords(spark, sf, "click")))


@query("agg_18_volume_bands", R, "select keyword, case when v < 1000 then 'low' when v < 5000 then 'medium' else 'high' end as band from (select keyword, count(*) * 60 as v from fx_rank_checks group by 1) t")
def _(spark, sf):
    volumes = checks(spark, sf).groupBy("keyword").agg((F.count(F.lit(1)) * 60).alias("v"))
    return volumes.select("keyword", SU.volume_band(F.col("v")).alias("band"))


# --- result pages -----------------------------------------------------------------------------------------------------

def result_pages(spark, sf):
    """Saved result pages, kept as a table."""
    return once(spark, sf, "result-pages", lambda: _result_pages(spark, sf))


def _result_pages(spark, sf):
    """A saved result page per page: redirect link, engine links, direct links, a data link and a cited link."""
    base = view(spark, sf, "fx_pages").select("k", "url", "next_url", "prev_url")
    nxt, prv = F.coalesce("next_url", F.lit("https://first.example.com/")), F.coalesce("prev_url", F.lit("https://last.example.com/"))
    html = F.concat(
        F.lit('<a href="/url?q='), F.col("url"), F.lit('&amp;sa=U">x</a><a href="https://www.google.com/search">g</a><a href="'), nxt,
        F.lit('">y</a><a href="https://maps.google.de/">m</a><div data-url="'), F.col("url"), F.lit('"></div><cite class="c">'), prv, F.lit("</cite>"))
    return base.select(F.col("k").alias("query_id"), html.alias("html"))


_CUT = "split_part({0}, '&', 1)"
RES = f"""rs AS (select k as query_id, {_CUT.format('url')} as a, {_CUT.format("coalesce(next_url, 'https://first.example.com/')")} as b, {_CUT.format("coalesce(prev_url, 'https://last.example.com/')")} as c from fx_pages),
 rr AS (select query_id, unnest(list_filter([a, case when b <> a then b end, case when c <> a and c <> b then c end], lambda x: x is not null)) as url, generate_subscripts(list_filter([a, case when b <> a then b end, case when c <> a and c <> b then c end], lambda x: x is not null), 1) as pos from rs)"""
FXP = ("fx_pages",)


@query("src_08_organic_results", FXP, f"WITH {RES} select query_id, cast(pos as int) as pos, url from rr")
def _(spark, sf):
    return organic_results(result_pages(spark, sf))


def _targets(spark, sf):
    pages = view(spark, sf, "fx_pages")
    return pages.select(F.col("k").alias("query_id"), F.regexp_extract("site", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain"))


@query("jon_16_domain_in_results", FXP, f"""WITH {RES}, t AS (select k as query_id, regexp_extract(site, '([^.]+\\.[^.]+\\.[^.]+)$', 1) as domain from fx_pages),
 h AS (select query_id, pos, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '') as host from rr)
 select t.query_id, t.domain, cast(min(pos) as int) as position, coalesce(min(pos) <= 10, false) as in_top_10, coalesce(min(pos) <= 30, false) as in_top_30 from t left join h on h.query_id = t.query_id and (h.host = t.domain or h.host like '%.' || t.domain) group by 1, 2""")
def _(spark, sf):
    return RK.domain_positions(organic_results(result_pages(spark, sf)), _targets(spark, sf))


def _ranked_keywords(spark, sf):
    """Results per keyword: the hosts of the pages whose titles start alike."""
    pages = view(spark, sf, "fx_pages")
    return pages.select(F.concat(F.lit("topic "), F.col("k") % 40).alias("keyword"), (F.floor(F.col("k") / 40) % 12 + 1).cast("int").alias("pos"), "url")


def _authority(spark, sf):
    sites = view(spark, sf, "fx_pages").select(F.regexp_replace("site", r"^www\.", "").alias("domain")).distinct()
    return sites.where(F.length("domain") % 3 != 0).select("domain", (F.length("domain") % 10).cast("double").alias("authority"))


@query("agg_17_keyword_difficulty", FXP, """WITH r AS (select concat('topic ', k % 40) as keyword, regexp_replace(site, '^www\\.', '') as domain from fx_pages where (k // 40) % 12 + 1 <= 10), n AS (select keyword, count(*) as n_results from r group by 1),
 a AS (select distinct regexp_replace(site, '^www\\.', '') as domain from fx_pages), m AS (select keyword, avg(cast(length(domain) % 10 as double)) as mean from (select distinct r.* from r join a using (domain) where length(domain) % 3 <> 0) t group by 1),
 d AS (select n.keyword, n_results, mean, cast(case when mean is null then least(40 + 5 * (n_results // 5), 70) else least(round(mean * 10, 0), 100) end as int) as difficulty_score from n left join m using (keyword))
 select keyword, n_results, round(mean, 2) as avg_authority, difficulty_score, case when difficulty_score <= 25 then 'Low' when difficulty_score <= 50 then 'Medium' when difficulty_score <= 75 then 'High' else 'Very High' end as difficulty_label from d""")
def _(spark, sf):
    return RK.keyword_difficulty(_ranked_keywords(spark, sf), _authority(spark, sf))
