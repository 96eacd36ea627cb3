"""Several sites in one table, plans without wide or repeated shuffles, long chains, and every audit rule."""

from factory import pages, values

import random
import re

import duckdb
import pyarrow as pa

from pyspark.sql import functions as F

from rankloom import catalog
from rankloom.catalog import fixtures, registry, source_queries
from rankloom.operators import cross_page as CP, link_graph as GR, near_duplicates as ND, page_issues as PI, rule_audit as RA
from rankloom.sources.page_facts import extract_pages

A, B = "https://a.com", "https://b.com"


def _two_sites(spark):
    return pages(spark, *[
        {"url": h + p, "site": h[8:], "title": "Home" if p == "/" else p, "meta_description": h + p, "links": [h + x for x in links]}
        for h in (A, B) for p, links in (("/", ["/1"]), ("/1", ["/2"]), ("/2", []), ("/lost", []))])


def test_sites_are_judged_by_themselves(spark):
    rows = _two_sites(spark)
    assert CP.duplicate_titles(rows).count() == 0 and CP.duplicate_titles(rows, by=()).count() == 8
    assert PI.detect_issues(rows).where(F.array_contains("issues", "Duplicate Title")).count() == 0
    assert values(CP.orphan_pages(rows), "url") == [(A + "/lost",), (B + "/lost",)]
    graph = GR.build_graph(rows.select("url"), CP.link_rows(rows))
    depth = dict(values(GR.crawl_depth(graph), "url", "depth"))
    depth |= {k.rstrip("/"): v for k, v in depth.items()}
    assert [depth[h + p] for h in (A, B) for p in ("", "/1", "/2", "/lost")] == [0, 1, 2, -1] * 2
    ranks = dict(values(GR.pagerank(graph), "url", "pagerank"))
    assert abs(sum(v for k, v in ranks.items() if k.startswith(A)) - 1) < 1e-9 and abs(ranks[A + "/1"] - ranks[B + "/1"]) < 1e-9
    graph.release()


def test_link_reports_are_those_of_each_site(spark):
    rows = _two_sites(spark)
    graph = GR.build_graph(rows.select("url"), CP.link_rows(rows))
    depth, ranks = GR.crawl_depth(graph), GR.pagerank(graph)
    hosts = [h[8:] for h in (A, B)]
    assert values(GR.depth_summary(depth), "site", "max_depth", "reachable", "unreachable", "total") == [(h, 2, 3, 1, 4) for h in hosts]
    assert values(GR.depth_distribution(depth), "site", "label", "pages") == sorted((h, k, 1) for h in hosts for k in ("depth_0", "depth_1", "depth_2", "unreachable"))
    silos = values(GR.silo_report(graph, ranks), "site", "silo", "page_count", "cross_silo_links")
    assert [r[1:] for r in silos if r[0] == hosts[0]] == [r[1:] for r in silos if r[0] == hosts[1]] and len(silos) == 8
    top = values(GR.top_pages(graph, ranks, depth, n=2), "site", "rank")
    assert top == [(h, r) for h in hosts for r in (1, 2)]
    scored = GR.priority_scores(graph, ranks, depth, rows.select(F.lit(A + "/1").alias("url"), F.lit(3).alias("issue_count")).distinct())
    lists = scored.select("url", F.array(F.lit("x")).alias("issues"))
    assert values(GR.needs_attention(scored, lists, n=3), "site", "rank") == [(h, r) for h in hosts for r in (1, 2, 3)]
    graph.release()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_round_moves_values_and_not_edges(spark):
    rows = _two_sites(spark)
    graph = GR.build_graph(rows.select("url"), CP.link_rows(rows))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(GR._push(graph.nodes.select("url", "parts"), graph.edges))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = plan.split("InMemoryRelation")[0]
    assert above.count("Exchange hashpartitioning(src") == 1 and "InMemoryTableScan" in above
    graph.release()


def test_body_text_stays_out_of_the_audit_joins(spark):
    rows = _two_sites(spark)
    none = spark.createDataFrame([], "site string, pos int, path string")
    vitals = spark.createDataFrame([], "url string, lcp_s double, cls double, inp_s double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [_plan(RA.with_context(rows, rows.select("url"), none, vitals)), _plan(PI.detect_issues(rows).select("url", "issues"))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert "Exchange" in plan
    assert "body_text" not in RA.with_context(rows, rows.select("url"), none, vitals).columns


def test_long_canonical_chain_takes_few_rounds(spark, monkeypatch):
    n, rounds = 100_000, []
    keep = CP.cut_lineage
    monkeypatch.setattr(CP, "cut_lineage", lambda df: rounds.append(1) or keep(df))
    chain = spark.range(n).select(F.concat(F.lit("https://a.com/"), "id").alias("url"), F.concat(F.lit("https://a.com/"), F.least(F.col("id") + 1, F.lit(n - 1))).alias("canonical"))
    walks = CP.canonical_walks(chain)
    assert walks.agg(F.max("hops")).head()[0] == n - 1 and walks.where("state <> 'end'").count() == 0
    assert len(rounds) <= 18 and "path" not in walks.columns


def test_canonical_walks_against_a_plain_walk(spark):
    rng = random.Random(4)
    for n in (1, 7, 60):
        name = lambda i: f"https://a.com/p{i:02}"
        nxt = {i: rng.choice([*range(n + 3), i]) for i in range(n)}
        if n == 60:  # loops of 1 to 13 pages with tails, a chain that leaves
            nxt = {i: (i // 15 * 15 if i % 15 == 12 else 900 if i == 59 else i + 1) for i in range(n)}
            nxt[13] = nxt[14] = 3
        rows = spark.createDataFrame([(name(i), name(j)) for i, j in nxt.items()], "url string, canonical string")
        want = {}
        for i in range(n):
            path = [i]
            while True:
                cur = path[-1]
                if cur not in nxt:
                    state = "left"
                elif nxt[cur] == cur:
                    state = "end"
                elif nxt[cur] in path:
                    path.append(nxt[cur])
                    state = "loop"
                else:
                    path.append(nxt[cur])
                    continue
                break
            if len(path) > 1:
                want[name(i)] = (state, len(path) - 1, [name(k) for k in path])
        got = {r["start"]: r for r in CP.canonical_walks(rows).collect()}
        assert {k: (r["state"], r["hops"]) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
        heads = {min(p[p.index(p[-1]):]) for s, _, p in want.values() if s == "loop"}
        assert {k for k, r in got.items() if r["is_head"]} == heads
        for r in CP.canonical_problems(rows).collect():
            state, hops, path = want[r["url"]]
            assert r["path"] == (path[:-1] if state == "left" else path) and r["hops"] == len(r["path"]) - 1


def test_lists_are_whole(spark):
    html = "<html><body>" + "".join(f'<h2>{"t" * 200}{i}</h2><a href="https://o{i}.com/">{"x" * 150}</a><img src="/{i}.png" alt="a{i}">' for i in range(60)) + "</body></html>"
    row = extract_pages(spark.createDataFrame([("https://a.com/", html)], "url string, html string")).head()
    assert len(row.external_links) == 60 and len(row.img_alts) == len(row.img_srcs) == 60 and row.img_non_modern_count == 60
    assert len(row.heading_sequence) == 60 and len(row.heading_sequence[0].text) == 201


def _of_all_kinds(spark):
    u = "https://s.com"
    link = lambda *hrefs: [u + h for h in hrefs]
    same = [(u + f"/d{i}", "click here") for i in range(6)]
    return pages(
        spark,
        {"url": u + "/", "site": "s.com", "links": link("/gone", "/hop"), "link_objects": [(u + "/gone", "buy"), *same]},
        *[{"url": f"{u}/l{i}", "site": "s.com", "links": link("/gone"), "title": f"Linking page number {i} of the site"} for i in range(7)],
        {"url": u + "/gone", "site": "s.com", "status_code": 404, "is_error": True}, {"url": u + "/old", "site": "s.com", "status_code": 410, "is_error": True},
        {"url": u + "/down", "site": "s.com", "status_code": 503, "is_error": True}, {"url": u + "/hop", "site": "s.com", "redirect_hops": 2},
        {"url": u + "/x", "site": "s.com", "x_robots_tag": "none", "title": "Page not found here", "body_text": "few words"},
        {"url": u + "/empty", "site": "s.com", "title": "", "h1": [], "body_text": ""},
        {"url": u + "/stuffed", "site": "s.com", "title": "shoes shoes shoes and shoes", "keywords": ["shoes"]},
        {"url": u + "/anchors", "site": "s.com", "link_objects": [(u + f"/d{i}", t) for t in ("click here", "buy", "get", "see") for i in range(8)]},
        {"url": u + "/a/b/c/d/e", "site": "s.com"}, {"url": u + "/q?a=1&b=2&c=3&d=4", "site": "s.com"}, {"url": u + "/Mixed//double_under", "site": "s.com"},
        {"url": u + "/toerror", "site": "s.com", "canonical": u + "/gone"},
        {"url": u + "/p1", "site": "s.com", "pagination_next": u + "/p2"}, {"url": u + "/p2", "site": "s.com", "pagination_prev": u + "/p9"})


def test_rules_on_error_pages_and_odd_addresses_fire(spark):
    rows = _of_all_kinds(spark)
    none = spark.createDataFrame([], "site string, pos int, path string")
    vitals = spark.createDataFrame([], "url string, lcp_s double, cls double, inp_s double")
    found = {r.type for r in RA.rule_audit(rows, rows.select("url"), none, vitals).select("type").distinct().collect()}
    assert {
        "x_robots_none", "page_not_found", "page_gone", "server_error", "soft_404", "empty_200_page", "canonical_to_error_page", "sitemap_error_page",
        "title_keyword_stuffing", "no_content", "low_anchor_quality_score", "deep_crawl_depth", "pagination_non_reciprocal", "url_excessive_parameters",
        "url_mixed_case", "url_double_slash", "url_underscores", "broken_internal_link", "widely_linked_dead_page"} - found == set()


def test_candidate_join_is_shuffled_though_its_estimate_is_small(spark):
    prints = spark.range(200).select(F.col("id").alias("url"), F.xxhash64("id").alias("fp"))
    distinct = ND.groups(prints).select("fp").localCheckpoint()
    pairs = ND.candidate_pairs(distinct)
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_salt" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    masks = [m % (1 << 64) for m in ND.block_masks(3)]
    fps = sorted(r["fp"] for r in distinct.collect())
    assert sorted(map(tuple, pairs.collect())) == [(a, b) for i, a in enumerate(fps) for b in fps[i + 1:] if any((a ^ b) % (1 << 64) & m == 0 for m in masks)]


def test_votes_are_taken_on_bounded_slices(spark, monkeypatch):
    monkeypatch.setattr(ND, "SLICE_WORDS", 10)
    lists = [["aa"] * n for n in (4, 0, 6, 3, 25, 7, 3, 1)]
    batch = pa.RecordBatch.from_pydict({"words": pa.array(lists, pa.list_(pa.string()))})
    parts = [part.column("words").to_pylist() for part in ND.word_slices([batch])]
    assert [len(x) for part in parts for x in part] == [len(x) for x in lists]
    assert all(len(part) == 1 or sum(map(len, part)) <= 10 for part in parts) and len(parts) == 5


def test_pages_without_a_partner_do_not_meet_in_one_task(spark, tmp_path):
    ids = [*range(-14, 40), 3, 12, 12, 50, None]
    rows = [(k, f"https://s{i % 3}.com/{k}#x", f"<title>T {k}</title><h1>H</h1><nav>n</nav><p>Text  of {i}</p>") for i, k in enumerate(ids)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    base = fixtures.view(spark, str(tmp_path), "page_base")
    text = fixtures.ctes("page_base").replace("from pages", "from read_parquet('%s/pages.parquet/*.parquet')" % tmp_path).replace(
        "join pages", "join read_parquet('%s/pages.parquet/*.parquet')" % tmp_path)
    wanted = duckdb.sql(text + " select * from page_base")
    found = base.select(*wanted.columns).collect()
    assert sorted(str(tuple(r)) for r in found) == sorted(map(str, wanted.fetchall())) and len(found) > len(ids)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fixtures.view(spark, str(tmp_path), "page_base")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    outer = [line for line in plan.splitlines() if "SortMergeJoin" in line and "LeftOuter" in line]
    assert len(outer) == 3 and not any("CASE" in line for line in outer)


def test_texts_are_hashed_once_for_duplicate_content(spark):
    text = " ".join(["word"] * 60)
    rows = spark.createDataFrame([("u1", "s", f" {text}", False), ("u2", "s", text, False), ("u3", "t", text, False), ("u4", "s", text + "x", False), ("u5", "s", text, True)],
                                 "url string, site string, body_text string, is_error boolean")
    found = CP.duplicate_content(rows)
    assert sorted((r.url, r.n_rows) for r in found.collect()) == [("u1", 2), ("u2", 2)]
    assert "md5(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_tables_of_reports_are_built_when_asked_for(spark, monkeypatch):
    from rankloom.operators import benchmark as BM
    from rankloom.plans.competitor_benchmark import run_benchmark
    from rankloom.plans.link_report import link_report
    from rankloom.sinks.reports import competitor_tables

    def late(*_, **__):
        raise AssertionError("not asked for")

    rows = _two_sites(spark).withColumn("issues", F.array(F.lit("x")))
    with monkeypatch.context() as m:
        for part in ("pagerank", "crawl_depth"):
            m.setattr(GR, part, late)
        m.setattr(BM, "site_scores", late)
        report = link_report(rows)
        assert sorted((r.total_pages, r.total_internal_links) for r in report["totals"].collect()) == [(4, 2), (4, 2)]
        none = spark.createDataFrame([], "url string, seo_score double, perf_score double, lcp_ms double, cls double, audits map<string,struct<score:double,numericValue:double>>")
        tables = competitor_tables(run_benchmark(rows, none, "a.com", 2026), none, rows)
        assert tables["errors"].count() == rows.where("is_error").count() and list(tables) == ["scores", "keyword_gaps", "page_speed", "actions", "errors"]
    assert report["depth"].count() == 8 and report["depth"] is report["depth"] and {"needs_attention", "silos", "pagerank"} < set(report)


def page_table(folder, spark, ids):
    rows = [(k, f"https://s{i % 3}.com/{i}", f"<title>T {i}</title><h1>H</h1><p>Text  of {i} {'and more ' * 40}</p>") for i, k in enumerate(ids)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(folder / "pages.parquet"))
    return str(folder)


def test_pages_without_a_number_do_not_meet_in_one_task(spark, tmp_path):
    sf = page_table(tmp_path, spark, [*range(40), *[None] * 360])
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = fixtures.view(spark, sf, "page_base").groupBy(F.spark_partition_id()).agg(F.count_if(F.col("k").isNull()).alias("n")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n for r in rows) == 360 and max(r.n for r in rows) < 100


def test_speed_reports_do_not_deal_the_texts_of_pages(spark, tmp_path):
    sf = page_table(tmp_path, spark, range(-150, 150))
    reports = source_queries._speed_reports(spark, sf)
    assert reports.count() == 300 and "body_text#" not in reports._jdf.queryExecution().optimizedPlan().toString()
    text = fixtures.ctes("fx_pages").replace("pages p\n", "read_parquet('X') p\n").replace("join pages", "join read_parquet('X')").replace("'X'", f"'{sf}/pages.parquet/*.parquet'")
    wanted = duckdb.sql(text + " select url, meta_description from fx_pages").fetchall()
    found = fixtures.view(spark, sf, "fx_pages").select("url", "meta_description").collect()
    assert sorted(map(tuple, found)) == sorted(wanted) and max(len(m) for _, m in wanted) > 180


def test_on_page_scores_build_no_table_they_do_not_read(spark, tmp_path):
    sf = page_table(tmp_path, spark, range(120))
    catalog.load()
    scores = catalog.QUERIES["cmp_01_on_page"](spark, sf)
    assert not [name for _, folder, name in registry._KEPT if folder == sf]
    assert "body_text#" not in scores._jdf.queryExecution().optimizedPlan().toString()
    sql = catalog.ORACLES["cmp_01_on_page"].replace("pages p\n", "read_parquet('X') p\n").replace("join pages", "join read_parquet('X')")
    wanted = duckdb.sql(sql.replace("'X'", f"'{sf}/pages.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, scores.select("site", "on_page").collect())) == sorted(wanted) and len(wanted) == 3


def same_as_sql(spark, sf, name):
    """Rows of a query whose joins are all shuffled, held against its SQL."""
    catalog.load()
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = catalog.QUERIES[name](spark, sf)
        sql = re.sub(r"\b(from|join) pages\b", f"\\1 read_parquet('{sf}/pages.parquet/*.parquet')", catalog.ORACLES[name])
        wanted = duckdb.sql(sql)
        found = df.select(*[f"`{c}`" for c in wanted.columns]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = wanted.fetchall()
    assert rows and sorted(str(tuple(r)) for r in found) == sorted(map(str, rows))


def test_blocking_resources_of_pages_without_a_number(spark, tmp_path):
    same_as_sql(spark, page_table(tmp_path, spark, [*range(40), *[None] * 60]), "src_07_render_blocking")


def test_canonical_chains_of_pages_without_a_number(spark, tmp_path):
    same_as_sql(spark, page_table(tmp_path, spark, [*range(40), *[None] * 60]), "jon_04_canonical_chains_and_loops")


def test_consistency_of_pages_without_a_number(spark, tmp_path):
    same_as_sql(spark, page_table(tmp_path, spark, [*range(40), *[None] * 60]), "aud_05_consistency")


def test_canonical_walks_deal_no_page_facts_but_addresses(spark, tmp_path):
    sf = page_table(tmp_path, spark, [*range(40), *[None] * 60])
    same_as_sql(spark, sf, "jon_04_canonical_chains_and_loops")
    assert not [folder for _, folder in fixtures._SHARED if folder == sf]
    addresses = fixtures.normalise_pages(fixtures.view(spark, sf, "fx_pages")).select(*fixtures.ADDRESS_FACTS)
    assert "html:string" not in _plan(addresses) and "url:string" in _plan(addresses)
    assert sorted(map(str, fixtures.fx_addresses(spark, sf).collect())) == sorted(map(str, fixtures.fx_pages(spark, sf).select(*fixtures.ADDRESS_FACTS).collect()))


def test_consistency_deals_no_page_facts_but_addresses(spark, tmp_path):
    sf = page_table(tmp_path, spark, [*range(40), *[None] * 60])
    same_as_sql(spark, sf, "aud_05_consistency")
    assert not [folder for _, folder in fixtures._SHARED if folder == sf]


def test_pages_without_number_and_address_do_not_meet_in_one_task(spark, tmp_path):
    lost = spark.range(0, 360, 1, 6).selectExpr("cast(null as long) as page_id", "cast(null as string) as url", "'<p>Copy</p>' as html")
    some = spark.range(40).selectExpr("id as page_id", "concat('https://s.com/', id) as url", "'<title>T</title><p>Text</p>' as html")
    lost.union(some).write.parquet(str(tmp_path / "pages.parquet"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = [source_queries._speed_reports(spark, str(tmp_path)), fixtures.view(spark, str(tmp_path), "page_base").where("k is null")]
        rows = [df.groupBy(F.spark_partition_id().alias("part")).count().collect() for df in found]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [sum(r["count"] for r in part) for part in rows] == [400, 360] and all(max(r["count"] for r in part) < 120 for part in rows)
    same_as_sql(spark, str(tmp_path), "src_07_render_blocking")
