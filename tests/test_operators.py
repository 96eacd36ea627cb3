"""Operators against brute force and fixed properties."""

import hashlib
import random
import re

from factory import pages, values
from pyspark.sql import functions as F

from rankloom.functions import text as TX, urls as UR
from rankloom.operators import keyword_sets as KS, link_graph as GR, near_duplicates as ND, ranks as RK, skew, text_mining as TM

U = "https://example.com"


def test_salted_join_equals_plain_join(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), "id")
    lookup = rows.select("key").distinct().where("key <> 'k7'").withColumn("v", F.length("key"))
    for how in ("inner", "left", "left_semi"):
        salted = skew.salted_join(rows, lookup, ["key"], F.col("id"), how, hot_rows=20)
        plain = rows.join(lookup, "key", how)
        assert sorted(map(tuple, salted.select(*plain.columns).collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    assert skew.hot_keys(rows, ["key"], 20).count() > 0


def test_group_size_with_hot_value(spark):
    rows = spark.range(300).select("id", F.when(F.col("id") < 200, "a").when(F.col("id") < 202, "b").otherwise(F.col("id").cast("string")).alias("key"))
    out = skew.with_group_size(rows, "key", F.col("id"), hot_rows=10)
    assert out.count() == 300
    assert values(out.where("n_rows is not null").groupBy("key").agg(F.max("n_rows").alias("n"), F.count("*").alias("c")), "key", "n", "c") == [("a", 200, 200), ("b", 2, 2)]


def _print(text):
    votes = [0] * 64
    for token in re.findall(r"[a-z0-9]{3,}", text.lower()):
        h = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def test_fingerprint_and_pairs_equal_brute_force(spark):
    rng = random.Random(3)
    words = ["w%03d" % i for i in range(400)]
    base = [rng.choices(words, k=120) for _ in range(12)]
    texts = []
    for doc in base:
        for _ in range(6):
            copy = list(doc)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += ["", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "url int, text string")
    prints = ND.fingerprints(docs, F.col("text"))
    got = {r.url: r.fp & (1 << 64) - 1 for r in prints.collect()}
    want = {i: _print(t) for i, t in enumerate(texts) if _print(t)}
    assert got == want
    first = {}
    for url, fp in sorted(want.items()):
        first.setdefault(fp, url)
    brute = {(min(a, b), max(a, b), bin(x ^ y).count("1")) for x, a in first.items() for y, b in first.items() if a < b and bin(x ^ y).count("1") <= 3}
    assert {(r.url_a, r.url_b, r.hamming_distance) for r in ND.near_pairs(prints, 3).collect()} == brute
    copies = {(first[fp], url) for url, fp in want.items() if first[fp] != url}
    assert {(r.url_a, r.url_b) for r in ND.exact_duplicates(prints).collect()} == copies
    pairs = sum(1 for a in want for b in want if a < b and bin(want[a] ^ want[b]).count("1") <= 3)
    assert ND.duplicate_summary(prints, ND.near_pairs(prints, 3)).head().duplicate_pairs == pairs


def test_masks_find_every_pair_within_the_distance():
    rng = random.Random(1)
    masks = [m & (1 << 64) - 1 for m in ND.block_masks(3)]
    for _ in range(500):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(diff & m == 0 for m in masks)


def _graph(spark):
    names = ["/", "/a", "/a/b", "/c", "/lost", "/end"]
    edges = [("/", "/a"), ("/", "/c"), ("/", "/a/b"), ("/a", "/a/b"), ("/a", "/"), ("/a/b", "/end"), ("/c", "/"), ("/c", "/nowhere"), ("/a", "/a"), ("/", "/a/")]
    urls = spark.createDataFrame([(U + n,) for n in names], "url string")
    links = spark.createDataFrame([(U + a, U + b) for a, b in edges], "src string, dst string")
    return names, edges, GR.build_graph(urls, links)


def test_link_graph(spark):
    names, edges, graph = _graph(spark)
    assert graph.edges.count() == 7
    assert values(graph.edges.where("n_links > 1"), "src", "dst", "n_links") == [(U + "/", U + "/a", 2)]
    assert dict(values(GR.crawl_depth(graph), "url", "depth")) == {U + k: v for k, v in {"/": 0, "/a": 1, "/a/b": 1, "/c": 1, "/lost": -1, "/end": 2}.items()}
    assert values(GR.orphans(graph, GR.crawl_depth(graph)), "url") == [(U + "/lost",)]


def test_pagerank_equals_brute_force_and_sums_to_one(spark):
    names, edges, graph = _graph(spark)
    out = {n: sorted({b.rstrip("/") or "/" for a, b in edges if a == n and b.rstrip("/") != a.rstrip("/") and (b.rstrip("/") or "/") in names}) for n in names}
    n = len(names)
    rank = {x: 1 / n for x in names}
    for _ in range(50):
        stuck = sum(rank[x] for x in names if not out[x])
        new = {x: 0.15 / n + 0.85 * stuck / n for x in names}
        for x in names:
            for y in out[x]:
                new[y] += 0.85 * rank[x] / len(out[x])
        change, rank = sum(abs(new[x] - rank[x]) for x in names), new
        if change < 1e-6:
            break
    got = {r.url.removeprefix(U): r.pagerank for r in GR.pagerank(graph).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[x] - rank[x]) < 1e-6 for x in names)


def test_sources_with_many_links_are_split(spark, monkeypatch):
    monkeypatch.setattr(GR, "EDGES_PER_PART", 2)
    names, edges, graph = _graph(spark)
    assert graph.nodes.where("parts > 1").count() == 1
    assert abs(GR.pagerank(graph, rounds=20).agg(F.sum("pagerank")).head()[0] - 1) < 1e-9
    assert GR.crawl_depth(graph).where("depth = -1").count() == 1


def test_rank_drops_across_slices(spark):
    rows = [("d", "k", p, f"2024-01-{d:02d} 0{h}:00:00", i) for i, (p, d, h) in enumerate([(3, 1, 1), (None, 1, 2), (9, 3, 1), (None, 4, 1), (20, 9, 1), (18, 9, 2)])]
    checks = spark.createDataFrame(rows, "domain string, keyword string, position int, checked_at string, check_id long").withColumn("checked_at", F.col("checked_at").cast("timestamp"))
    assert values(RK.rank_drops(checks), "old_position", "new_position", "delta") == [(3, 9, 6), (9, 20, 11)]


def test_issue_diff_is_antisymmetric(spark):
    rows = [(1, "2024-01-01", "u", "a"), (1, "2024-01-01", "u", "b"), (1, "2024-01-02", "u", "b"), (1, "2024-01-02", "v", "c")]
    snaps = spark.createDataFrame(rows, "project_id int, crawled_at string, url string, issue string")
    one = spark.createDataFrame([(1, "2024-01-02", "2024-01-01")], "project_id int, newer string, older string")
    back = spark.createDataFrame([(1, "2024-01-01", "2024-01-02")], "project_id int, newer string, older string")
    forward = values(KS.issue_diff(snaps, one), "url", "issue", "type")
    assert forward == [("u", "a", "fixed"), ("v", "c", "new")]
    assert values(KS.issue_diff(snaps, back), "url", "issue", "type") == [("u", "a", "new"), ("v", "c", "fixed")]


def test_whole_words(spark):
    row = spark.createDataFrame([("art", "a startup of art. c++ caféart"), ("c++", "c++ c+"), ("", "x")], "kw string, t string")
    got = [r.x for r in row.select(TX.in_text(F.col("kw"), F.col("t")).alias("x")).collect()]
    assert got[0] is True and got[2] is False


def test_phrases_keep_single_trigrams(spark):
    docs = spark.createDataFrame([("u", "advanced seo techniques for advanced seo")], "url string, text string")
    found = [r.phrase for r in TM.phrases(docs, F.col("text")).orderBy("rank").collect()]
    assert found[0] == "advanced seo" and "advanced seo techniques" in found


def test_url_parts(spark):
    url = "HTTPS://WWW.Example.com:8080/a//b/?x=1&x=2&y#frag"
    row = spark.range(1).select(
        UR.host(F.lit(url)).alias("host"), UR.path(F.lit(url)).alias("path"), UR.query(F.lit(url)).alias("query"), UR.bare_host(F.lit(url)).alias("bare"),
        UR.node_key(F.lit(url)).alias("node"), UR.param_count(F.lit(url)).alias("params"), UR.silo(F.lit(url)).alias("silo"), UR.depth(F.lit(url)).alias("depth")).head()
    assert (row.host, row.path, row.query, row.bare) == ("www.example.com:8080", "/a//b/", "x=1&x=2&y", "example.com")
    assert (row.node, row.params, row.silo, row.depth) == ("https://www.example.com:8080/a//b", 1, "a", 2)


def test_intent_and_competition(spark):
    rows = spark.createDataFrame([("buy shoes",), ("log in here",), ("best shoes",), ("how to tie",), ("",)], "k string")
    assert [r.i for r in rows.select(TX.search_intent(F.col("k")).alias("i")).collect()] == ["transactional", "navigational", "commercial", "informational", "informational"]
    lists = spark.createDataFrame([(["car insurance"],), (["how to knit"],), (["red wool socks"],), (["socks"],), ([],)], "k array<string>")
    assert [r.c for r in lists.select(TX.competition(F.col("k")).alias("c")).collect()] == ["High", "Low", "Low", "Medium", "Medium"]


def test_keyword_importance(spark):
    p = pages(spark, {"title": "coffee mug", "h1": ["coffee mug"], "h2": ["coffee mug care"], "body_text": "coffee mug " * 8 + "other words here"})
    row = {r.keyword: r for r in TM.keyword_importance(p).collect()}["coffee mug"]
    assert row.importance == "HIGH" and row.score == 7 and row.prominent


def test_a_snapshot_that_is_written_again_replaces_itself(spark, tmp_path):
    from rankloom.sinks import reports as RP

    rows = pages(spark, {"url": "https://a.com/"}, {"url": "https://a.com/x"}).withColumns({"score": F.lit(50), "issues": F.array(F.lit("t")), "priority": F.lit("Low")})
    first, second = (F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp") for d in (1, 2))
    for project, when in (("p", first), ("p", second), ("q", first), ("p", second), ("p", first)):
        RP.append_snapshot(rows, str(tmp_path), F.lit(project), when)
    totals, worst = (spark.read.parquet(str(tmp_path / n)) for n in ("totals", "pages"))
    assert totals.count() == 3 and worst.count() == 6
    assert sorted((r.project_id, r.crawled_at.day, r.page_count) for r in totals.collect()) == [("p", 1, 2), ("p", 2, 2), ("q", 1, 2)]


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_and_phrases_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([("u", "Good tea and good tea with very good tea"), ("v", ""), ("w", None)], "url string, text string")
    for found in (TM.phrases(docs, F.col("text")), TM.frequent_keywords(docs, F.col("text")), TM.term_counts(docs, F.col("text")), ND.fingerprints(docs, F.col("text"))):
        assert "Exchange" not in _executed(found)
    assert values(TM.frequent_keywords(docs, F.col("text"), k=1), "url", "term", "tf", "rank") == [("u", "good", 3, 1)]


def test_frequent_and_rare_terms_meet_their_weights(spark, monkeypatch):
    docs = spark.createDataFrame([(str(i), f"common word{'abcdefghij'[i % 10]} only{'klmnopqrst'[i % 10]}{'uvwxyzabcd'[i // 10]}") for i in range(60)], "url string, text string")
    want = values(TM.tfidf(docs, F.col("text")).withColumn("weight", F.round("weight", 9)), "url", "term", "weight")
    for frequent, hot in ((1, 1_000_000), (3, 5), (10**6, 2)):
        monkeypatch.setattr(TM, "FREQUENT_TERMS", frequent)
        monkeypatch.setattr(TM, "HOT_ROWS", hot)
        assert values(TM.tfidf(docs, F.col("text")).withColumn("weight", F.round("weight", 9)), "url", "term", "weight") == want


def test_running_mean_of_one_hot_series_is_dealt_by_slices(spark):
    rows = spark.range(3000).select(
        F.lit("u").alias("url"), F.when(F.col("id") % 10 == 0, "desktop").otherwise("mobile").alias("strategy"), (F.col("id") * 7 % 101).cast("double").alias("perf_score"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 3600).alias("created_at"), F.col("id").alias("check_id"))
    now = F.timestamp_seconds(F.lit(1_700_000_000 + 3000 * 3600))
    for span in (1, 3, 40):
        got = {r["check_id"]: r["perf_mean"] for r in RK.cwv_history(rows, None, None, now, 200, span).collect()}
        for strategy, ids in (("desktop", range(0, 3000, 10)), ("mobile", [i for i in range(3000) if i % 10])):
            scores = [i * 7 % 101 for i in ids]
            for k, i in enumerate(ids):
                own = scores[max(0, k - span + 1):k + 1]
                assert abs(got[i] - sum(own) / len(own)) < 0.006, strategy
    out = RK.cwv_history(rows, None, None, now, 200)
    assert out.columns == rows.columns + ["perf_mean"] and "_slice" in _executed(out)


def test_words_are_cut_and_counted_without_patterns(spark):
    texts = [None, "", " ", "a", " a b  c\n", "a　b c᠎d​e\u0085f", "\x1ca\x1fb c\x0bd", "é \U0001f600 q "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    counted = rows.select("t", TX.words(F.col("t")).alias("w"), TX.word_count(F.col("t")).alias("n"), F.regexp_count("t", F.lit(TX.SPACE.replace("[", "[^", 1))).alias("want"))
    got = counted.collect()
    assert [r.n for r in got] == [r.want for r in got] == [None, 0, 0, 1, 3, 4, 3, 3]
    assert [r.w for r in got][4:6] == [["a", "b", "c"], ["a", "b", "c᠎d​e", "f"]]
    plan = counted.select("w", "n")._jdf.queryExecution().executedPlan().toString().lower()
    assert "regexp" not in plan and "lambda" not in plan
