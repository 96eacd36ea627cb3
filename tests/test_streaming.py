"""Streams give what the batch operators give."""

import datetime as dt
import random

from factory import values

from rankloom.operators import ranks as RK
from rankloom.streaming import crawl_feed as CF, rank_alerts as RA

SCHEMA = "domain string, keyword string, position int, checked_at timestamp, check_id long"


def _day(d, h=0):
    return dt.datetime(2024, 1, d, h)


def test_alerts_keep_the_last_known_position_and_skip_late_rows(spark, tmp_path):
    first = [("d", "k", 3, _day(1), 1), ("d", "k", None, _day(2), 2), ("d", "j", 5, _day(2), 3)]
    second = [("d", "k", 9, _day(3), 4), ("d", "k", 1, _day(1) - dt.timedelta(hours=5), 5), ("d", "k", 16, _day(4), 6), ("d", "j", 7, _day(3), 7)]
    source = str(tmp_path / "in")
    rows = None
    for part in (first, second):
        frame = spark.createDataFrame(part, SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        RA.start_rank_drop_alerts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert values(rows, "keyword", "old_position", "new_position") == [("k", 3, 9), ("k", 9, 16)]
    in_order = spark.createDataFrame([r for r in first + second if r[4] != 5], SCHEMA)
    assert values(RK.rank_drops(in_order), "keyword", "old_position", "new_position") == [("k", 3, 9), ("k", 9, 16)]


def test_alerts_do_not_depend_on_batches(spark, tmp_path):
    rng = random.Random(2)
    checks = [("d", "k", rng.choice([None, *range(1, 60)]), _day(1) + dt.timedelta(minutes=i), i) for i in range(200)]
    want = values(RK.rank_drops(spark.createDataFrame(checks, SCHEMA)), "checked_at", "old_position", "new_position")
    source = str(tmp_path / "in")
    for part in (checks[:90], checks[90:]):
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).repartition(5).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        RA.start_rank_drop_alerts(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert values(spark.read.parquet(str(tmp_path / "out")), "checked_at", "old_position", "new_position") == want and len(want) > 20


def test_alerts_in_small_arrow_batches_and_state_that_expires(spark, tmp_path):
    rng = random.Random(7)
    checks = [("d", f"k{i % 3}", rng.randrange(1, 60), _day(1) + dt.timedelta(minutes=i), i) for i in range(240)]
    gone = [("d", "old", 1, _day(1), 900), ("d", "new", 1, dt.datetime(2024, 6, 1), 901)]
    back = [("d", "old", 50, dt.datetime(2024, 6, 2), 902), ("d", "new", 50, dt.datetime(2024, 6, 3), 903)]
    want = values(RK.rank_drops(spark.createDataFrame(checks, SCHEMA)), "keyword", "old_position", "new_position")
    source, size = str(tmp_path / "in"), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 8)
    try:
        for part in (checks[:100], checks[100:], gone, back):
            spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(source)
            stream = spark.readStream.schema(SCHEMA).parquet(source)
            RA.start_rank_drop_alerts(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lateness="1 day", forget_days=30).awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    got = values(spark.read.parquet(str(tmp_path / "out")), "keyword", "old_position", "new_position")
    assert got == sorted([*want, ("new", 1, 50)])  # the state of "old" had expired


def test_digest_of_a_table_counts_the_last_check_of_the_week(spark):
    rows = [("d", "a", 30, _day(1), 1), ("d", "a", 4, _day(2), 2), ("d", "b", 12, _day(1), 3), ("d", "c", None, _day(1), 4)]
    out = RA.weekly_digest(spark.createDataFrame(rows, SCHEMA))
    assert values(out, "domain", "tracked", "top_10", "top_30", "rest") == [("d", 3, 1, 1, 1)]
    assert RA.digest_examples(RK.latest_positions(spark.createDataFrame(rows, SCHEMA))).count() == 3


def test_status_upsert_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "status")
    schema = "project_id long, url string, issue_type string, status string, updated_at timestamp"
    one = spark.createDataFrame([(1, "u", "t", "open", _day(1)), (2, "v", "t", "open", _day(1))], schema)
    two = spark.createDataFrame([(1, "u", "t", "fixed", _day(2)), (1, "u", "s", "open", _day(2)), (2, "v", "t", "old", _day(1) - dt.timedelta(days=3))], schema)
    for epoch, batch in ((0, one), (1, two), (1, two), (20, two)):
        CF.upsert_status(batch, path, epoch)
    want = values(CF.statuses(spark, path), "project_id", "url", "issue_type", "status")
    CF.compact_statuses(spark, path)
    assert [r.epoch for r in spark.read.parquet(path).select("epoch").distinct().collect()] == [20]
    assert values(CF.statuses(spark, path), "project_id", "url", "issue_type", "status") == want
    assert values(CF.statuses(spark, path), "project_id", "issue_type", "status") == [(1, "s", "open"), (1, "t", "fixed"), (2, "t", "open")]
    assert values(CF.latest_status(one.unionByName(two)), "project_id", "issue_type", "status") == values(CF.statuses(spark, path), "project_id", "issue_type", "status")


def test_ingest_and_progress(spark, tmp_path):
    html = "<title>Home</title><h1>x</h1>"
    spark.createDataFrame([("https://a.com/", html), ("https://a.com/p", "")], "url string, html string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, html string").parquet(str(tmp_path / "in"))
    out = CF.run_to_table(CF.ingest(stream).select("url", "issues"), str(tmp_path / "out"), str(tmp_path / "cp"))
    labels = {r.url: set(r.issues) for r in out.collect()}
    assert "Title Too Short" not in labels["https://a.com/"] and "Missing Title" in labels["https://a.com/p"]
    arrivals = spark.createDataFrame([("j", False, _day(1)), ("j", True, _day(2))], "job_id string, is_error boolean, arrived_at timestamp")
    assert values(CF.crawl_progress(arrivals), "job_id", "crawled", "errors") == [("j", 2, 1)]


def test_checks_in_many_files_give_the_alerts_of_their_order(spark, tmp_path):
    """Of a table in many files each span of days is one batch; no check is met after a later one of its key."""
    from rankloom import catalog
    from rankloom.catalog import rank_queries

    catalog.load()
    rng = random.Random(3)
    rows = [(i, i % 7, float(rng.randrange(70)), _day(1) + dt.timedelta(minutes=37 * i), "view") for i in range(1000)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, value double, ts timestamp_ntz, event_type string")
    events.repartition(6).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.QUERIES["str_01_rank_drop_alerts"](spark, str(tmp_path))
    want = RK.rank_drops(rank_queries.checks(spark, str(tmp_path)))
    columns = ("domain", "keyword", "checked_at", "old_position", "new_position")
    assert values(got, *columns) == values(want, *columns) and got.count() > 100
