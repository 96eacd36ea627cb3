"""Rank-drop alerts and weekly digests over a stream of rank checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

KEYS = ["domain", "keyword"]
ALERT_ROWS = "domain string, keyword string, checked_at timestamp, old_position int, new_position int, delta int"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"  # the store that timers need


class RankDrops(StatefulProcessor):
    """Per domain and keyword the last known check; a check that is worse by the threshold or more gives an alert.

    The checks of a batch are compared in the order of time and id, however they arrive; those not after the last known one are ignored.
    A key that has had no check for ``forget_days`` of event time loses its state.
    """

    def __init__(self, threshold: int, forget_days: int) -> None:
        self.threshold, self.forget_ms = threshold, forget_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros long, check_id long, position int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = [(r["micros"].to_numpy(np.int64), r["check_id"].to_numpy(np.int64), r["position"].to_numpy(np.int32)) for r in rows]
        micros, ids, position = (np.concatenate(c) for c in zip(*parts))
        known = self.last.get() if self.last.exists() else None
        if known is not None:
            fresh = (micros > known[0]) | ((micros == known[0]) & (ids > known[1]))
            micros, ids, position = micros[fresh], ids[fresh], position[fresh]
        if not len(micros):
            return
        order = np.lexsort((ids, micros))
        micros, ids, position = micros[order], ids[order], position[order]
        before = np.r_[known[2] if known is not None else position[0], position[:-1]].astype(np.int32)
        self.last.update((int(micros[-1]), int(ids[-1]), int(position[-1])))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(micros[-1]) // 1000 + self.forget_ms)
        worse = position - before >= self.threshold
        if worse.any():
            yield pd.DataFrame({"domain": key[0], "keyword": key[1], "checked_at": pd.to_datetime(micros[worse], unit="us"), "old_position": before[worse],
                                "new_position": position[worse], "delta": (position - before)[worse]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def rank_drop_alerts(checks: DataFrame, threshold: int = 5, lateness: str = "30 days", forget_days: int = 400) -> DataFrame:
    """Stream of alerts over a stream of checks ``domain, keyword, position, checked_at, check_id``; unknown positions change nothing.

    Rows without a domain, keyword, time or id are left out. Checks older than ``lateness`` before the newest one may be dropped by Spark.
    A batch holds twenty bytes a check of its busiest key in memory; the source's batch limits bound that.
    """
    rows = checks.where(" and ".join(f"{c} is not null" for c in (*KEYS, "position", "checked_at", "check_id"))).withWatermark("checked_at", lateness)
    narrow = rows.select(*KEYS, F.col("position").cast("int").alias("position"), F.unix_micros("checked_at").alias("micros"), F.col("check_id").cast("long").alias("check_id"), "checked_at")
    return narrow.groupBy(*KEYS).transformWithStateInPandas(RankDrops(threshold, forget_days), ALERT_ROWS, "Append", "EventTime")


def start_rank_drop_alerts(checks: DataFrame, alerts: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Append the alerts over what is available to the table at ``alerts``; the state of the keys is Spark's own, in the checkpoint folder."""
    spark = checks.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (rank_drop_alerts(checks, **options).writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start(alerts))
    finally:
        spark.conf.set(PROVIDER, before)  # the query has its own copy of the settings


def weekly_digest(checks: DataFrame, span: str = "7 days", watermark: str = "1 day") -> DataFrame:
    """Per domain and week: keywords tracked, in the top 10, in the top 30 and beyond, by their last check of the week.

    Works on a stream (closed weeks are emitted) and on a table.
    """
    rows = checks.withWatermark("checked_at", watermark) if checks.isStreaming else checks
    order = F.struct("checked_at", "check_id") if "check_id" in rows.columns else F.struct("checked_at")
    last = rows.groupBy(F.window("checked_at", span), "domain", "keyword").agg(F.max_by("position", order).alias("position"))
    p = F.coalesce("position", F.lit(1000))
    weeks = last.groupBy(F.window(F.window_time("window"), span).alias("week"), "domain")
    counted = weeks.agg(
        F.count(F.lit(1)).alias("tracked"), F.count_if(p <= 10).alias("top_10"), F.count_if((p > 10) & (p <= 30)).alias("top_30"),
        F.count_if(p > 30).alias("rest"))
    return counted.select(F.col("week.start").alias("week_start"), "domain", "tracked", "top_10", "top_30", "rest")


def digest_examples(latest: DataFrame, shown: int = 5) -> DataFrame:
    """A few keywords of each group (top 10, top 30, rest) per domain, best positions first."""
    from pyspark.sql import Window

    p = F.coalesce("position", F.lit(1000))
    rows = latest.withColumn("band", F.when(p <= 10, "top_10").when(p <= 30, "top_30").otherwise("rest"))
    order = Window.partitionBy("domain", "band").orderBy(p, "keyword")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shown).select("domain", "band", "rank", "keyword", "position")
