"""Streams: buckets, live bars, news without repeats, alerts and due checks.

Additive aggregates run as windows with a watermark. What needs the order of trades within a bucket is computed again
for the buckets that a micro-batch touches. Alerts keep their last time and what waits for the watermark in keyed state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.orderflow import SHARES, tick_buckets
from ..sources.keyed import KeyedStore
from ..sources.sinks import Table, merged

#: Minutes in which an alert of one kind for one stock is not repeated.
QUIET_MINUTES = 60


def tick_stream(ticks: DataFrame, minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Additive order flow of tumbling buckets: volumes by side, trades and total."""
    v = F.col("volume_hand") * SHARES
    side = lambda k: F.sum(F.when(k, v).otherwise(0))
    out = ticks.withWatermark("time", delay).groupBy("symbol", F.window("time", f"{minutes} minutes").alias("w")).agg(
        side(F.col("status") == 0).alias("buy_volume"), side(F.col("status") == 1).alias("sell_volume"), side(F.coalesce(~F.col("status").isin(0, 1), F.lit(True))).alias("neutral_volume"), F.sum(v).alias("total_volume"), F.count("*").alias("trade_count")
    )
    return out.select("symbol", F.col("w.start").alias("bucket_start_time"), "buy_volume", "sell_volume", "neutral_volume", "total_volume", "trade_count")


def live_bars(ticks: DataFrame, minutes: int, delay: str = "10 minutes") -> DataFrame:
    """Bars of tumbling buckets, open and close by time and sequence."""
    out = ticks.withWatermark("time", delay).groupBy("symbol", F.window("time", f"{minutes} minutes").alias("w")).agg(
        F.min_by("price_li", F.struct("time", "seq")).alias("open_li"), F.max("price_li").alias("high_li"), F.min("price_li").alias("low_li"), F.max_by("price_li", F.struct("time", "seq")).alias("close_li"), F.sum("volume_hand").alias("volume_hand")
    )
    return out.select("symbol", F.col("w.start").alias("bucket"), "open_li", "high_li", "low_li", "close_li", "volume_hand")


def news_stream(news: DataFrame, delay: str = "2 days") -> DataFrame:
    """News without what arrived already within ``delay``, by (source, external id, time); without an id, by title.

    The state goes by the time of arrival, so that late news are not lost. What comes again after the delay comes
    through, and is stopped by the keys that ``news_sink`` has stored.
    """
    keyed = news.withColumn("dedup_id", F.coalesce("external_id", F.concat(F.lit("title:"), F.coalesce("title", F.lit("")))))
    arrived = keyed.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", delay)
    return arrived.dropDuplicatesWithinWatermark(["source", "dedup_id", "publish_time"]).drop("arrived")


def news_store(spark: SparkSession, folder: str) -> KeyedStore:
    """Where ``news_sink`` stores news: by day, each key once for all time."""
    return KeyedStore(spark, folder, ["source", "dedup_id", "publish_time"], partition="day")


def news_sink(store: KeyedStore, most_pieces: int = 64) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` behind ``news_stream``: add a batch's news that are not stored yet.

    A batch reads only the stored days whose filters hold one of its keys, and writes only what is new; one that is
    delivered again, or repeats news of any age, writes nothing.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        store.insert(batch.withColumn("day", F.to_date("publish_time")))
        store.compact(most_pieces)

    return run


def bucket_sink(ticks: Table, buckets: Table, minutes: int = 5) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: store the batch's ticks, then compute the buckets that it touches from all stored ticks.

    Both tables are kept by ``date``; a batch reads and writes the days that it touches, whatever the history. A batch
    that is delivered again changes nothing, as both tables are written by key.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("date", F.to_date("time"))
        ticks.put(batch, ["symbol", "seq", "date"], partition="date")
        touched = batch.select("date", "symbol").distinct()
        rows = ticks.read().join(touched, ["date", "symbol"], "left_semi").drop("date")
        made = tick_buckets(rows, minutes).withColumn("date", F.to_date("bucket_start_time"))
        buckets.put(made, ["symbol", "bucket_start_time"], partition="date")

    return run


def triggers(quotes: DataFrame, monitors: DataFrame) -> DataFrame:
    """Alerts that quotes set off: in the entry range, at or above take-profit, at or below stop-loss."""
    p = F.col("price")
    kinds = F.array(
        F.when(p.between(F.col("entry_min"), F.col("entry_max")), "entry"), F.when(p >= F.col("take_profit"), "take_profit"), F.when(p <= F.col("stop_loss"), "stop_loss")
    )
    rows = quotes.join(monitors.filter("notification_enabled"), "symbol")
    return rows.select("symbol", "time", "price", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def quiet(times: list[int], last: int | None, minutes: int = QUIET_MINUTES) -> tuple[list[bool], int | None]:
    """Which of some sorted times (microseconds) are told: not within so many minutes after one that was; and the last told."""
    told = []
    for t in times:
        ok = last is None or t - last >= minutes * 60_000_000
        told.append(ok)
        last = t if ok else last
    return told, last


class QuietAlerts(StatefulProcessor):
    """Tells one stock's triggers of one kind in the order of their time, with QUIET_MINUTES after each that is told.

    A trigger waits in state until the watermark has passed its time; no earlier one can come then, so what is told
    depends neither on micro-batches nor on the order within them. One state value holds the last time told and the
    waiting triggers, at most those of the watermark's delay; a timer stands at the first of them, and then where the
    quiet time ends and the state can go.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alerts", "last long, times array<long>, prices array<double>")

    def _store(self, last: int | None, waiting: dict[int, float], watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not waiting and (last is None or last + QUIET_MINUTES * 60_000_000 <= watermark * 1000):
            self.state.clear()
            return
        times = sorted(waiting)
        self.state.update((last, times, [waiting[t] for t in times]))
        self.handle.registerTimer(max(watermark + 1, -(-times[0] // 1000) if times else last // 1000 + QUIET_MINUTES * 60_000 + 1))

    def _stored(self) -> tuple[int | None, dict[int, float]]:
        if not self.state.exists():
            return None, {}
        last, times, prices = self.state.get()
        return last, dict(zip(times, prices, strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last, waiting = self._stored()
        for some in rows:  # of triggers at one time the one of the least price is told
            least = some.groupby("time")["price"].min()
            for t, price in zip(least.index.astype("datetime64[us]").astype("int64"), least, strict=True):
                waiting[int(t)] = min(float(price), waiting.get(int(t), float(price)))
        self._store(last, waiting, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        last, waiting = self._stored()
        due = sorted(t for t in waiting if t <= watermark * 1000)
        told, last = quiet(due, last)
        out = [t for t, ok in zip(due, told, strict=True) if ok]
        prices = [waiting[t] for t in out]
        for t in due:
            del waiting[t]
        self._store(last, waiting, watermark)
        if out:
            yield pd.DataFrame({"symbol": key[0], "kind": key[1], "time": pd.to_datetime(out, unit="us"), "price": prices})


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in the store that ``alert_stream`` needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def alert_stream(quotes: DataFrame, monitors: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Alerts of a stream of quotes, each stock and kind at most once in QUIET_MINUTES; start it within ``keyed_state``.

    All quotes move the watermark, with or without an alert; an alert comes out when the watermark has passed it, so
    after ``delay``. Quotes that come later than that are left out. State outlives restarts from the checkpoint.
    """
    found = triggers(quotes.withWatermark("time", delay), monitors)
    return found.groupBy("symbol", "kind").transformWithStateInPandas(QuietAlerts(), "symbol string, kind string, time timestamp, price double", "append", "EventTime")


def alerts(found: DataFrame) -> DataFrame:
    """The same over a table: one group is the alerts of one stock and kind."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["time", "price"], kind="stable")
        told, _ = quiet([t.value // 1000 for t in pdf["time"].astype("datetime64[ns]")], None)
        return pdf[told][["symbol", "kind", "time", "price"]]

    return found.groupBy("symbol", "kind").applyInPandas(run, "symbol string, kind string, time timestamp, price double")


def due(monitors: DataFrame, now: str) -> DataFrame:
    """Monitors never checked, or whose last check and interval in minutes have passed."""
    at = F.lit(now).cast("timestamp")
    return monitors.filter(F.col("last_checked").isNull() | (F.timestamp_add("MINUTE", F.col("check_interval"), F.col("last_checked")) <= at))


def feed(notifications: DataFrame, monitors: DataFrame, n: int, *, status: str | None = None) -> DataFrame:
    """The newest notifications with their monitor's name, of one status if given."""
    rows = notifications if status is None else notifications.filter(F.col("status") == status)
    return rows.join(monitors.select("symbol", "name"), "symbol", "left").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def replay(batch: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What a table holds after a batch, also if the batch comes twice."""
    return merged(stored, batch, keys)
