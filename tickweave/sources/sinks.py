"""Keyed writes, incremental state and snapshots on Parquet.

A table that is changed is never read and overwritten in one plan. A ``Table`` writes its new state beside the old one
and names it in a new pointer file last. Tables that grow by time are put in by partition (``upsert_partitions``): only
the partitions that a delta touches are written again, by way of a staging folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from ..operators.windows import latest
from .scans import on_days


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _winner(columns: list[str], order: str | None) -> list[Column]:
    """Which of a delta's rows of one key wins: the largest order, then the largest row, so that results are always the same."""
    row = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)))
    return [*([F.desc_nulls_last(order)] if order else []), F.desc(row)]


def merged(base: DataFrame, delta: DataFrame, keys: list[str], *, order: str | None = None) -> DataFrame:
    """Base with delta's rows put in by key, delta winning; among delta's rows of one key the largest ``order``, then row.

    Null keys are equal to each other, unlike in an insert that ignores conflicts.
    """
    tagged = base.withColumn("__new", F.lit(0)).unionByName(delta.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return latest(tagged, key=keys, order=[F.desc("__new"), *_winner(delta.columns, order)]).drop("__new")


def absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Delta's rows whose key base lacks, one for each key. A key with a null part never conflicts, so such rows all count."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    fresh = delta.filter(whole).dropDuplicates(keys).join(base.select(*keys).distinct(), keys, "left_anti")
    return fresh.unionByName(delta.filter(~whole))


def last_of_batch(delta: DataFrame, keys: list[str], *, order: str) -> DataFrame:
    """The last row of each key by arrival; rows with a blank key part are dropped."""
    for k in keys:
        delta = delta.filter(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    return latest(delta, key=keys, order=[F.desc(order)])


def first_stored(df: DataFrame, *, id_col: str = "id") -> DataFrame:
    """Of news with one source, time and external id (null as empty) the row with the least id."""
    keys = df.withColumn("__x", F.coalesce("external_id", F.lit("")))
    return latest(keys, key=["source", "publish_time", "__x"], order=[F.col(id_col)]).drop("__x")


class Table:
    """A Parquet table of versions below a folder; readers see the version that the last pointer file names.

    Pointer files are numbered and created only if absent, so of two writers at once one fails and may try again.
    The version before stays for readers that are under way; older ones are deleted.
    """

    KEPT_VERSIONS = 2

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[tuple[int, str]]:
        """Number and version of each pointer file, oldest first: a handful."""
        if not self.exists():
            return []
        rows = self.spark.read.schema("n long, version string").json(f"{self.folder}/_versions").collect()
        return sorted((r["n"], r["version"]) for r in rows)

    def exists(self) -> bool:
        return _exists(self.spark, f"{self.folder}/_versions")

    def read(self) -> DataFrame:
        if _exists(self.spark, f"{self.folder}/parts"):
            return self.spark.read.parquet(f"{self.folder}/parts")
        return self.spark.read.parquet(f"{self.folder}/{self._versions()[-1][1]}")

    def replace(self, df: DataFrame, partition_by: list[str] | None = None) -> None:
        """Write a new version, then point to it. A failed write leaves the old version current."""
        known = self._versions()
        n = known[-1][0] + 1 if known else 1
        version = f"v{n:08d}-{uuid.uuid4().hex[:8]}"
        df.write.partitionBy(*(partition_by or [])).parquet(f"{self.folder}/{version}")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_versions/{n:08d}.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False)
        out.write(bytearray(json.dumps({"n": n, "version": version}).encode()))
        out.close()
        for m, old in known[: -(self.KEPT_VERSIONS - 1)]:
            _delete(self.spark, f"{self.folder}/_versions/{m:08d}.json")
            _delete(self.spark, f"{self.folder}/{old}")

    def upsert(self, delta: DataFrame, keys: list[str], *, order: str | None = None) -> None:
        self.replace(merged(self.read(), delta, keys, order=order) if self.exists() else latest(delta, key=keys, order=_winner(delta.columns, order)))

    def put(self, delta: DataFrame, keys: list[str], *, partition: str, order: str | None = None) -> None:
        """Put rows in by key where the table is kept by a partition column and not by versions."""
        upsert_partitions(delta, f"{self.folder}/parts", keys, partition=partition, order=order)

    def insert_absent(self, delta: DataFrame, keys: list[str]) -> None:
        """Add rows whose key is absent, as a new version. For tables that grow, ``keyed.KeyedStore`` writes the new rows only."""
        self.replace(self.read().unionByName(absent(self.read(), delta, keys)) if self.exists() else absent(delta.limit(0), delta, keys))

    def keep_since(self, time: str, since: str) -> None:
        """Drop rows older than a time, as a new version. ``keyed.KeyedStore`` drops partitions by name."""
        self.replace(self.read().filter(F.col(time) >= F.lit(since).cast("timestamp")))


def upsert_partitions(delta: DataFrame, folder: str, keys: list[str], *, partition: str, order: str | None = None) -> None:
    """Put rows into a table by key, reading and writing only the partitions that they touch.

    A key belongs to one partition. Partitions are put in one after another: a reader may see some of them new and some
    old, and two writers at once are not told apart; one writer a table. A delta that comes twice changes nothing. A run that fails while it stages leaves
    the table as it was; one that fails while it puts the partitions in is mended by the same delta again.
    """
    spark, rows = delta.sparkSession, latest(delta, key=keys, order=_winner(delta.columns, order))
    if not _exists(spark, folder):
        rows.repartition(partition).write.partitionBy(partition).parquet(folder)
        return
    staging = f"{folder.rstrip('/')}-staging-{uuid.uuid4().hex}"
    rows.write.parquet(f"{staging}/delta")  # worked out once: what is touched and what is put in are the same rows
    fresh = spark.read.schema(rows.schema).parquet(f"{staging}/delta")
    touched = fresh.select(partition).distinct()
    old = spark.read.parquet(folder).withColumn(partition, F.col(partition).cast(delta.schema[partition].dataType)).join(touched, partition, "left_semi")
    # The delta has one row a key by now, so stored rows need no text of the whole row to sort by.
    both = old.select(*delta.columns).withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    plain = [F.desc(f"`{f.name}`") for f in fresh.schema if isinstance(f.dataType, AtomicType) and f.name not in keys]
    latest(both, key=keys, order=[F.desc("__new"), *plain]).drop("__new").write.parquet(f"{staging}/whole")
    spark.read.parquet(f"{staging}/whole").repartition(partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)
    _delete(spark, staging)


def instrument_spans(bars: DataFrame, *, symbol: str = "instrument", time: str = "datetime") -> DataFrame:
    return bars.groupBy(symbol).agg(F.min(F.to_date(time)).alias("first_day"), F.max(F.to_date(time)).alias("last_day"))


def write_snapshot(bars: DataFrame, folder: str, *, name: str, symbol: str = "instrument", time: str = "datetime", grain: str = "day") -> None:
    """bars/ (by ``date``), instruments/, calendars/, counts/ (by date) and meta/ of a snapshot. Daily bars, few a day,
    may go by ``month``."""
    bars.withColumn("date", F.date_trunc(grain, time).cast("date")).repartition("date").write.mode("overwrite").partitionBy("date").parquet(f"{folder}/bars")
    stored = bars.sparkSession.read.parquet(f"{folder}/bars")
    instrument_spans(stored, symbol=symbol, time=time).write.mode("overwrite").parquet(f"{folder}/instruments")
    stored.select(F.to_date(time).alias("date")).distinct().write.mode("overwrite").parquet(f"{folder}/calendars")
    stored.groupBy("date").agg(F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{folder}/counts")
    _describe_snapshot(bars.sparkSession, folder, name)


def _describe_snapshot(spark: SparkSession, folder: str, name: str) -> None:
    """Meta of a snapshot from its counts and calendar."""
    rows = spark.read.parquet(f"{folder}/counts").agg(F.lit(name).alias("snapshot"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    days = spark.read.parquet(f"{folder}/calendars").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    rows.crossJoin(days).write.mode("overwrite").parquet(f"{folder}/meta")  # one row each


def _rewrite(df: DataFrame, folder: str) -> None:
    """Write a small table that is made from what is in its folder, by way of a staging folder."""
    staging = f"{folder}-staging-{uuid.uuid4().hex}"
    df.write.parquet(staging)
    df.sparkSession.read.schema(df.schema).parquet(staging).write.mode("overwrite").parquet(folder)
    _delete(df.sparkSession, staging)


def append_snapshot(delta: DataFrame, folder: str, keys: list[str], *, symbol: str = "instrument", time: str = "datetime", grain: str = "day") -> None:
    """Put new rows into a snapshot by key, and merge what describes it; ``grain`` as it was written with.

    Only partitions that the delta touches are read and written. Keys never go away, so spans and calendar of the delta
    are merged with those that are known, and rows are counted anew in the touched partitions only. The same append
    again changes nothing.
    """
    spark = delta.sparkSession
    name = spark.read.parquet(f"{folder}/meta").first()["snapshot"]  # one row
    dated = delta.withColumn("date", F.date_trunc(grain, time).cast("date"))
    upsert_partitions(dated, f"{folder}/bars", keys, partition="date")
    known = spark.read.parquet(f"{folder}/instruments")
    spans = known.unionByName(instrument_spans(delta, symbol=symbol, time=time)).groupBy(symbol).agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
    _rewrite(spans, f"{folder}/instruments")
    _rewrite(spark.read.parquet(f"{folder}/calendars").unionByName(delta.select(F.to_date(time).alias("date"))).distinct(), f"{folder}/calendars")
    touched = [r["date"] for r in dated.select("date").distinct().collect()]  # partitions of the delta, by which files are chosen
    rows = lambda at: at.groupBy("date").agg(F.count("*").alias("rows"))
    fresh, counts = rows(spark.read.parquet(f"{folder}/bars").filter(F.col("date").isin(touched))), spark.read.parquet(f"{folder}/counts")
    _rewrite(counts.filter(F.col("date").isNull() | ~F.col("date").isin(touched)).unionByName(fresh), f"{folder}/counts")
    _describe_snapshot(spark, folder, name)


def watermark(state: DataFrame, snapshot: str, kind: str) -> DataFrame:
    """The state row of a snapshot's data type, or none."""
    return state.filter((F.col("snapshot_id") == snapshot) & (F.col("data_type") == kind))


def with_watermark(state: DataFrame, new: DataFrame) -> DataFrame:
    """State with the last times of some snapshots and data types set."""
    return merged(state, new, ["snapshot_id", "data_type"], order="last_datetime")


def without_watermark(state: DataFrame, snapshot: str, kind: str | None = None) -> DataFrame:
    """State without a snapshot, or without one of its data types."""
    gone = F.col("snapshot_id") == snapshot
    return state.filter(~(gone if kind is None else gone & (F.col("data_type") == kind)))


def without_watermarks(state: DataFrame, gone: DataFrame) -> DataFrame:
    """State without the snapshots and data types that a table names."""
    return state.join(gone.select("snapshot_id", "data_type").distinct(), ["snapshot_id", "data_type"], "left_anti").select(*state.columns)


def export_start(state: DataFrame, snapshot: str, kind: str, end: str, *, step: str = "1 day", back_days: int = 30) -> DataFrame:
    """One row: where an export starts, and whether it is empty. The step after the last time, or so many days before the end."""
    last = state.filter((F.col("snapshot_id") == snapshot) & (F.col("data_type") == kind)).agg(F.max("last_datetime").alias("last"))
    until = F.lit(end).cast("date")
    start = F.coalesce(F.to_date(F.col("last") + F.expr(f"INTERVAL {step}")), F.date_sub(until, back_days))
    return last.select(start.alias("start_day"), until.alias("end_day"), (start > until).alias("empty"))


def resume(data: DataFrame, state: DataFrame, *, symbol: str = "symbol", day: str = "trade_date", requested: str | None = None, explicit: bool = False) -> DataFrame:
    """Rows after each symbol's last success and from the requested day on; an explicit request ignores the state."""
    rows = data if requested is None else data.filter(F.col(day) >= F.lit(requested).cast("date"))
    if explicit:
        return rows
    last = state.groupBy(symbol).agg(F.max("last_success").alias("__last"))
    return rows.join(last, symbol, "left").filter(F.col("__last").isNull() | (F.col(day) > F.col("__last"))).drop("__last")


def write_csv_per_symbol(bars: DataFrame, folder: str, *, symbol: str = "symbol") -> None:
    """A folder of CSV for each symbol: date, symbol, open, high, low, close, volume, amount; a missing amount is 0."""
    cols = ["date", F.col(symbol).alias("symbol"), "open", "high", "low", "close", "volume", F.coalesce("amount", F.lit(0.0)).alias("amount")]
    rows = bars.select(*cols, F.col(symbol).alias("of"))
    rows.repartition("of").sortWithinPartitions("of", "date").write.mode("overwrite").partitionBy("of").option("header", True).csv(folder)


def next_versions(captures: DataFrame, new: DataFrame) -> DataFrame:
    """New captures with the version after the largest of their date and type."""
    last = captures.groupBy("data_date", "data_type").agg(F.max("version").alias("__v"))
    return new.join(last, ["data_date", "data_type"], "left").withColumn("version", F.coalesce("__v", F.lit(0)) + 1).drop("__v")


def latest_capture(captures: DataFrame, *, since: str | None = None) -> DataFrame:
    """The latest successful capture of each type, by date and version; only such as were made since a time, if given."""
    rows = captures.filter("fetch_success")
    rows = rows if since is None else rows.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return latest(rows, key="data_type", order=[F.desc("data_date"), F.desc("version")])


def day_check(bars: DataFrame, day: str, *, symbol: str = "ts_code", time: str = "trade_time") -> DataFrame:
    rows = bars.filter(on_days(time, day, day))
    return rows.groupBy(symbol).agg(F.count("*").alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def without_day(bars: DataFrame, day: str, *, time: str = "trade_time") -> DataFrame:
    """Everything but one day, for loading that day anew."""
    return bars.filter(F.col(time).isNull() | ~on_days(time, day, day))
