"""Calendar coverage, gaps, load ranges and table statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import any_date
from ..sources.scans import on_days
from .windows import by, islands


def open_days(calendar: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    days = calendar.filter("is_trading").select("cal_date")
    days = days if start is None else days.filter(F.col("cal_date") >= F.lit(start).cast("date"))
    return days if end is None else days.filter(F.col("cal_date") <= F.lit(end).cast("date"))


def days_with_data(calendar: DataFrame, data: DataFrame, *, time: str) -> DataFrame:
    return calendar.join(data.select(F.to_date(time).alias("cal_date")).distinct(), "cal_date", "left_semi")


def missing_days(calendar: DataFrame, data: DataFrame, *, time: str) -> DataFrame:
    return calendar.join(data.select(F.to_date(time).alias("cal_date")).distinct(), "cal_date", "left_anti")


def gap_ranges(calendar: DataFrame, data: DataFrame, *, time: str, adjacent: str = "calendar") -> DataFrame:
    """Ranges of trading days without data; adjacent in the calendar, or as trading days (``trading``)."""
    days = open_days(calendar)
    if adjacent == "calendar":
        return islands(missing_days(days, data, time=time).withColumn("k", F.lit(1)), day="cal_date", keys=["k"]).drop("k")
    numbered = days.withColumn("k", F.lit(1)).withColumn("n", F.row_number().over(by("k", "cal_date")))  # one row a day of the calendar
    lacking = missing_days(numbered, data, time=time)
    return lacking.withColumn("i", F.col("n") - F.row_number().over(by("k", "cal_date"))).groupBy("i").agg(F.min("cal_date").alias("first_day"), F.max("cal_date").alias("last_day"), F.count("*").alias("days")).drop("i")


def gap_report(calendar: DataFrame, data: DataFrame, *, time: str, symbol: str, start: str, end: str) -> DataFrame:
    """One row: trading, covered and missing days of a range, ranges of missing days, distinct symbols."""
    days = open_days(calendar, start, end)
    rows = data.filter(on_days(time, start, end))
    trading, covered = days.agg(F.count("*").alias("trading_days")), days_with_data(days, rows, time=time).agg(F.count("*").alias("covered_days"))
    gaps = gap_ranges(days.withColumn("is_trading", F.lit(True)), rows, time=time).agg(F.count("*").alias("gap_ranges"))
    out = trading.crossJoin(covered).crossJoin(gaps).crossJoin(rows.agg(F.countDistinct(symbol).alias("symbols")))  # one row each
    return out.withColumn("missing_days", F.col("trading_days") - F.col("covered_days"))


def next_load(calendar: DataFrame, data: DataFrame, today: str, *, time: str, first: str = "1990-01-01") -> DataFrame:
    """One row: the trading day after the latest data (or the first day ever) and the latest trading day up to today."""
    last = data.agg(F.max(F.to_date(time)).alias("last_day"))
    days = open_days(calendar).crossJoin(F.broadcast(last))  # one row
    at = F.lit(today).cast("date")
    out = days.agg(F.max("last_day").alias("last_day"), F.min(F.when(F.col("cal_date") > F.col("last_day"), F.col("cal_date"))).alias("after"), F.max(F.when(F.col("cal_date") <= at, F.col("cal_date"))).alias("end_day"))
    return out.select(F.when(F.col("last_day").isNull(), F.lit(first).cast("date")).otherwise(F.col("after")).alias("start_day"), "end_day", "last_day")


def latest_open_day(calendar: DataFrame, day: str) -> DataFrame:
    return open_days(calendar, end=day).agg(F.max("cal_date").alias("cal_date"))


def index_coverage(data: DataFrame, calendar: DataFrame, *, symbol: str, time: str) -> DataFrame:
    """Per symbol: span, days with data, natural and trading days that lack within its span."""
    have = data.select(symbol, F.to_date(time).alias("d")).distinct()
    spans = have.groupBy(symbol).agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("days"))
    days = open_days(calendar).withColumnRenamed("cal_date", "d")
    traded = have.join(days, "d", "left_semi").groupBy(symbol).agg(F.count("*").alias("traded"))
    wide = spans.crossJoin(F.broadcast(days.agg(F.sort_array(F.collect_list("d")).alias("all"))))  # one row: the calendar, some 250 days a year
    within = F.size(F.filter("all", lambda x: (x >= F.col("first_day")) & (x <= F.col("last_day"))))
    out = wide.withColumn("trading_days", within).drop("all").join(traded, symbol, "left")
    return out.select(symbol, "first_day", "last_day", "days", (F.datediff("last_day", "first_day") + 1 - F.col("days")).alias("natural_missing"), (F.col("trading_days") - F.coalesce("traded", F.lit(0))).alias("trading_missing"))


def rows_per_day(data: DataFrame, *, time: str) -> DataFrame:
    return data.groupBy(F.to_date(time).alias("trade_date")).agg(F.count("*").alias("rows"))


def group_stats(data: DataFrame, *, key: str, time: str, distinct: str | None = None) -> DataFrame:
    return data.groupBy(key).agg(F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.count("*").alias("rows"), *([F.countDistinct(distinct).alias("distinct_values")] if distinct else []))


def dataset_stats(datasets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last day and rows of many tables, a row each."""
    parts = [df.agg(F.lit(name).alias("dataset"), F.min(F.to_date(time)).alias("first_day"), F.max(F.to_date(time)).alias("last_day"), F.count("*").alias("rows")) for name, (df, time) in datasets.items()]
    return reduce(DataFrame.unionByName, parts)


def calendar_rows(raw: DataFrame, *, day: str = "cal_date", open_flag: str = "is_open") -> DataFrame:
    """Calendar rows from vendor records: dates in three shapes, 1 and true are open; rows without a date are dropped.

    To keep a calendar up to date, put these into it by ``cal_date`` (``sinks.merged`` or ``sinks.Table.upsert``).
    """
    flag = F.lower(F.trim(F.col(open_flag).cast("string")))
    return raw.select(any_date(F.col(day).cast("string")).alias("cal_date"), F.coalesce(flag.isin("1", "true"), F.lit(False)).alias("is_trading")).filter("cal_date is not null")
