"""Bar roll-ups and interval aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import bucket_start
from .windows import latest


def rolled(time: str) -> list[Column]:
    """First open, largest high, least low, last close and sums, by a time of the rows."""
    return [F.min_by("open_li", time).alias("open_li"), F.max("high_li").alias("high_li"), F.min("low_li").alias("low_li"), F.max_by("close_li", time).alias("close_li"), F.sum("volume_hand").alias("volume_hand"), F.sum("amount_li").alias("amount_li")]


def resample(bars: DataFrame, minutes: int, *, symbol: str = "ts_code", time: str = "trade_time") -> DataFrame:
    """Minute bars in buckets of 5, 15 or 60 minutes from midnight."""
    return bars.groupBy(symbol, bucket_start(F.col(time), minutes).alias("bucket")).agg(*rolled(time)).withColumn("freq", F.lit(f"{minutes}m"))


def weekly(bars: DataFrame, start: str | None = None, end: str | None = None, *, symbol: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """Weekly bars, labelled by the Friday. A start within a week counts from its Monday."""
    if start:
        bars = bars.filter(F.col(time) >= F.date_trunc("week", F.lit(start).cast("date")).cast("date"))
    if end:
        bars = bars.filter(F.col(time) <= F.lit(end).cast("date"))
    return bars.groupBy(symbol, F.date_add(F.date_trunc("week", time).cast("date"), 4).alias("week_end_date")).agg(*rolled(time))


def daily_close(bars: DataFrame, *, symbol: str = "ts_code", time: str = "bucket") -> DataFrame:
    """Last close and sum of amount of each day of intraday bars."""
    return bars.groupBy(symbol, F.to_date(time).alias("trade_date")).agg(F.max_by("close_li", time).alias("close_li"), F.sum("amount_li").alias("amount_li"))


def opening_window(bars: DataFrame, start: str = "09:30", end: str = "09:35", *, symbol: str = "ts_code", time: str = "trade_time") -> DataFrame:
    """First and last price, change and volume of the bars from start to end (both included); null change unless open is positive."""
    clock = F.hour(time) * 60 + F.minute(time)
    minutes = lambda text: int(text[:2]) * 60 + int(text[3:5])
    rows = bars.filter(clock.between(minutes(start), minutes(end)))
    out = rows.groupBy(symbol, F.to_date(time).alias("trade_date")).agg(F.min_by("open_li", time).alias("first_li"), F.max_by("close_li", time).alias("last_li"), F.sum("volume_hand").alias("volume_hand"))
    return out.withColumn("pct", F.when(F.col("first_li") > 0, (F.col("last_li") - F.col("first_li")) / F.col("first_li").cast("double") * 100))


def window_sum(flows: DataFrame, end: str, days: int, *, value: str, symbol: str = "ts_code", time: str = "trade_date", calendar: DataFrame | None = None) -> DataFrame:
    """Sum of a flow over so many calendar days up to a date; with a calendar, over so many trading days."""
    last = F.lit(end).cast("date")
    rows = flows.filter((F.col(time) <= last) & (F.col(time) > F.date_sub(last, days))) if calendar is None else flows.filter(F.col(time) <= last)
    if calendar is not None:
        open_days = calendar.filter(F.col("is_trading") & (F.col("cal_date") <= last)).orderBy(F.desc("cal_date")).limit(days)
        rows = rows.join(F.broadcast(open_days.select(F.col("cal_date").alias(time))), time, "left_semi")  # `days` rows
    return rows.groupBy(symbol).agg(F.sum(value).alias(f"{value}_sum"), F.count("*").alias("rows"))


def turnover_trend(amounts: DataFrame, n: int = 10, *, time: str = "trade_date", value: str = "amount") -> DataFrame:
    """Market turnover of the last n dates: latest, mean of the earlier ones, their ratio and a label."""
    days = amounts.groupBy(time).agg(F.sum(value).alias("total")).orderBy(F.desc(time)).limit(n)
    days = latest(days.withColumn("k", F.lit(1)), n, key="k", order=[F.desc(time)], rank="rank")
    out = days.agg(F.max(time).alias("latest_date"), F.max(F.when(F.col("rank") == 1, F.col("total"))).alias("latest"), F.avg(F.when(F.col("rank") > 1, F.col("total"))).alias("earlier"))
    r = F.try_divide(F.col("latest").cast("double"), F.col("earlier"))
    return out.withColumn("ratio", r).withColumn("label", F.when(r >= 1.05, "expanding").when(r <= 0.95, "shrinking").when(r.isNotNull(), "steady"))
