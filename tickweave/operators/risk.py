"""Risk views: lock-up expiries, holder trades, filings, positions and live quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import cut
from .windows import latest


def lockups(df: DataFrame, base: str, *, day: str = "float_date") -> DataFrame:
    """Expiries of the year before a date (``history``) and of the year from it on (``upcoming``)."""
    d, at = F.col(day), F.lit(base).cast("date")
    kind = F.when((d < at) & (d >= F.date_sub(at, 365)), "history").when((d >= at) & (d <= F.date_add(at, 365)), "upcoming")
    return df.withColumn("window", kind).filter(F.col("window").isNotNull())


def holder_trades(df: DataFrame, today: str, *, key: str = "ts_code", day: str = "ann_date", change: str = "change", tie: str | None = None, n: int = 30) -> DataFrame:
    """Of the newest n trades in the last 365 days: rows, sells, latest sell and latest trade."""
    at = F.lit(today).cast("date")
    rows = df.filter((F.col(day) <= at) & (F.col(day) > F.date_sub(at, 365)))
    rows = latest(rows, n, key=key, order=[F.desc(day), *([F.desc(tie)] if tie else [])])
    return rows.groupBy(key).agg(F.count("*").alias("trades"), F.count_if(F.col(change) < 0).alias("sells"), F.max(F.when(F.col(change) < 0, F.col(day))).alias("latest_sell"), F.max(day).alias("latest_trade"))


def recent_filings(df: DataFrame, today: str, *, key: str = "ts_code", day: str = "ann_date", text: str = "content", tie: str, n: int = 60, days: int = 120, length: int = 400) -> DataFrame:
    """The newest n filings of the last days, with summaries cut to a length."""
    at = F.lit(today).cast("date")
    rows = latest(df.filter((F.col(day) <= at) & (F.col(day) > F.date_sub(at, days))), n, key=key, order=[F.desc(day), F.desc(tie)])
    return rows.withColumn("summary", cut(F.col(text), length, ""))


def positions(df: DataFrame, *, total_assets: float) -> DataFrame:
    """Market value, profit, profit in percent and exposure of positions with quantity, cost_price and price."""
    value, cost = F.col("quantity") * F.col("price"), F.col("quantity") * F.col("cost_price")
    return df.withColumns({"market_value": value, "pnl": value - cost, "pnl_pct": F.try_divide((value - cost) * 100.0, cost), "exposure": value / total_assets})


def lot_size(total: Column, pct: float, cash: Column, price: Column, lot: int = 100) -> Column:
    """Shares to buy with a part of all assets, cash at most, in whole lots; 0 unless the price is positive."""
    return F.when(price > 0, F.floor(F.least(total * pct, cash) / price / lot) * lot).otherwise(0).cast("long")


def enrich_quotes(items: DataFrame, quotes: DataFrame, *, key: str = "ts_code") -> DataFrame:
    """Items with last price, change against the previous close and volume in hands, where there is a quote."""
    q = quotes.select(key, "last_li", F.try_divide((F.col("last_li") - F.col("pre_close_li")) * 100.0, F.col("pre_close_li")).alias("pct"), F.floor(F.col("volume") / 100).alias("volume_hand"))
    return items.join(q, key, "left")
