"""Order flow from ticks and from buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import bucket_start

SHARES = 100


def tick_buckets(ticks: DataFrame, minutes: int = 5, *, big_share: float | None = None) -> DataFrame:
    """Buckets of trades: volumes by side in shares, order-flow imbalance, counts, sizes, intensity and realised volatility.

    Status 0 buys, 1 sells, others are neutral. Returns are simple, between trades of one bucket in order of time and
    seq, where the earlier price is positive. Rows without a time are dropped. Big trades are 0 unless ``big_share``
    is given: then those of at least that share of the bucket's volume count.
    """
    rows = ticks.filter("time is not null").withColumn("bucket_start_time", bucket_start(F.col("time"), minutes)).withColumn("v", F.col("volume_hand") * SHARES)
    bucket = Window.partitionBy("symbol", "bucket_start_time")
    order = bucket.orderBy("time", "seq")
    prior = F.lag("price_li").over(order)
    rows = rows.withColumn("r", F.when(prior > 0, F.col("price_li").cast("double") / prior - 1))
    big = F.lit(False) if big_share is None else F.col("v") >= F.lit(big_share) * F.sum("v").over(bucket)
    rows = rows.withColumn("big", big)
    side = lambda k: F.sum(F.when(k, F.col("v")).otherwise(0))
    out = rows.groupBy("symbol", "bucket_start_time").agg(
        side(F.col("status") == 0).alias("buy_volume"), side(F.col("status") == 1).alias("sell_volume"), side(F.coalesce(~F.col("status").isin(0, 1), F.lit(True))).alias("neutral_volume"),
        side(F.col("big")).alias("big_trade_volume"), F.count_if("big").alias("big_trade_count"), F.sum("v").alias("total_volume"), F.count("*").alias("trade_count"), F.coalesce(F.sqrt(F.sum(F.col("r") * F.col("r"))), F.lit(0.0)).alias("realized_vol"),
    )
    b, s = F.col("buy_volume"), F.col("sell_volume")
    return out.withColumns(
        {
            "freq": F.lit(f"{minutes}m"),
            "order_flow_imbalance": F.when(b + s > 0, (b - s).cast("double") / (b + s)).otherwise(0.0),
            "big_trade_ratio": F.coalesce(F.try_divide(F.col("big_trade_volume").cast("double"), F.col("total_volume")), F.lit(0.0)),
            "avg_trade_size": F.col("total_volume").cast("double") / F.col("trade_count"),
            "intensity": F.col("trade_count").cast("double") / minutes,
        }
    )


def daily_features(buckets: DataFrame) -> DataFrame:
    """Daily sums of buckets, realised volatility, imbalance and big-trade ratio (0 where nothing was traded)."""
    out = buckets.groupBy("symbol", F.to_date("bucket_start_time").alias("trade_date")).agg(
        *(F.sum(c).alias(c) for c in ("buy_volume", "sell_volume", "neutral_volume", "big_trade_volume", "big_trade_count", "total_volume", "trade_count")),
        F.sqrt(F.sum(F.col("realized_vol") * F.col("realized_vol"))).alias("intraday_realized_vol"),
    )
    share = lambda a: F.coalesce(F.try_divide(a.cast("double"), F.col("total_volume")), F.lit(0.0))
    return out.withColumn("intraday_volume_imbalance", share(F.col("buy_volume") - F.col("sell_volume"))).withColumn("big_trade_ratio", share(F.col("big_trade_volume")))


def vwap(bars: DataFrame, *, symbol: str = "ts_code", time: str = "trade_time") -> DataFrame:
    """Daily volume-weighted price in yuan: amount in li by volume in hands, null without volume."""
    out = bars.groupBy(symbol, F.to_date(time).alias("trade_date")).agg(F.sum("amount_li").alias("a"), F.sum("volume_hand").alias("v"), F.max_by("close_li", time).alias("c"), F.max("high_li").alias("h"), F.min("low_li").alias("l"))
    close, w = F.col("c") / 1000.0, F.when(F.col("v") > 0, F.col("a") / (F.col("v") * 100000.0))
    return out.select(symbol, "trade_date", w.alias("vwap"), F.try_divide(close - w, w).alias("close_vs_vwap"), F.try_divide((F.col("h") - F.col("l")) / 1000.0, close).alias("intraday_high_low_ratio"))


def hourly_features(buckets: DataFrame) -> DataFrame:
    """Buckets rolled up to hours, with mean trade size and trades a minute."""
    out = buckets.groupBy("symbol", F.date_trunc("hour", "bucket_start_time").alias("hour")).agg(*(F.sum(c).alias(c) for c in ("buy_volume", "sell_volume", "neutral_volume", "total_volume", "trade_count")), F.sqrt(F.sum(F.col("realized_vol") * F.col("realized_vol"))).alias("realized_vol"))
    n = F.col("trade_count").cast("double")
    return out.withColumn("avg_trade_size", F.try_divide(F.col("total_volume").cast("double"), n)).withColumn("intensity", n / 60)


def with_flow(bars: DataFrame, buckets: DataFrame, *, symbol: str = "ts_code", time: str = "bucket") -> DataFrame:
    """Bars of all symbols with the order flow of their bucket, where there is one."""
    flow = buckets.withColumnRenamed("symbol", symbol).withColumnRenamed("bucket_start_time", time).drop("freq")
    return bars.join(flow, [symbol, time], "left")


def daily_model_panel(daily: DataFrame, features: DataFrame, prices: DataFrame, *, symbol: str = "ts_code") -> DataFrame:
    """Daily bars with intraday features and vwap columns, each null where there is none."""
    return daily.join(features.withColumnRenamed("symbol", symbol), [symbol, "trade_date"], "left").join(prices, [symbol, "trade_date"], "left")
