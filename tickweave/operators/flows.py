"""Money flow and cost distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest


def net_flows(flows: DataFrame, n: int | None = None, *, symbol: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """Net amounts by order size, main flow (large and extra large) and its share; the last n days of each symbol, if given."""
    net = {f"net_{s}": F.col(f"buy_{s}_amount") - F.col(f"sell_{s}_amount") for s in ("sm", "md", "lg", "elg")}
    out = flows.withColumns(net).withColumn("net_main", F.col("net_lg") + F.col("net_elg"))
    traded = sum((F.col(f"{side}_{s}_amount") for side in ("buy", "sell") for s in ("sm", "md", "lg", "elg")), F.lit(0))
    out = out.withColumn("main_share", F.try_divide(F.col("net_main") * 100.0, traded)).select(symbol, time, *net, "net_main", "main_share")
    return out if n is None else latest(out, n, key=symbol, order=[F.desc(time)])


def main_ratio(main: Column, total: Column) -> Column:
    """Main flow as a share, as text; ``N/A`` without a total."""
    share = F.try_divide(main.cast("double"), total.cast("double")) * 100
    return F.when(share.isNotNull(), F.format_string("%.2f%%", share)).otherwise("N/A")


def chip_changes(costs: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date", price: str | None = None) -> DataFrame:
    """From the first to the last cost distribution of each symbol: changes of the cost levels, concentration, peak, behaviour.

    Concentration is (85th - 15th) / 50th in percent: high under 10, low over 30; it rises as the value falls. The peak
    moves up or down if mean and median cost both do, and fast if the mean moves more than 1.5 times the median.
    Behaviour adds 2 for a rising concentration that is not low, 2 for a falling mean with a last price under 110 % of
    it (if there are prices), 1 for a rising median over a 5th percentile that moved less than a tenth; it takes 3 for a
    peak that moves up with the 85th percentile rising 1.5 times as far as the 15th moves, and 2 for a falling
    concentration that is low.
    """
    levels = ["cost_5pct", "cost_15pct", "cost_50pct", "cost_85pct", "cost_95pct", "weight_avg"]
    last_price = F.max_by(price, time) if price else F.lit(None).cast("double")
    g = costs.groupBy(symbol).agg(F.count("*").alias("days"), last_price.alias("__p"), *(F.min_by(c, time).alias(f"__{c}_0") for c in levels), *(F.max_by(c, time).alias(f"__{c}_1") for c in levels))
    first, last = (lambda c: F.col(f"__{c}_0")), (lambda c: F.col(f"__{c}_1"))
    move = lambda c: last(c) - first(c)
    change = {f"{c}_change": F.coalesce(F.try_divide(move(c) * 100.0, F.when(first(c) > 0, first(c))), F.lit(0.0)) for c in levels}
    spread = lambda at: F.try_divide((at("cost_85pct") - at("cost_15pct")) * 100.0, F.when(at("cost_50pct") > 0, at("cost_50pct")))
    g = g.withColumns(change).withColumn("__before", spread(first)).withColumn("concentration", spread(last))
    now, before = F.col("concentration"), F.col("__before")
    g = g.withColumn("concentration_label", F.when(now < 10, "high").when(now > 30, "low").when(now.isNotNull(), "medium"))
    mean, median = move("weight_avg"), move("cost_50pct")
    g = g.withColumn("peak_direction", F.when((mean > 0) & (median > 0), "up").when((mean < 0) & (median < 0), "down").otherwise("swinging"))
    g = g.withColumn("peak_speed", F.when(F.col("peak_direction") == "swinging", "unstable").when(F.abs(mean) > F.abs(median) * 1.5, "fast").otherwise("slow"))
    when = lambda test, points: F.when(test, points).otherwise(0)
    score = (
        when((now < before) & (now <= 30), 2)
        + when((mean < 0) & ((F.col("__p") - last("weight_avg")) / last("weight_avg") * 100 < 10), 2)
        + when((F.col("peak_direction") == "up") & (move("cost_85pct") > 0) & (F.abs(move("cost_85pct")) > F.abs(move("cost_15pct")) * 1.5), -3)
        + when((now > before) & (now > 30), -2)
        + when((F.abs(move("cost_5pct")) < F.abs(first("cost_5pct")) * 0.1) & (median > 0), 1)
    )
    g = g.withColumn("behaviour", score)
    b = F.col("behaviour")
    g = g.withColumn("behaviour_label", F.when(b >= 3, "accumulating").when(b >= 1, "perhaps accumulating").when(b <= -3, "distributing").when(b <= -1, "perhaps distributing").otherwise("consolidating"))
    return g.select(symbol, "days", *change, "concentration", "concentration_label", "peak_direction", "peak_speed", "behaviour", "behaviour_label")


def with_close(flows: DataFrame, quotes: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date", close: str = "close_li", change: str = "pct_chg") -> DataFrame:
    """Flow rows with the close and change of their day, where there is a quote."""
    return flows.join(quotes.select(symbol, time, close, change), [symbol, time], "left")


def liquidity(basics: DataFrame, daily: DataFrame, n: int = 5, *, symbol: str = "ts_code", time: str = "trade_date", columns: list[str]) -> DataFrame:
    """The last n rows of valuation data of each symbol, with columns of the day's bar where there is one."""
    last = latest(basics, n, key=symbol, order=[F.desc(time)])
    return last.join(daily.select(symbol, time, *columns), [symbol, time], "left")
