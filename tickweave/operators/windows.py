"""Window functions over series: changes, fills, outliers, islands, ranks and latest rows.

All of them partition by the symbol, so a chain of them over one frame shares one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_DAYS, Ranges, carried

def by(symbol: str | list[str], *order: str | Column) -> Window:
    keys = [symbol] if isinstance(symbol, str) else symbol
    return Window.partitionBy(*keys).orderBy(*order)


def pct_change(df: DataFrame, *, value: str = "close", symbol: str = "symbol", time: str = "t", out: str = "pct_change") -> DataFrame:
    """Change to the previous positive value of the symbol; null for the first, and where either is not positive."""
    v = F.when(F.col(value) > 0, F.col(value).cast("double"))
    prior = F.last(v, ignorenulls=True).over(by(symbol, time).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, v / prior - 1)


def log_return(df: DataFrame, *, value: str = "close", symbol: str = "symbol", time: str = "t", out: str = "log_return") -> DataFrame:
    v = F.col(value).cast("double")
    prior = F.lag(v).over(by(symbol, time))
    return df.withColumn(out, F.when((v > 0) & (prior > 0), F.log(v / prior)))


def fill(df: DataFrame, columns: list[str], *, symbol: str = "symbol", time: str = "t", how: str = "forward", days: int = BLOCK_DAYS) -> DataFrame:
    """Fill nulls of columns from the last value before (``forward``), the next after (``backward``), or both in turn.

    A value is carried within blocks of so many days and then from block to block; times of a symbol are distinct.
    """
    at = {"keys": [symbol], "order": [time], "days": days}
    if how == "both":
        return fill(fill(df, columns, symbol=symbol, time=time, days=days), columns, symbol=symbol, time=time, how="backward", days=days)
    made = carried(df, {f"__fill_{c}": F.col(c) for c in columns}, forward=how == "forward", **at)
    return made.withColumns({c: F.col(f"__fill_{c}") for c in columns}).drop(*(f"__fill_{c}" for c in columns))


def outliers(df: DataFrame, *, value: str, symbol: str = "symbol", k: float = 10.0) -> DataFrame:
    """Rows above their group's mean plus k sample deviations, the row itself included. A group of fewer than k*k+2 rows has none."""
    w = Window.partitionBy(symbol)
    v = F.col(value).cast("double")
    df = df.withColumn("mean", F.avg(v).over(w)).withColumn("std", F.stddev_samp(v).over(w))
    return df.filter(v > F.col("mean") + k * F.col("std"))


def changes(df: DataFrame, *, value: str, key: str, time: str, tie: str | None = None) -> DataFrame:
    """Rows whose value differs from the one before, with ``previous``."""
    w = by(key, time, *([tie] if tie else []))
    return df.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def islands(df: DataFrame, *, day: str, keys: list[str]) -> DataFrame:
    """Runs of adjacent days: keys, first_day, last_day, days."""
    one = df.select(*keys, day).distinct().withColumn("__n", F.row_number().over(by(keys, day)))
    return one.groupBy(*keys, F.date_sub(F.col(day), F.col("__n")).alias("__i")).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count("*").alias("days")).drop("__i")


def latest(df: DataFrame, n: int = 1, *, key: str | list[str], order: list[Column], rank: str | None = None) -> DataFrame:
    """The first n rows of each key in an order (Spark keeps n rows a key before the shuffle)."""
    at = rank or "__rank"
    out = df.withColumn(at, F.row_number().over(by(key, *order))).filter(F.col(at) <= n)
    return out if rank else out.drop(at)


def span_change(df: DataFrame, n: int, *, key: str, time: str, level: str, flows: list[str]) -> DataFrame:
    """Over a key's last n rows: change of a level from first to last, sums of flows, rows."""
    last = latest(df, n, key=key, order=[F.desc(time)])
    return last.groupBy(key).agg(F.count("*").alias("rows"), (F.max_by(level, time) - F.min_by(level, time)).alias(f"{level}_change"), *(F.sum(c).alias(f"{c}_sum") for c in flows))


def index_metrics(df: DataFrame, until: str, *, symbol: str = "ts_code", time: str = "trade_date", value: str = "close_li", rows: int = 6) -> DataFrame:
    """The last rows up to a date with the difference and change to the row before; ``rank`` 1 is the latest."""
    past = df.filter(F.col(time) <= F.lit(until).cast("date"))
    prior = F.lag(value).over(by(symbol, time))
    past = past.withColumn("diff", F.col(value) - prior).withColumn("pct", F.try_divide((F.col(value) - prior) * 100.0, prior))
    return latest(past, rows, key=symbol, order=[F.desc(time)], rank="rank")


def blended_heat(df: DataFrame, *, alpha: float = 0.5, time: str = "ts", change: str = "pct_chg", flow: str = "net_inflow", out: str = "heat") -> DataFrame:
    """alpha * change + (1 - alpha) * flow, both scaled to [-1, 1] over each time; a zero range gives -1, nulls count as 0."""
    w = Window.partitionBy(time)

    def scaled(c: str) -> Column:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        low, high = F.min(v).over(w), F.max(v).over(w)
        return F.when(high > low, (v - low) / (high - low) * 2 - 1).otherwise(-1.0)

    return df.withColumn(out, alpha * scaled(change) + (1 - alpha) * scaled(flow))


def volume_ratio(df: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date", volume: str = "volume_hand", n: int = 5) -> DataFrame:
    """The latest volume against the mean of the earlier rows among the last n."""
    last = latest(df, n, key=symbol, order=[F.desc(time)], rank="rank")
    return last.groupBy(symbol).agg(F.max(F.when(F.col("rank") == 1, F.col(volume))).alias("latest"), F.avg(F.when(F.col("rank") > 1, F.col(volume))).alias("earlier")).withColumn("ratio", F.try_divide(F.col("latest").cast("double"), F.col("earlier")))


def score_rank(df: DataFrame, *, score: str, key: str, top: int | None = None, out: str = "rank") -> DataFrame:
    """Ranks from 1 by score, descending, nulls last, and key. With ``top`` only so many rows are ranked; without, rows
    are dealt into ranges of the score whose counts are added up, and each range is ordered by itself."""
    if top is None:
        return Ranges(df, [(score, True), (key, False)]).ranked(out)
    rows = df.orderBy(F.desc(score), key).limit(top)
    return rows.withColumn(out, F.row_number().over(Window.orderBy(F.desc(score), key)))
