"""Technical indicators over a symbol's bars: windows where a row frame can say it, recursions as scans over blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_DAYS, carried_lag, smoothed
from .windows import by, latest


def rolling(kind, value: Column, n: int, *, symbol: str, time: str, full: bool = True) -> Column:
    """An aggregate over the last n rows; null until there are n non-null values, if ``full``."""
    w = by(symbol, time).rowsBetween(-(n - 1), 0)
    out = kind(value).over(w)
    return F.when(F.count(value).over(w) == n, out) if full else out


def moving_averages(df: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 60), *, value: str = "close", symbol: str = "symbol", time: str = "t", full: bool = True) -> DataFrame:
    return df.withColumns({f"ma{n}": rolling(F.avg, F.col(value), n, symbol=symbol, time=time, full=full) for n in periods})


def bollinger(df: DataFrame, n: int = 20, k: float = 2.0, *, value: str = "close", symbol: str = "symbol", time: str = "t") -> DataFrame:
    mid, std = (rolling(f, F.col(value), n, symbol=symbol, time=time) for f in (F.avg, F.stddev_pop))
    return df.withColumns({"bb_mid": mid, "bb_upper": mid + k * std, "bb_lower": mid - k * std})


def stochastic(df: DataFrame, n: int = 14, d: int = 3, *, close: str = "close", high: str = "high", low: str = "low", symbol: str = "symbol", time: str = "t") -> DataFrame:
    least, most = rolling(F.min, F.col(low), n, symbol=symbol, time=time), rolling(F.max, F.col(high), n, symbol=symbol, time=time)
    df = df.withColumn("k", F.try_divide((F.col(close) - least) * 100.0, most - least))
    return df.withColumn("d", rolling(F.avg, F.col("k"), d, symbol=symbol, time=time))


def volume_averages(df: DataFrame, n: int = 5, *, volume: str = "volume", symbol: str = "symbol", time: str = "t") -> DataFrame:
    mean = rolling(F.avg, F.col(volume), n, symbol=symbol, time=time)
    return df.withColumn(f"volume_ma{n}", mean).withColumn("volume_ratio", F.try_divide(F.col(volume).cast("double"), mean))


def arbr(df: DataFrame, n: int = 26, *, symbol: str = "symbol", time: str = "t") -> DataFrame:
    """AR and BR over n rows; rows where either is null (not full, or no range) are dropped."""
    prior = F.lag("close").over(by(symbol, time))
    df = df.withColumns({"__ho": F.col("high") - F.col("open"), "__ol": F.col("open") - F.col("low"), "__hc": F.col("high") - prior, "__cl": prior - F.col("low")})
    s = lambda c: rolling(F.sum, F.col(c), n, symbol=symbol, time=time)
    df = df.withColumn("ar", F.try_divide(s("__ho") * 100.0, s("__ol"))).withColumn("br", F.try_divide(s("__hc") * 100.0, s("__cl")))
    return df.filter("ar is not null and br is not null").drop("__ho", "__ol", "__hc", "__cl")


def arbr_signals(df: DataFrame) -> DataFrame:
    """-1, 0 or 1 for each row: the sign of the marks of AR (above 150, under 70) and BR (above 300, under 50) together."""
    mark = lambda c, high, low: F.when(F.col(c) > high, -1).when(F.col(c) < low, 1).otherwise(0)
    return df.withColumn("signal", F.signum(mark("ar", 150, 70) + mark("br", 300, 50)).cast("int"))


def arbr_summary(df: DataFrame, *, symbol: str = "symbol") -> DataFrame:
    """Counts and shares of signals, statistics of AR and BR, and a label of the mean level."""
    stats = [f(c).alias(f"{c}_{name}") for c in ("ar", "br") for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    out = df.groupBy(symbol).agg(F.count("*").alias("rows"), *(F.count_if(F.col("signal") == v).alias(k) for k, v in (("buys", 1), ("sells", -1), ("neutrals", 0))), *stats)
    out = out.withColumns({f"{k}_ratio": F.col(k).cast("double") / F.col("rows") for k in ("buys", "sells", "neutrals")})
    return out.withColumn("label", F.when(F.col("ar_mean") > 180, "extremely overbought").when(F.col("ar_mean") > 150, "overbought").when(F.col("ar_mean") < 40, "extremely oversold").when(F.col("ar_mean") < 70, "oversold").otherwise("normal"))


def rsi(df: DataFrame, n: int = 14, *, value: str = "close", symbol: str = "symbol", time: str = "t", days: int = BLOCK_DAYS) -> DataFrame:
    """Relative strength with Wilder's smoothing (weight 1/n, started on the first change), null for the first n - 1 rows.

    A missing value makes no change to it and none from it. A symbol's rows are smoothed in blocks of so many days.
    """
    before = carried_lag(df, value, symbol=symbol, time=time, days=days, out="__before")
    change = F.col(value).cast("double") - F.col("__before")
    rise = lambda x: F.when(x > 0, x).otherwise(0.0)
    out = smoothed(before, {"__up": (rise(change), 1 / n), "__down": (rise(-change), 1 / n)}, symbol=symbol, time=time, days=days)
    strength = F.when(F.col("__down") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("__up") / F.col("__down")))
    return out.withColumn("rsi", F.when(F.col("__index") >= n - 1, strength)).drop("__before", "__up", "__down", "__index")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *, value: str = "close", symbol: str = "symbol", time: str = "t", days: int = BLOCK_DAYS) -> DataFrame:
    """Difference of exponential means, its own mean and the rest; each null until its period is full.

    Values are not null. A symbol's rows are smoothed in blocks of so many days.
    """
    weight = lambda k: 2 / (k + 1)
    at = {"symbol": symbol, "time": time, "days": days}
    x, least = F.col(value), max(fast, slow) - 1
    out = smoothed(df, {"__fast": (x, weight(fast)), "__slow": (x, weight(slow))}, **at).withColumn("macd", F.when(F.col("__index") >= least, F.col("__fast") - F.col("__slow"))).drop("__fast", "__slow")
    full = smoothed(out.filter(F.col("__index") >= least), {"macd_signal": (F.col("macd"), weight(signal))}, **at, index="__line")
    full = full.withColumn("macd_signal", F.when(F.col("__line") >= signal - 1, F.col("macd_signal"))).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    short = out.filter(F.col("__index") < least).withColumns({"macd_signal": F.lit(None).cast("double"), "macd_hist": F.lit(None).cast("double")})
    return full.drop("__index", "__line").unionByName(short.drop("__index"))


def all_indicators(df: DataFrame, *, symbol: str = "symbol", time: str = "t") -> DataFrame:
    """Every indicator of bars with open, high, low, close and volume."""
    at = {"symbol": symbol, "time": time}
    df = volume_averages(stochastic(bollinger(moving_averages(df, **at), **at), **at), **at)
    return macd(rsi(df, **at), **at)


def latest_indicators(df: DataFrame, *, symbol: str = "symbol", time: str = "t") -> DataFrame:
    return latest(df, key=symbol, order=[F.desc(time)])

