"""Data quality: validation, comparisons, gaps, fills, anomalies and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import fill, outliers, pct_change

PRICES = ["open", "high", "low", "close"]


def validate(df: DataFrame, *, symbol: str = "instrument", time: str = "datetime") -> DataFrame:
    """One row: rows, span, instruments, columns, duplicate keys, nulls of each column."""
    out = df.agg(F.count("*").alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"), F.countDistinct(symbol).alias("instruments"), F.countDistinct(F.struct(symbol, time)).alias("__keys"), *(F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in df.columns))
    return out.withColumn("columns", F.lit(len(df.columns))).withColumn("duplicate_keys", F.col("rows") - F.col("__keys")).drop("__keys")


def compare(before: DataFrame, after: DataFrame, columns: tuple[str, ...] = ("rows", "instruments", "duplicate_keys")) -> DataFrame:
    """Messages on what changed between two one-row reports."""
    pair = before.select(*(F.col(c).alias(f"{c}_0") for c in columns)).crossJoin(after.select(*(F.col(c).alias(f"{c}_1") for c in columns)))  # one row each
    said = F.array(*(F.when(F.col(f"{c}_0") != F.col(f"{c}_1"), F.concat(F.lit(f"{c}: "), F.col(f"{c}_0").cast("string"), F.lit(" -> "), F.col(f"{c}_1").cast("string"))) for c in columns))
    return pair.select(F.explode(F.filter(said, lambda m: m.isNotNull())).alias("message"))


def missing_dates(df: DataFrame, calendar: DataFrame | None = None, *, symbol: str = "instrument", time: str = "datetime", day: str = "cal_date", shown: int = 10) -> DataFrame:
    """Per instrument the days of a calendar (or of any instrument) that it lacks: their count and the first ones."""
    have = df.select(symbol, F.to_date(time).alias(day)).distinct()
    days = have.select(day).distinct() if calendar is None else calendar.select(day).distinct()
    every = days.agg(F.array_sort(F.collect_list(day)).alias("__days"))  # one row: the calendar, some 250 days a year
    own = have.groupBy(symbol).agg(F.collect_set(day).alias("__own")).crossJoin(F.broadcast(every))
    lacking = own.select(symbol, F.array_except("__days", "__own").alias("__lacking")).filter(F.size("__lacking") > 0)
    first = F.transform(F.slice("__lacking", 1, shown), lambda x: x.cast("string"))
    return lacking.select(symbol, F.size("__lacking").cast("long").alias("missing"), F.array_join(first, ",").alias("first_missing"))


def fill_suspension(df: DataFrame, *, price: str = "ffill", volume: str = "zero", symbol: str = "instrument", time: str = "datetime") -> DataFrame:
    """Fill prices (ffill, bfill, none) and volume (zero, ffill, none) of days without trade."""
    how = {"ffill": "forward", "bfill": "backward"}
    if price in how:
        df = fill(df, PRICES, symbol=symbol, time=time, how=how[price])
    if volume == "zero":
        return df.withColumn("volume", F.coalesce("volume", F.lit(0)))
    return fill(df, ["volume"], symbol=symbol, time=time) if volume == "ffill" else df


def suspension_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("suspended", F.coalesce(F.col("volume"), F.lit(0)) == 0)


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: type, count, nulls, null rate, least, largest, mean and deviation."""
    types = dict(df.dtypes)
    one = df.agg(F.count("*").alias("__n"), *(F.struct(F.count(c).alias("count"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("dtype"), F.col(c).alias("s")) for c in columns))
    out = one.select("__n", F.explode(rows).alias("r")).select("__n", "r.column", "r.dtype", "r.s.*")
    return out.withColumn("nulls", F.col("__n") - F.col("count")).withColumn("null_rate", F.try_divide(F.col("nulls").cast("double"), F.col("__n"))).drop("__n")


def price_anomalies(df: DataFrame, threshold: float = 0.21, most: int = 1000, *, symbol: str = "instrument", time: str = "datetime") -> DataFrame:
    """Closes that are not positive (half of ``most`` at most), then moves beyond the threshold, ``most`` in all."""
    bad = df.filter(F.col("close") <= 0).orderBy(symbol, time).limit(most // 2).select(symbol, time, "close", F.lit(None).cast("double").alias("pct_change"), F.lit(0).alias("kind"))
    moved = pct_change(df, symbol=symbol, time=time).filter(F.abs("pct_change") > threshold)
    moved = moved.orderBy(symbol, time).limit(most).select(symbol, time, "close", "pct_change", F.lit(1).alias("kind"))
    return bad.unionByName(moved).orderBy("kind", symbol, time).limit(most)


def volume_anomalies(df: DataFrame, k: float = 10.0, most: int = 1000, *, symbol: str = "instrument", time: str = "datetime") -> DataFrame:
    return outliers(df, value="volume", symbol=symbol, k=k).orderBy(symbol, time).limit(most)


def score(stats: DataFrame) -> DataFrame:
    """100 less what is not covered, half the null rate and up to 10 for anomalies, between 0 and 100."""
    lost = F.least(F.lit(10.0), F.try_divide(F.col("anomalies").cast("double"), F.col("rows")) * 1000)
    return stats.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - (1 - F.col("coverage")) * 100 - F.col("null_rate") * 50 - F.coalesce(lost, F.lit(0.0)))))


def report(df: DataFrame, days: DataFrame, *, symbol: str = "instrument", time: str = "datetime", threshold: float = 0.21) -> DataFrame:
    """One row: rows, instruments, days, coverage, null rate, anomalies and the score."""
    one = df.agg(F.count("*").alias("rows"), F.countDistinct(symbol).alias("instruments"), (sum((F.count_if(F.col(c).isNull()) for c in PRICES), F.lit(0)) / (F.count("*") * float(len(PRICES)))).alias("null_rate"))
    n = days.agg(F.count("*").alias("days"))
    odd = pct_change(df, symbol=symbol, time=time).agg(F.count_if((F.abs("pct_change") > threshold) | (F.col("close") <= 0)).alias("anomalies"))
    rows = one.crossJoin(n).crossJoin(odd)  # one row each
    return score(rows.withColumn("coverage", F.least(F.lit(1.0), F.try_divide(F.col("rows").cast("double"), F.col("days") * F.col("instruments")))))


def source_check(bars: DataFrame, factors: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """One row: bars, codes, span, bars with a factor, codes whose factors are all 1, closes that are not positive, factor range."""
    f = factors.select(symbol, time, "adj_factor")
    joined = bars.join(f, [symbol, time], "left")
    one = joined.agg(F.count("*").alias("bars"), F.countDistinct(symbol).alias("codes"), F.min(time).alias("first_day"), F.max(time).alias("last_day"), F.count("adj_factor").alias("with_factor"), F.count_if(F.col("close_li") <= 0).alias("not_positive"), F.min("adj_factor").alias("least_factor"), F.max("adj_factor").alias("largest_factor"))
    flat = f.groupBy(symbol).agg(F.min("adj_factor").alias("a"), F.max("adj_factor").alias("b")).agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("all_ones"))
    return one.crossJoin(flat).withColumn("factor_coverage", F.try_divide(F.col("with_factor").cast("double"), F.col("bars")))  # one row each


def exact_quantile(df: DataFrame, value: Column, q: float = 0.5, *, few: int = 100_000, bins: int = 1024) -> float | None:
    """An exact quantile (interpolated between neighbours, nulls left out) in passes of bounded state.

    Each pass counts ``bins`` equal parts of the range that holds the place, and goes on with the one part that holds it,
    between the least and the largest value there; once at most ``few`` values are left, those are ordered.
    """
    x = df.select(value.cast("double").alias("x")).filter("x is not null")
    n, low, high = x.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    place = q * (n - 1)
    k, part = int(place), place - int(place)
    left, skipped = n, 0
    while left > few and low < high:
        inside = x.filter(F.col("x").between(low, high))
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / (high - low) * bins)).alias("at")
        for r in sorted(inside.groupBy(at).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect(), key=lambda r: r["at"]):  # a row a bin
            if skipped + r["n"] > k:
                left, low, high = r["n"], r["low"], r["high"]
                break
            skipped += r["n"]
    found = low if low == high else x.filter(F.col("x").between(low, high)).orderBy("x").offset(k - skipped).limit(1).first()["x"]
    if not part:
        return found
    upto, after = x.agg(F.count_if(F.col("x") <= found), F.min(F.when(F.col("x") > found, F.col("x")))).first()
    following = found if upto > k + 1 else after
    return found + part * (following - found)


def consistency(raw: DataFrame, derived: DataFrame, *, keys: list[str], value: str, few: int = 100_000) -> DataFrame:
    """Relative error of a derived value against the raw one: rows, largest and exact median."""
    both = raw.select(*keys, F.col(value).alias("__raw")).join(derived.select(*keys, F.col(value).alias("__derived")), keys)
    error = F.try_divide(F.abs(F.col("__derived") - F.col("__raw")).cast("double"), F.abs(F.col("__raw")))
    median = exact_quantile(both, error, few=few)
    return both.agg(F.count("*").alias("rows"), F.max(error).alias("max_error")).withColumn("median_error", F.lit(median).cast("double"))
