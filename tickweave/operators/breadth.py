"""Market breadth, sentiment and their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label(value: Column, steps: list[tuple[float, str]], rest: str, *, strict: bool = False) -> Column:
    """The name of the first step that a value reaches, steps from the largest down; null stays null."""
    out = None
    for least, name in steps:
        hit = value > least if strict else value >= least
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(value.isNotNull(), rest)


def breadth(quotes: DataFrame, *, change: str = "pct_chg", by: str = "trade_date", limit: float = 9.5) -> DataFrame:
    """Counts of rising, falling and flat symbols and of those at their limits, with shares and scores, by date."""
    c = F.col(change)
    out = quotes.filter(c.isNotNull()).groupBy(by).agg(F.count("*").alias("total"), F.count_if(c > 0).alias("up"), F.count_if(c < 0).alias("down"), F.count_if(c == 0).alias("flat"), F.count_if(c >= limit).alias("limit_up"), F.count_if(c <= -limit).alias("limit_down"))
    n = F.col("total").cast("double")
    out = out.withColumn("up_ratio", F.col("up") / n * 100).withColumn("sentiment", (F.col("up") - F.col("down")) / n * 100)
    out = out.withColumn("sentiment_label", label(F.col("sentiment"), [(30, "very bullish"), (10, "bullish"), (-10, "neutral"), (-30, "bearish")], "very bearish", strict=True))
    limits = F.col("limit_up") + F.col("limit_down")
    out = out.withColumn("limit_ratio", F.when(limits > 0, F.col("limit_up") / limits.cast("double") * 100).otherwise(50.0))
    out = out.withColumn("limit_label", label(F.col("limit_ratio"), [(70, "very strong"), (60, "strong"), (40, "even"), (30, "weak")], "very weak", strict=True))
    out = out.withColumn("fear_greed", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + (F.col("up") / n - 0.5) * 60)))
    return out.withColumn("fear_greed_label", label(F.col("fear_greed"), [(75, "extreme greed"), (60, "greed"), (40, "neutral"), (25, "fear")], "extreme fear"))


def turnover_label(rate: Column) -> Column:
    return label(rate, [(20, "very high"), (10, "high"), (5, "normal"), (2, "low")], "very low", strict=True)


def margin_label(share: Column) -> Column:
    return label(share, [(10, "high"), (3, "medium"), (1, "low")], "very low", strict=True)


def latest_within(df: DataFrame, until: str, days: int = 7, *, key: str, time: str = "trade_date") -> DataFrame:
    """The latest row of each key in the days up to a date."""
    last = F.lit(until).cast("date")
    from .windows import latest

    return latest(df.filter((F.col(time) <= last) & (F.col(time) > F.date_sub(last, days))), key=key, order=[F.desc(time)])
