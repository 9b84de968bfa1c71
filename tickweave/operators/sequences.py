"""Model inputs: fixed-length sequences, static features, as-of joins and category codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK_DAYS, carried
from .windows import by, latest, log_return

EPSILON = 1e-8


def sequences(df: DataFrame, features: list[str], length: int, *, value: str = "close", symbol: str = "symbol", time: str = "t") -> DataFrame:
    """Sliding windows of standardised features with the log return after each: symbol, t, x (array of arrays), y.

    Features are standardised per symbol by the population deviation. A symbol of n rows gives n - length samples.
    """
    whole = Window.partitionBy(symbol)
    z = [(F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(whole)) / (F.stddev_pop(F.col(c).cast("double")).over(whole) + EPSILON) for c in features]
    w = by(symbol, time)
    rows = df.select(symbol, time, F.array(*z).alias("z"), F.log(F.lead(value).over(w) / F.col(value)).alias("y"), F.row_number().over(w).alias("n"))
    rows = rows.withColumn("x", F.collect_list("z").over(w.rowsBetween(-(length - 1), 0)))
    return rows.filter((F.col("n") >= length) & F.col("y").isNotNull()).select(symbol, time, "x", "y")


def last_sequence(df: DataFrame, features: list[str], length: int, *, symbol: str = "symbol", time: str = "t") -> DataFrame:
    """The latest window of each symbol that has enough rows, for scoring. Missing features raise ValueError."""
    if missing := sorted(set(features) - set(df.columns)):
        raise ValueError(f"features are missing: {missing}")
    whole = Window.partitionBy(symbol)
    z = [(F.col(c).cast("double") - F.avg(F.col(c).cast("double")).over(whole)) / (F.stddev_pop(F.col(c).cast("double")).over(whole) + EPSILON) for c in features]
    rows = latest(df.select(symbol, time, F.array(*z).alias("z")), length, key=symbol, order=[F.desc(time)])
    out = rows.groupBy(symbol).agg(F.max(time).alias(time), F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct(time, "z"))), lambda s: s["z"]).alias("x"))  # `length` rows a symbol
    return out.filter(F.col("n") == length).drop("n")


def training_set(seqs: DataFrame, static: DataFrame, *, symbol: str = "symbol") -> DataFrame:
    """Sequences with their symbol's static vector and number; symbols without a static row are dropped."""
    ids = static.select(symbol).distinct().withColumn("symbol_id", F.row_number().over(Window.orderBy(symbol)) - 1)  # one row a symbol
    return seqs.join(static, symbol).join(ids, symbol)


def as_of(left: DataFrame, right: DataFrame, *, key: str, time: str, right_time: str, values: list[str], days: int = BLOCK_DAYS) -> DataFrame:
    """Each left row with the values of the latest right row at or before its time: a union, and no range join.

    The last right row is carried within a key's blocks of so many days, then from block to block, so that a key with a
    long history is split. Of right rows of one key and time the largest values count.
    """
    a = left.select(F.lit(1).alias("__side"), F.col(key).alias("__key"), F.col(time).alias("__t"), F.struct(*left.columns).alias("__row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__right"))
    b = right.select(F.lit(0).alias("__side"), F.col(key).alias("__key"), F.col(right_time).alias("__t"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__right"))
    out = carried(a.unionByName(b), {"__v": F.col("__right")}, keys=["__key"], order=["__t", "__side", "__right"], days=days).filter("__side = 1")
    return out.select("__row.*", *(F.col(f"__v.{v}").alias(v) for v in values))


def quartile_labels(df: DataFrame, columns: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Labels by the quartiles of a column: {column: (label column, four labels)}; null gets the third label."""
    cuts = df.agg(*(F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"__{c}") for c in columns))
    out = df.crossJoin(F.broadcast(cuts))  # one row
    for c, (name, labels) in columns.items():
        q = F.col(f"__{c}")
        out = out.withColumn(name, F.when(F.col(c).isNull(), labels[2]).when(F.col(c) <= q[0], labels[0]).when(F.col(c) <= q[1], labels[1]).when(F.col(c) <= q[2], labels[2]).otherwise(labels[3])).drop(f"__{c}")
    return out


def static_features(daily: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date", close: str = "close_li", amount: str = "amount_li") -> DataFrame:
    """Mean amount and deviation of log returns of each symbol, with size, volatility and liquidity buckets."""
    rows = log_return(daily, value=close, symbol=symbol, time=time)
    out = rows.groupBy(symbol).agg(F.avg(amount).alias("mean_amount"), F.stddev_samp("log_return").alias("volatility"))
    sizes, levels = ["S", "M", "L", "XL"], ["LOW", "MID", "HIGH", "VERY_HIGH"]
    out = out.withColumn("mean_amount_2", F.col("mean_amount"))
    return quartile_labels(out, {"mean_amount": ("size_bucket", sizes), "volatility": ("volatility_bucket", levels), "mean_amount_2": ("liquidity_bucket", levels)}).drop("mean_amount_2")


def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores of ordinal codes of categories: codes by order of the values, null is -1."""
    for c in columns:
        codes = df.select(c).filter(F.col(c).isNotNull()).distinct().withColumn("__code", F.row_number().over(Window.orderBy(c)) - 1)  # one row a category
        df = df.join(codes, c, "left").withColumn("__code", F.coalesce(F.col("__code"), F.lit(-1)))
        stats = df.agg(F.avg("__code").alias("__m"), F.stddev_samp("__code").alias("__s"))
        df = df.crossJoin(F.broadcast(stats)).withColumn(f"{c}_z", (F.col("__code") - F.col("__m")) / (F.coalesce(F.col("__s"), F.lit(0.0)) + EPSILON)).drop("__code", "__m", "__s")  # one row
    return df
