"""Adjusted prices: factors, panels and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import fill


def forward_factor(factors: DataFrame, *, base: str = "max", base_date: str | None = None, symbol: str = "ts_code", time: str = "trade_date", value: str = "adj_factor", out: str = "factor") -> DataFrame:
    """The factor against a base: the symbol's largest (``max``), its latest (``latest``), or that of a date.

    A symbol without a row on the base date keeps 1.
    """
    w = Window.partitionBy(symbol)
    v = F.col(value)
    if base_date is not None:
        at = F.max(F.when(F.col(time) == F.lit(base_date).cast("date"), v)).over(w)
        return factors.withColumn(out, F.when(at.isNull(), F.lit(1.0)).otherwise(v / at))
    top = F.max(v).over(w) if base == "max" else F.max_by(value, time).over(w)
    return factors.withColumn(out, v / top)


def latest_factor(factors: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date", value: str = "adj_factor") -> DataFrame:
    return factors.groupBy(symbol).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def with_factor(bars: DataFrame, factors: DataFrame, *, strict: bool = True, symbol: str = "ts_code", day: str = "trade_date", time: str | None = None, factor: str = "factor") -> DataFrame:
    """Bars with the factor of their symbol and day; ``time`` for minute bars, which join on the time's date.

    ``strict`` makes the job fail on a bar without a factor, else it is null.
    """
    left = bars.withColumn(day, F.to_date(time)) if time else bars
    out = left.join(factors.select(symbol, day, factor), [symbol, day], "left")
    if strict:
        out = out.withColumn(factor, F.when(F.col(factor).isNull(), F.raise_error(F.concat(F.lit("no factor for "), F.col(symbol), F.lit(" on "), F.col(day).cast("string"))).cast("double")).otherwise(F.col(factor)))
    return out


def adjusted_panel(bars: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date", factor: str = "factor") -> DataFrame:
    """datetime, instrument, $open … $close in yuan times the factor, $volume in shares by the factor, $factor, $amount in yuan."""
    f = F.col(factor)
    price = {f"${c}": (F.col(f"{c}_li") / 1000.0 * f) for c in ("open", "close", "high", "low")}
    rest = {"$volume": F.col("volume_hand") * 100 / f, "$factor": f, "$amount": F.col("amount_li") / 1000.0}
    return bars.select(F.col(time).alias("datetime"), F.col(symbol).alias("instrument"), *(v.cast("float").alias(k) for k, v in (price | rest).items()))


def plain_panel(bars: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """The panel of unadjusted rows, boards for instance: factor 1."""
    return adjusted_panel(bars.withColumn("factor", F.lit(1.0)), symbol=symbol, time=time)


def adjusted_series(bars: DataFrame, factors: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """Forward (qfq) and backward (hfq) adjusted prices in li.

    Factors are laid on the bars' dates and filled forward, then backward, then with 1. qfq is against the last factor,
    hfq against the first; prices are rounded half to even, volume stays.
    """
    joined = bars.join(factors.select(symbol, F.col(time).cast("date").alias(time), F.col("adj_factor").alias("__a")), [symbol, time], "left")
    joined = fill(joined, ["__a"], symbol=symbol, time=time, how="both").withColumn("__f", F.coalesce("__a", F.lit(1.0)))
    ends = joined.groupBy(symbol).agg(F.min_by("__f", time).alias("__first"), F.max_by("__f", time).alias("__last"))
    joined = joined.join(ends, symbol).withColumn("__q", F.col("__f") / F.col("__last")).withColumn("__h", F.col("__f") / F.col("__first"))
    made = [F.bround(F.col(f"{c}_li") * F.col(k)).cast("int").alias(f"{c}_{name}") for name, k in (("qfq", "__q"), ("hfq", "__h")) for c in ("open", "high", "low", "close")]
    return joined.select(symbol, time, *made, "volume_hand", "amount_li")


def flow_panel(flows: DataFrame, *, symbol: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """Money flow as mf_* columns, volumes in shares and amounts in yuan."""
    cols = [(f"mf_{s}_{side}_{short}", F.col(f"{side}_{s}_{k}") * unit) for s in ("sm", "md", "lg", "elg") for side in ("buy", "sell") for k, short, unit in (("vol", "vol", 100), ("amount", "amt", 10000))]
    cols += [("mf_net_vol", F.col("net_mf_vol") * 100), ("mf_net_amt", F.col("net_mf_amount") * 10000)]
    return flows.select(F.col(time).alias("datetime"), F.col(symbol).alias("instrument"), *(v.alias(k) for k, v in cols))


def basic_panel(basics: DataFrame, columns: list[str], *, symbol: str = "ts_code", time: str = "trade_date") -> DataFrame:
    """Valuation columns by date and instrument, with a prefix."""
    return basics.select(F.col(time).alias("datetime"), F.col(symbol).alias("instrument"), *(F.col(c).cast("double").alias(f"db_{c}") for c in columns))
