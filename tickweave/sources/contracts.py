"""Table contracts, and adapters that fill them from the tables at hand.

Readers give an explicit schema for stored market tables, so that a scan never infers one. The adapters derive bars,
ticks, factors, flows and records from the warehouse tables; operators only know the contracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Contracts as DDL.
DAILY_BARS = "ts_code string, trade_date date, open_li int, high_li int, low_li int, close_li int, volume_hand bigint, amount_li bigint"
MINUTE_BARS = "ts_code string, trade_time timestamp, freq string, open_li int, high_li int, low_li int, close_li int, volume_hand bigint, amount_li bigint"
TICKS = "symbol string, time timestamp, price_li bigint, volume_hand bigint, status int, seq bigint"
ADJ_FACTOR = "ts_code string, trade_date date, adj_factor double"
CALENDAR = "cal_date date, is_trading boolean"
BOARD_MEMBER = "trade_date date, ts_code string, con_code string, con_name string"
SUFFIXES = (".SZ", ".SH", ".BJ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(key: Column) -> Column:
    """A ts_code from a number: six digits and one of three suffixes."""
    return F.concat(F.lpad(key.cast("string"), 6, "0"), F.element_at(F.array(*map(F.lit, SUFFIXES)), (key % 3 + 1).cast("int")))


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bar for each nation and order date: prices in li from order totals, volume the orders, amount their sum."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("trade_date"), F.floor("o_totalprice").cast("int").alias("p"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    at = o.join(c, o.o_custkey == c.c_custkey).groupBy(code_of(F.col("c_nationkey")).alias("ts_code"), "trade_date")
    return at.agg(
        F.min_by("p", "o_orderkey").alias("open_li"), F.max("p").alias("high_li"), F.min("p").alias("low_li"), F.max_by("p", "o_orderkey").alias("close_li"),
        F.count("*").alias("volume_hand"), F.sum(F.col("p").cast("long")).alias("amount_li"),
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade for each event: price in li, volume and side from the user."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), F.floor(F.col("value") * 100).cast("long").alias("price_li"), (F.col("user_id") % 7 + 1).alias("volume_hand"), (F.col("user_id") % 3).cast("int").alias("status"), F.col("event_id").alias("seq"))


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars of the ticks."""
    t = ticks(spark, sf_dir).groupBy(F.col("symbol").alias("ts_code"), F.date_trunc("minute", "time").alias("trade_time"))
    return t.agg(
        F.lit("1m").alias("freq"), F.min_by("price_li", "seq").alias("open_li"), F.max("price_li").alias("high_li"), F.min("price_li").alias("low_li"), F.max_by("price_li", "seq").alias("close_li"),
        F.sum("volume_hand").alias("volume_hand"), F.sum(F.col("price_li") * F.col("volume_hand") * 100).alias("amount_li"),
    )


def adj_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor for each bar that rises by year and dips in every third month, so that the latest is not the largest."""
    y, m = F.year("trade_date"), F.month("trade_date")
    return daily_bars(spark, sf_dir).select("ts_code", "trade_date", (1 + (y - 1990) * 0.25 + F.when(m % 3 == 1, 0.5).otherwise(0.0)).alias("adj_factor"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between the first and the last order, weekdays trading."""
    span = table(spark, sf_dir, "orders").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("cal_date")).withColumn("is_trading", F.weekday("cal_date") < 5)


def money_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buys and sells by order size from order lines: up to 12, 25, 38 and more pieces."""
    lines = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    size = F.when(q <= 12, "sm").when(q <= 25, "md").when(q <= 38, "lg").otherwise("elg")
    rows = lines.select(code_of(F.col("l_partkey") % 25).alias("ts_code"), F.to_date("l_shipdate").alias("trade_date"), size.alias("size"), (F.col("l_returnflag") != "R").alias("buy"), q.cast("long").alias("vol"), F.floor("l_extendedprice").cast("long").alias("amount"))
    sums = []
    for side, buy in (("buy", True), ("sell", False)):
        for s in ("sm", "md", "lg", "elg"):
            hit = (F.col("buy") == buy) & (F.col("size") == s)
            sums += [F.sum(F.when(hit, F.col(k)).otherwise(0)).alias(f"{side}_{s}_{k}") for k in ("vol", "amount")]
    signed = F.when(F.col("buy"), 1).otherwise(-1)
    return rows.groupBy("ts_code", "trade_date").agg(*sums, F.sum(signed * F.col("vol")).alias("net_mf_vol"), F.sum(signed * F.col("amount")).alias("net_mf_amount"))


def billboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seat records: the part is the stock, the supplier the seat, its type words the concepts."""
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    amount, sold = F.floor("l_extendedprice").cast("long"), F.col("l_returnflag") == "R"
    return rows.select(
        F.to_date("l_shipdate").alias("date"), code_of(F.col("l_partkey")).alias("stock_code"), F.col("p_name").alias("stock_name"), F.col("s_name").alias("youzi_name"), F.concat("s_name", F.lit(" branch")).alias("yingye_bu"),
        F.when(sold, 0).otherwise(amount).alias("buy_amount"), F.when(sold, amount).otherwise(0).alias("sell_amount"), F.when(sold, -amount).otherwise(amount).alias("net_inflow"), F.replace(F.col("p_type"), F.lit(" "), F.lit(",")).alias("concepts"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-section: each symbol's bars with the change to the one before, in percent."""
    from ..operators.windows import pct_change

    return pct_change(daily_bars(spark, sf_dir), value="close_li", symbol="ts_code", time="trade_date", out="ret").withColumn("pct_chg", F.round(F.col("ret") * 100, 4)).drop("ret")


def board_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as constituents of their regions."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("board_code"), code_of(F.col("n_nationkey")).alias("con_code"), F.col("n_name").alias("con_name"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as news: a publishing time derived from the id, titles the first 60 characters."""
    d = table(spark, sf_dir, "documents")
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 5000) * 600)
    return d.select(F.col("doc_id").alias("id"), "source", F.when(F.col("doc_id") % 7 > 0, (F.col("doc_id") % 500).cast("string")).alias("external_id"), at.alias("publish_time"), F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), (F.col("doc_id") % 5 == 0).alias("is_important"))
