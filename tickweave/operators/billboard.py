"""Seat records of the billboard: rankings, summaries and scores of stocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import comma_list, ordered_concat
from .windows import score_rank

WAN = 10_000


def scan(records: DataFrame, start: str | None = None, end: str | None = None, code: str | None = None) -> DataFrame:
    """Records by date range and stock, weekdays only; sort by date and net inflow to show them."""
    rows = records.filter(F.weekday("date") < 5)
    for value, test in ((start, lambda v: F.col("date") >= F.lit(v).cast("date")), (end, lambda v: F.col("date") <= F.lit(v).cast("date")), (code, lambda v: F.col("stock_code") == v)):
        rows = rows if value is None else rows.filter(test(value))
    return rows


def top_seats(records: DataFrame, n: int = 20) -> DataFrame:
    out = records.groupBy("youzi_name").agg(F.count("*").alias("records"), *(F.sum(c).alias(c) for c in ("buy_amount", "sell_amount", "net_inflow")))
    return out.orderBy(F.desc("net_inflow"), "youzi_name").limit(n)


def top_stocks(records: DataFrame, n: int = 20) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("buy_amount", "sell_amount", "net_inflow")]
    top = records.groupBy("stock_code").agg(F.min("stock_name").alias("stock_name"), *sums).orderBy(F.desc("net_inflow"), "stock_code").limit(n)
    # Only the chosen stocks' records are looked at again for their seats and concepts: n rows are broadcast.
    own = records.join(F.broadcast(top.select("stock_code")), "stock_code", "left_semi").select("stock_code", "youzi_name", "concepts").distinct()
    more = own.groupBy("stock_code").agg(F.countDistinct("youzi_name").alias("seats"), ordered_concat(F.col("concepts")).alias("concepts"))
    return top.join(more, "stock_code")


def summary(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("records"), F.countDistinct("stock_code").alias("stocks"), F.countDistinct("youzi_name").alias("seats"), *(F.sum(c).alias(c) for c in ("buy_amount", "sell_amount", "net_inflow")))


def concept_counts(records: DataFrame, n: int = 20) -> DataFrame:
    return records.select(F.explode(comma_list(F.col("concepts"))).alias("concept")).groupBy("concept").agg(F.count("*").alias("records")).orderBy(F.desc("records"), "concept").limit(n)


def _holds(column: Column, words: list[str]) -> Column:
    return reduce(Column.__or__, (column.contains(w) for w in words), F.lit(False))


def _line(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise linear between points (x, y), flat beyond the ends."""
    out = F.when(x <= points[0][0], points[0][1])
    for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
        out = out.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0)))
    return out.otherwise(points[-1][1])


def _points_of(seat: Column, tier1: list[str], tier2: list[str]) -> Column:
    """Points of a buying record by its seat's tier."""
    return F.when(_holds(seat, tier1), 10.0).when(_holds(seat, tier2), 5.0).otherwise(1.5)


def quality_score(sum_points: Column) -> Column:
    """Buyer quality, 0 to 30: ten points a first-tier seat, five a second-tier, 1.5 any other buying record."""
    return F.least(sum_points, F.lit(30.0))


#: Points of the scores, as (value, score) between which a score is a straight line.
INFLOW_POINTS = [(0, 0), (1000, 10), (5000, 18), (10000, 22), (20000, 25)]
PRESSURE_POINTS = [(0.1, 20), (0.3, 15), (0.5, 10), (0.8, 5), (1.0, 0)]
#: Bonus by number of records, and by buys against sells.
SEAT_BONUS = {1: 3.0, 2: 2.5, 3: 2.0, 4: 1.5, 5: 1.5}
RATIO_BONUS = [(10, 2.0), (5, 1.5), (3, 1.0)]
#: Words of concepts in fashion.
HOT_WORDS = "人工智能 AI ChatGPT 算力 新能源 芯片 半导体 军工 医药 消费 5G 新材料 量子 光伏 储能 锂电池 汽车 游戏 传媒 元宇宙".split()
INSTITUTION_WORDS = "机构专用 机构 基金 保险 社保 QFII RQFII 券商 信托".split()


def inflow_score(net: Column) -> Column:
    """Net inflow, 0 to 25, by millions; nothing for an outflow."""
    return F.when(net <= 0, 0.0).otherwise(_line(net / WAN, INFLOW_POINTS))


def pressure_score(buy: Column, sell: Column) -> Column:
    """Sell pressure, 0 to 20: the lower the share of sells against buys, the better; 0 without buys."""
    return F.when(buy <= 0, 0.0).otherwise(_line(sell / buy, PRESSURE_POINTS))


def institution_score(houses: Column, others: Column) -> Column:
    """Buying institutions, 0 to 15: most where other seats buy too; alone 8 and two each up to 12; other seats alone 5 and one each up to 10."""
    alone = F.when(houses > 0, F.least(8.0 + houses * 2, F.lit(12.0))).when(others > 0, F.least(5.0 + others, F.lit(10.0))).otherwise(0.0)
    return F.when((houses > 0) & (others > 0), 15.0).otherwise(alone)


def bonus_score(records: Column, hot: Column, buy: Column, sell: Column) -> Column:
    """Bonus, 0 to 10: few seats, concepts in fashion (0.3 each, 3 at most), repeats on the board, buys well above sells."""
    few = F.lit(1.0)
    for n, points in SEAT_BONUS.items():
        few = F.when(records == n, points).otherwise(few)
    again = F.least(F.lit(2.0), records - 1.0)
    against = F.lit(0.0)
    for least, points in reversed(RATIO_BONUS):
        against = F.when((buy > 0) & (buy / (sell + 1) >= least), points).otherwise(against)
    return F.least(F.lit(10.0), few + F.least(hot * 0.3, F.lit(3.0)) + again + against)


def stock_scores(records: DataFrame, *, tier1: list[str], tier2: list[str], institutions: list[str], hot: list[str]) -> DataFrame:
    """The composite score of every stock from its records, in one aggregation."""
    seat, buying = F.concat_ws(" ", "youzi_name", "yingye_bu"), F.col("buy_amount") > 0
    first, house = _holds(seat, tier1), _holds(seat, institutions)
    # Records come down to stock and seat, and to stock and concepts, before words are looked for.
    amounts = ("buy_amount", "sell_amount", "net_inflow")
    by_seat = records.groupBy("stock_code", "youzi_name", "yingye_bu", buying.alias("__buying")).agg(F.min("stock_name").alias("stock_name"), F.count("*").alias("n"), *(F.sum(c).alias(c) for c in amounts))
    buys = F.when(F.col("__buying"), F.col("n")).otherwise(0)
    marked = by_seat.select("stock_code", "stock_name", "youzi_name", "n", *amounts, (_points_of(seat, tier1, tier2) * buys).alias("p"), F.when(first, buys).otherwise(0).alias("f"), F.when(house, buys).otherwise(0).alias("h"), F.when(~house, buys).otherwise(0).alias("o"))
    g = marked.groupBy("stock_code").agg(
        F.min("stock_name").alias("stock_name"), F.sum("p").alias("points"), *(F.sum(c).alias(c) for c in amounts), F.countDistinct("youzi_name").alias("seats"),
        F.sum("n").alias("records"), F.sum("h").alias("institution_count"), F.sum("o").alias("other_buyers"), F.sum("f").alias("tier1_count"),
    )
    listed = records.groupBy("stock_code", F.coalesce("concepts", F.lit("")).alias("c")).agg(F.count("*").alias("n"))
    warm = F.size(F.filter(comma_list(F.col("c")), lambda c: _holds(c, hot)))
    heat = listed.groupBy(F.col("stock_code").alias("__code")).agg(F.sum(warm * F.col("n")).alias("hot"))
    g = g.join(heat, F.col("stock_code").eqNullSafe(F.col("__code")))
    buy, sell = F.col("buy_amount").cast("double"), F.col("sell_amount").cast("double")
    g = g.withColumns(
        {
            "capital_quality": quality_score(F.col("points")),
            "inflow": inflow_score(F.col("net_inflow").cast("double")),
            "sell_pressure": pressure_score(buy, sell),
            "institutions": institution_score(F.col("institution_count"), F.col("other_buyers")),
            "bonus": bonus_score(F.col("records"), F.col("hot"), buy, sell),
        }
    )
    parts = ("capital_quality", "inflow", "sell_pressure", "institutions", "bonus")
    total = reduce(Column.__add__, (F.col(p) for p in parts))
    return g.withColumn("score", F.round(total, 4)).select("stock_code", "stock_name", "seats", "institution_count", "tier1_count", *parts, "score")


def ranked_stocks(scores: DataFrame, top: int = 100) -> DataFrame:
    """The best stocks with their ranks."""
    return score_rank(scores, score="score", key="stock_code", top=top)
