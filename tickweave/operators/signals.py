"""Latest rows, memberships, pages, feeds and signal rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import ordered_concat
from .blocks import Ranges
from .universe import resolve_column
from .windows import by, latest


def latest_per_parent(parents: DataFrame, rows: DataFrame, *, key: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    """Each parent with its latest row, or nulls."""
    last = latest(rows, key=key, order=[F.desc(time), F.desc(tie)]).select(key, *columns)
    return parents.join(last, key, "left")


def latest_by_either_code(items: DataFrame, rows: DataFrame, *, code: str = "code", time: str, tie: str, columns: list[str]) -> DataFrame:
    """Items with the latest row whose code equals theirs, or their code's part before the dot: two key forms, one equi-join."""
    forms = items.select(code, F.explode(F.array_distinct(F.array(F.col(code), F.split_part(F.col(code), F.lit("."), F.lit(1))))).alias("__form"))
    met = forms.join(rows.withColumnRenamed(code, "__form"), "__form")
    last = latest(met, key=code, order=[F.desc(time), F.desc(tie)]).select(code, *columns)
    return items.join(last, code, "left")


def board_daily(daily: DataFrame, index: DataFrame, day: str, n: int, *, kind: str | None = None) -> DataFrame:
    """A day's boards with their latest name and type at or before it (rows without a date last), largest amounts first."""
    at = F.lit(day).cast("date")
    names = index.filter(F.col("trade_date").isNull() | (F.col("trade_date") <= at))
    names = names.withColumn("__r", F.row_number().over(by("ts_code", F.desc_nulls_last("trade_date")))).filter("__r = 1").select("ts_code", "name", "idx_type")
    rows = daily.filter(F.col("trade_date") == at).join(names, "ts_code")
    rows = rows if kind is None else rows.filter(F.col("idx_type") == kind)
    return rows.orderBy("idx_type", F.desc_nulls_last("amount"), "ts_code").limit(n)


def top_constituents(members: DataFrame, quotes: DataFrame, board: str, metric: str, n: int) -> DataFrame:
    rows = members.filter(F.col("board_code") == board).join(quotes.withColumnRenamed("ts_code", "con_code"), "con_code")
    return rows.orderBy(F.desc_nulls_last(metric), "con_code").limit(n)


def with_categories(items: DataFrame, bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """Items with the ordered names of their categories and how many there are."""
    named = bridge.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id").groupBy(F.col("item_id").alias("id")).agg(ordered_concat(F.col("name")).alias("categories"), F.countDistinct("name").alias("n_categories"))
    return items.join(named, "id", "left").withColumn("n_categories", F.coalesce("n_categories", F.lit(0)))


#: Rows before a page up to which the rows of all pages so far are simply ordered.
SHALLOW = 1000


def page(df: DataFrame, sort: str, *, allowed: dict[str, str], tie: str, offset: int, limit: int, descending: bool = True) -> DataFrame:
    """A page of rows by an allowed sort key, nulls last, ties by another column, with the count of all rows.

    Deep pages are looked up by counted ranges of the sort key: only the ranges that hold the page are ordered.
    """
    name = allowed.get(sort, next(iter(allowed.values())))
    if offset > SHALLOW:
        ranges = Ranges(df, [(name, descending), (tie, False)])
        return ranges.page(offset, limit).withColumn("total", F.lit(ranges.total).cast("long"))
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(F.desc_nulls_last(name) if descending else F.asc_nulls_last(name), tie).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total))  # one row


def newest(df: DataFrame, *, time: str, tie: str, limit: int, offset: int = 0, source: str | None = None, first: list[Column] | None = None) -> DataFrame:
    """The newest rows, of one source if given; ``first`` sorts before time. Deep pages without it go by counted ranges."""
    rows = df if source is None else df.filter(F.col("source") == source)
    if offset > SHALLOW and not first:
        return Ranges(rows, [(time, True), (tie, True)]).page(offset, limit)
    return rows.orderBy(*(first or []), F.desc(time), F.desc(tie)).offset(offset).limit(limit)


def both_ends(df: DataFrame, *, value: str, tie: str, n: int = 10) -> DataFrame:
    """The n rows of largest and of least value, with their side and rank."""
    ends = []
    for side, order in (("top", F.desc_nulls_last(value)), ("bottom", F.asc_nulls_last(value))):
        rows = df.orderBy(order, tie).limit(n).withColumn("side", F.lit(side))
        ends.append(latest(rows, n, key="side", order=[order, F.col(tie)], rank="rank"))
    return ends[0].unionByName(ends[1])


def signal_rows(df: DataFrame, *, symbol: str, at: str, mean: str, deviation: str, frequency: str, horizon: str) -> DataFrame:
    """Model output as signal rows: direction by the sign of the mean, deviation without sign, votes as JSON."""
    m = F.col(mean)
    direction = F.when(m > 0, "up").when(m < 0, "down").otherwise("flat")
    return df.select(
        F.col(symbol).alias("symbol"), F.lit(at).cast("timestamp").alias("as_of_time"), F.lit(frequency).alias("frequency"), F.lit(horizon).alias("horizon"), direction.alias("direction"), m.alias("expected_return"), F.abs(F.col(deviation)).alias("expected_volatility"),
        F.to_json(F.struct(direction.alias("model"))).alias("votes"),
    )


def indicator_pivot(df: DataFrame, periods: list[str], indicators: list[str], *, name: str = "indicator") -> DataFrame:
    """Wide period columns to a row for each period, with a column for each chosen indicator."""
    long = df.filter(F.col(name).isin(indicators)).unpivot([name], periods, "period", "value")
    return long.groupBy("period").pivot(name, indicators).agg(F.first("value"))


def top_by_flow(df: DataFrame, n: int, *, patterns: list[str], tie: str) -> DataFrame:
    """The n rows of largest flow, nulls last; without a column that a pattern names, the first n by the tie column."""
    column = resolve_column(df, patterns)
    order = [F.col(tie)] if column is None else [F.desc_nulls_last(column), F.col(tie)]
    return df.orderBy(*order).limit(n)


def top_movers(df: DataFrame, n: int, *, by_amount: bool = False, change: str = "pct_chg", amount: str = "amount_li", tie: str = "ts_code") -> DataFrame:
    """The n stocks of largest change, or of largest amount."""
    return df.orderBy(F.desc_nulls_last(amount if by_amount else change), tie).limit(n)


def northbound(flows: DataFrame, n: int = 20, *, time: str = "trade_date", value: str = "net") -> DataFrame:
    """The last n days of a flow, newest first by ``rank``; the row of rank 1 is the latest, with the sum over all n."""
    days = flows.orderBy(F.desc(time)).limit(n).withColumn("__k", F.lit(1))
    rows = latest(days, n, key="__k", order=[F.desc(time)], rank="rank").drop("__k")
    total = rows.agg(F.sum(value).alias(f"{value}_sum"))
    return rows.crossJoin(F.broadcast(total))  # one row


def news_within(news: DataFrame, now: str, hours: int, *, limit: int, time: str = "publish_time", important: str = "is_important", tie: str = "id") -> DataFrame:
    """News of the last hours, important ones first, then the newest."""
    at = F.lit(now).cast("timestamp")
    rows = news.filter((F.col(time) <= at) & (F.col(time) >= at - F.make_dt_interval(hours=F.lit(hours))))
    return newest(rows, time=time, tie=tie, limit=limit, first=[F.desc(F.col(important))])
