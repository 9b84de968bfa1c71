"""Universes, filters and screens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of text whose trigrams one range of a search index holds, about; more of them make more ranges.
RANGE_CHARS = 400_000


def by_exchange(df: DataFrame, exchanges: tuple[str, ...] = ("SH", "SZ"), *, symbol: str = "ts_code", keep_unknown: bool = False) -> DataFrame:
    hit = reduce(Column.__or__, (F.upper(F.col(symbol)).endswith(f".{e}") for e in exchanges), F.lit(False))
    return df.filter(hit | ~F.col(symbol).rlike(r"(?i)\.(SH|SZ|BJ)$") if keep_unknown else hit)


def without_st(df: DataFrame, st: DataFrame, *, symbol: str = "ts_code") -> DataFrame:
    """Symbols that never were under special treatment."""
    return df.join(st.select(symbol).distinct(), symbol, "left_anti")


def without_delisted(df: DataFrame, basics: DataFrame, *, symbol: str = "ts_code") -> DataFrame:
    return df.join(basics.filter(F.col("list_status").isin("D", "P")).select(symbol).distinct(), symbol, "left_anti")


def traded_universe(bars: DataFrame, start: str, end: str, st: DataFrame, basics: DataFrame, exchanges: tuple[str, ...] = ("SH", "SZ"), *, symbol: str = "ts_code", time: str = "trade_time") -> DataFrame:
    """Symbols with bars between two dates, after the exchange, treatment and listing filters."""
    day = F.to_date(time)
    rows = bars.filter((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date"))).select(symbol).distinct()
    return without_delisted(without_st(by_exchange(rows, exchanges, symbol=symbol), st, symbol=symbol), basics, symbol=symbol)


def core_universe(items: DataFrame, bridge: DataFrame, categories: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Codes of watched items in the named categories, or in any."""
    chosen = categories if names is None else categories.filter(F.col("name").isin(names))
    linked = bridge.join(chosen.select(F.col("id").alias("category_id")), "category_id")
    return items.join(linked.select(F.col("item_id").alias("id")), "id").select("code").distinct()


def plain_stocks(df: DataFrame, *, symbol: str = "ts_code", name: str = "name") -> DataFrame:
    """Names without ST in any case, codes of the main, growth and science boards."""
    return df.filter(~F.coalesce(F.col(name), F.lit("")).rlike("(?i)ST") & F.col(symbol).rlike(r"^[036]\d{5}\."))


def threshold_chain(df: DataFrame, rules: list[tuple[str, str | None, str | None]]) -> tuple[DataFrame, list[str], list[str]]:
    """Apply (column, least, most) rules; those of absent columns are skipped. Returns also what was applied and skipped."""
    applied, skipped = [], []
    for column, least, most in rules:
        if column not in df.columns:
            skipped.append(column)
            continue
        if least is not None:
            df = df.filter(F.col(column) >= F.lit(least))
        if most is not None:
            df = df.filter(F.col(column) <= F.lit(most))
        applied.append(column)
    return df, applied, skipped


def resolve_column(df: DataFrame, patterns: list[str]) -> str | None:
    """The first column whose name holds a pattern, patterns in order of priority."""
    return next((c for p in patterns for c in df.columns if p in c), None)


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers; text with separators is read, anything else is null."""
    return df.withColumns({c: F.regexp_replace(F.col(c).cast("string"), "[,%]", "").try_cast("double") for c in columns})


def to_hundred_millions(df: DataFrame, column: str, *, limit: float = 100_000, large: float = 1e8, small: float = 1.0) -> DataFrame:
    """Divide a column by ``large`` if its maximum is above the limit, else by ``small``: units told by their size."""
    top = df.agg(F.max(F.col(column).cast("double")).alias("__top"))
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("__top") > limit, F.col(column) / large).otherwise(F.col(column) / small)).drop("__top")  # one row


def cap_and_change(df: DataFrame, *, cap: str, change: str, least_cap: float, most_cap: float, most_change: float) -> DataFrame:
    return df.filter(F.col(cap).between(least_cap, most_cap) & (F.col(change) < most_change))


def keyword_search(df: DataFrame, keyword: str, columns: tuple[str, ...] = ("code", "name")) -> DataFrame:
    """Rows where a column holds the keyword, in any case."""
    word = keyword.lower()
    return df.filter(reduce(Column.__or__, (F.lower(F.col(c)).contains(word) for c in columns)))


def _grams(text: Column) -> Column:
    """The distinct runs of three characters of a text, in lower case; null and shorter texts have none."""
    low = F.lower(text)
    runs = F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: low.substr(i, F.lit(3)))
    return F.when(F.length(low) >= 3, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def search_index(df: DataFrame, key: str, columns: tuple[str, ...] = ("code", "name")) -> DataFrame:
    """Trigram lists of some columns: gram and key, sorted by gram so that files, once written, are skipped by it.

    Characters are counted first, as no text has more trigrams than these: there are as many ranges as keep each to about
    RANGE_CHARS, whatever the table's size. A range is made distinct where it lies.
    """
    chars = df.agg(sum((F.coalesce(F.sum(F.length(F.col(c))), F.lit(0)) for c in columns), F.lit(0))).first()[0]
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // RANGE_CHARS))
    grams = reduce(F.array_union, (_grams(F.col(c)) for c in columns))
    rows = df.select(F.explode(grams).alias("gram"), F.col(key)).repartitionByRange(ranges, "gram", key)
    return rows.dropDuplicates(["gram", key]).sortWithinPartitions("gram", key)


def search_candidates(index: DataFrame, keyword: str, key: str) -> DataFrame:
    """Keys that have every trigram of a keyword of three characters or more, in whichever column."""
    word = keyword.lower()
    grams = sorted({word[i : i + 3] for i in range(len(word) - 2)})
    return index.filter(F.col("gram").isin(grams)).groupBy(key).agg(F.countDistinct("gram").alias("__n")).filter(F.col("__n") == len(grams)).select(key)


def indexed_search(df: DataFrame, index: DataFrame, keyword: str, key: str, columns: tuple[str, ...] = ("code", "name")) -> DataFrame:
    """``keyword_search`` over the candidates of the index alone; a keyword too short for it scans the table."""
    if len(keyword.lower()) < 3:
        return keyword_search(df, keyword, columns)
    return keyword_search(df.join(search_candidates(index, keyword, key), key, "left_semi"), keyword, columns)


def in_category(items: DataFrame, bridge: DataFrame, category_id: int) -> DataFrame:
    """Items that the bridge puts in a category."""
    return items.join(bridge.filter(F.col("category_id") == category_id).select(F.col("item_id").alias("id")), "id", "left_semi")


def opening_screen(day: DataFrame, basics: DataFrame, averages: DataFrame, flows: DataFrame, rules: list[tuple[str, str | None, str | None]], n: int, *, symbol: str = "ts_code") -> DataFrame:
    """The opening screen: a day's rows with basics, moving average and window flow, through the rules, best change first."""
    rows = day.join(basics, symbol).join(averages, symbol, "left").join(flows, symbol, "left")
    rows, _, _ = threshold_chain(rows, rules)
    return rows.orderBy(F.desc_nulls_last("pct_chg"), symbol).limit(n)


def screen_summary(df: DataFrame, *, flow: str, change: str, industry: str, n: int = 10) -> DataFrame:
    """One row: stocks, sum and mean of a flow, mean, least and largest change, and the n commonest industries with their counts."""
    one = df.agg(F.count("*").alias("stocks"), F.sum(flow).alias("flow_sum"), F.avg(flow).alias("flow_mean"), F.avg(change).alias("change_mean"), F.min(change).alias("change_min"), F.max(change).alias("change_max"))
    common = df.filter(F.col(industry).isNotNull()).groupBy(industry).agg(F.count("*").alias("c")).orderBy(F.desc("c"), industry).limit(n)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(industry).alias("name"))))  # n rows
    text = common.agg(F.array_join(F.transform(ordered, lambda x: F.concat(x["name"], F.lit(":"), (-x["c"]).cast("string"))), ",").alias("industries"))
    return one.crossJoin(F.broadcast(text))  # one row
