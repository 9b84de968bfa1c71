"""Scans and landing of market data: filters that reach the files, and raw records made into typed rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codes import any_date
from ..operators.windows import latest

#: Codes up to so many are a plain filter; more of them become a semi join.
CODES_IN_FILTER = 1000


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table with its contract's schema; nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def on_days(time: str, start: str, end: str) -> Column:
    """Times from the first to the last of some days: a range of the stored column, which reaches the files."""
    first, after = F.lit(start).cast("date"), F.date_add(F.lit(end).cast("date"), 1)
    return (F.col(time) >= first.cast("timestamp")) & (F.col(time) < after.cast("timestamp"))


def codes_and_dates(df: DataFrame, codes: list[str] | DataFrame | None, start: str, end: str, *, symbol: str = "ts_code", day: str = "trade_date") -> DataFrame:
    """Rows of some codes between two dates, both included: daily bars, boards, members, minute bars by their date partition."""
    return of_codes(df.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date"))), codes, symbol=symbol)


def of_codes(rows: DataFrame, codes: list[str] | DataFrame | None, *, symbol: str = "ts_code") -> DataFrame:
    """Rows of some codes; all rows without codes."""
    if isinstance(codes, DataFrame):
        return rows.join(codes.select(symbol).distinct(), symbol, "left_semi")
    if codes is None:
        return rows
    if len(codes) <= CODES_IN_FILTER:
        return rows.filter(F.col(symbol).isin(codes))
    wanted = rows.sparkSession.createDataFrame([(c,) for c in codes], f"{symbol} string")
    return rows.join(wanted, symbol, "left_semi")


def minute_scan(df: DataFrame, codes: list[str] | DataFrame | None, start: str, end: str, freq: str, *, time: str = "trade_time") -> DataFrame:
    """Minute bars of a frequency. With a ``trade_date`` partition column only its partitions are read."""
    rows = df.filter(F.col("freq") == freq)
    if "trade_date" in df.columns:
        return codes_and_dates(rows, codes, start, end)
    return of_codes(rows.filter(on_days(time, start, end)), codes)


def board_index(df: DataFrame, start: str, end: str, kinds: list[str] | None = None) -> DataFrame:
    """Board rows of some types; a count that is no number is 0."""
    rows = codes_and_dates(df, None, start, end)
    rows = rows if kinds is None else rows.filter(F.col("idx_type").isin(kinds))
    return rows.withColumn("idx_count", F.coalesce(F.col("idx_count").cast("string").try_cast("int"), F.lit(0)))


def index_daily(basics: DataFrame, daily: DataFrame, markets: list[str]) -> DataFrame:
    """Daily rows of the indexes of some markets; ``vol`` becomes ``volume``."""
    chosen = basics.filter(F.col("market").isin(markets)).select("ts_code", "name")
    return daily.join(chosen, "ts_code").withColumnRenamed("vol", "volume")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Different values of a column, blanks left out."""
    return df.select(column).filter(F.trim(F.col(column).cast("string")) != "").distinct()


def span(df: DataFrame, *, time: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.min(F.to_date(time)).alias("first_day"), F.max(F.to_date(time)).alias("last_day"))


@dataclass
class Field:
    """How a column is landed: names it may have, its type, and a factor for numbers."""

    name: str
    names: tuple[str, ...]
    kind: str
    factor: float | None = None

    def column(self, have: list[str]) -> Column:
        got = [F.col(n).cast("string") for n in self.names if n in have]
        text = F.coalesce(*(F.nullif(F.trim(g), F.lit("")) for g in got)) if got else F.lit(None).cast("string")
        if self.kind == "date":
            return any_date(text).alias(self.name)
        value = text if self.kind == "string" else text.try_cast("double" if self.factor is not None else self.kind)
        if self.factor is not None:
            value = F.round(value * self.factor).cast(self.kind) if self.kind in ("int", "long") else (value * self.factor).cast(self.kind)
        return value.alias(self.name)


def land(df: DataFrame, fields: list[Field], required: list[str]) -> DataFrame:
    """Typed rows from raw records: the first non-blank of several names, dates in three shapes, numbers coerced and scaled.

    Rows that lack a required column are dropped.
    """
    return df.select(*(f.column(df.columns) for f in fields)).dropna(subset=required)


#: Raw daily bars in yuan and hands, under the names that vendors use.
RAW_DAILY = [
    Field("ts_code", ("ts_code", "code", "symbol"), "string"), Field("trade_date", ("trade_date", "date", "Date"), "date"),
    Field("open_li", ("open", "Open"), "int", 1000), Field("high_li", ("high", "High"), "int", 1000), Field("low_li", ("low", "Low"), "int", 1000), Field("close_li", ("close", "Close", "Last"), "int", 1000),
    Field("volume_hand", ("volume", "vol", "Volume"), "long", 1), Field("amount_li", ("amount", "Amount"), "long", 1000),
]


#: Columns of vendor tables that are landed: keys, dates and texts as they are, numbers as doubles.
_SIZES = [f"{side}_{size}_{kind}" for size in ("sm", "md", "lg", "elg") for side in ("buy", "sell") for kind in ("vol", "amount")]
VENDOR_TABLES: dict[str, dict[str, list[str]]] = {
    "adj_factor": {"keys": ["ts_code", "trade_date"], "numbers": ["adj_factor"]},
    "moneyflow": {"keys": ["ts_code", "trade_date"], "numbers": [*_SIZES, "net_mf_vol", "net_mf_amount"]},
    "moneyflow_ind": {"keys": ["ts_code", "trade_date"], "texts": ["name"], "numbers": ["pct_change", "close", "net_amount", "net_amount_rate"]},
    "daily_basic": {"keys": ["ts_code", "trade_date"], "numbers": "close turnover_rate turnover_rate_f volume_ratio pe pe_ttm pb ps ps_ttm dv_ratio dv_ttm total_share float_share free_share total_mv circ_mv".split()},
    "stock_basic": {"keys": ["ts_code"], "texts": "symbol name area industry market exchange list_status is_hs".split(), "dates": ["list_date", "delist_date"]},
    "stock_st": {"keys": ["ts_code", "trade_date"], "texts": ["name", "type", "type_name"]},
    "bak_basic": {"keys": ["ts_code", "trade_date"], "texts": ["name", "industry", "area"], "numbers": "pe float_share total_share total_assets liquid_assets fixed_assets eps bvps pb rev_yoy profit_yoy gpr npr holder_num".split(), "dates": ["list_date"]},
    "index_basic": {"keys": ["ts_code"], "texts": "name fullname market publisher index_type category weight_rule".split(), "numbers": ["base_point"], "dates": ["base_date", "list_date", "exp_date"]},
    "index_daily": {"keys": ["ts_code", "trade_date"], "numbers": "open high low close pre_close change pct_chg vol amount".split()},
    "board_index": {"keys": ["ts_code", "trade_date"], "texts": ["name", "idx_type", "idx_count"], "numbers": ["total_share", "float_share", "total_mv", "float_mv"]},
    "board_member": {"keys": ["ts_code", "con_code", "trade_date"], "texts": ["con_name"]},
    "board_daily": {"keys": ["ts_code", "trade_date"], "numbers": "open high low close pre_close change pct_change vol amount".split()},
}


def vendor_fields(table: str) -> tuple[list[Field], list[str]]:
    """Fields of a vendor table and its key columns, for ``land``."""
    of = VENDOR_TABLES[table]
    kinds = {c: "date" if c == "trade_date" else "string" for c in of["keys"]}
    kinds |= {c: "string" for c in of.get("texts", [])} | {c: "date" for c in of.get("dates", [])} | {c: "double" for c in of.get("numbers", [])}
    return [Field(c, (c,), kind) for c, kind in kinds.items()], of["keys"]


def minute_time(day: Column, text: Column) -> Column:
    """A UTC time from a bare ``HH:MM`` or ``HH:MM:SS`` of a day at +08:00, or from ISO text (naive text is UTC)."""
    t = F.trim(text)
    full = F.when(t.rlike(r"^\d{2}:\d{2}$"), F.concat(t, F.lit(":00"))).when(t.rlike(r"^\d{2}:\d{2}:\d{2}$"), t)
    local = F.try_to_timestamp(F.concat(day.cast("string"), F.lit(" "), full), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.coalesce(F.to_utc_timestamp(local, "Asia/Shanghai"), F.when(full.isNull(), t.try_cast("timestamp")))


def screening_rows(df: DataFrame, *, response: str) -> DataFrame:
    """Rows (code, key, title, value) of a nested screening response: headers (one level of children, hidden ones skipped) by a list of row objects.

    A code's first row counts. Titles carry the unit. A response is parsed once; its rows are dealt out with the headers
    alone, so that a row costs the same in a long response as in a short one.
    """
    head = "struct<key:string,title:string,unit:string,hidden:boolean>"
    shape = f"struct<columns:array<struct<key:string,title:string,unit:string,hidden:boolean,children:array<{head}>>>,rows:array<map<string,string>>>"
    r = df.select(F.from_json(response, shape).alias("r"))
    unit = lambda h: F.when(h["unit"] != "", F.concat(F.lit("("), h["unit"], F.lit(")"))).otherwise("")
    plain = lambda h: F.named_struct(F.lit("key"), h["key"], F.lit("title"), F.concat(h["title"], unit(h)), F.lit("hidden"), F.coalesce(h["hidden"], F.lit(False)))
    heads = F.flatten(F.transform("r.columns", lambda h: F.when(F.size(h["children"]) > 0, F.transform(h["children"], plain)).otherwise(F.array(plain(h)))))
    heads = F.filter(heads, lambda h: ~h["hidden"])
    r = r.select(heads.alias("heads"), "r.rows")  # before the rows are dealt out, which else would each carry the response
    rows = r.select("heads", F.posexplode("rows").alias("n", "row")).withColumn("code", F.col("row")["code"]).filter("code is not null")
    rows = latest(rows, key="code", order=[F.col("n")])
    return rows.select("code", "row", F.explode("heads").alias("h")).select("code", F.col("h.key").alias("key"), F.col("h.title").alias("title"), F.element_at("row", F.col("h.key")).alias("value"))


def first_filled(df: DataFrame, out: dict[str, list[str]]) -> DataFrame:
    """Columns from the first non-blank of several others, as text; absent ones are skipped."""
    made = {k: F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in names if c in df.columns), F.lit(None).cast("string")) for k, names in out.items()}
    return df.select(*(v.alias(k) for k, v in made.items()))


def news_items(df: DataFrame, feed: str, *, body: str = "body") -> DataFrame:
    """One shape for three feeds of JSON items: cls (epoch seconds, level), sina (local time at +08:00, tags), tv (epoch seconds)."""
    shapes = {
        "cls": "id string, ctime long, title string, content string, level string, shareurl string",
        "sina": "id string, create_time string, rich_text string, docurl string, tag array<struct<name:string>>",
        "tv": "id string, published long, title string, shortDescription string, link string",
    }
    r = df.select(F.from_json(body, shapes[feed]).alias("r")).select("r.*").filter("id is not null")
    if feed == "cls":
        out = r.select(F.lit(feed).alias("source"), F.col("id").alias("external_id"), F.timestamp_seconds("ctime").alias("publish_time"), "title", "content", F.col("shareurl").alias("url"), (F.coalesce("level", F.lit("C")) != "C").alias("is_important"))
    elif feed == "sina":
        hot = F.exists(F.coalesce("tag", F.array().cast("array<struct<name:string>>")), lambda t: t["name"].contains("焦点"))
        out = r.select(F.lit(feed).alias("source"), F.col("id").alias("external_id"), F.to_utc_timestamp(F.try_to_timestamp("create_time"), "Asia/Shanghai").alias("publish_time"), F.substring("rich_text", 1, 60).alias("title"), F.col("rich_text").alias("content"), F.col("docurl").alias("url"), hot.alias("is_important"))
    else:
        out = r.select(F.lit(feed).alias("source"), F.col("id").alias("external_id"), F.timestamp_seconds("published").alias("publish_time"), "title", F.col("shortDescription").alias("content"), F.col("link").alias("url"), F.lit(False).alias("is_important"))
    return out.filter("publish_time is not null")


def apply_units(df: DataFrame, registry: DataFrame, dataset: str, source: str) -> DataFrame:
    """Multiply columns by the registry's factors for a data set and source (registry: dataset, source, field, factor; a row for each field)."""
    factors = {r["field"]: r["factor"] for r in registry.filter((F.col("dataset") == dataset) & (F.col("source") == source)).collect()}
    return df.withColumns({c: F.col(c) * F.lit(float(f)) for c, f in factors.items() if c in df.columns and f is not None})


def cross_section(df: DataFrame, *, time: str, at: str | None = None, kind: tuple[str, object] | None = None) -> DataFrame:
    """Rows of a time, or of the latest; of one category if given."""
    rows = df if kind is None else df.filter(F.col(kind[0]) == kind[1])
    if at is not None:
        return rows.filter(F.col(time) == F.lit(at).cast(df.schema[time].dataType))
    return rows.join(F.broadcast(rows.agg(F.max(time).alias(time))), time)  # one row
