"""Registered queries of operators that other queries do not reach: scans, landing, sinks, screens, panels, risk and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import bars, breadth, coverage, flows, indicators, orderflow, prices, quality, risk, sequences, signals, text, trend, universe, windows
from ..sources import contracts as c
from ..sources import scans, sinks
from ..streaming import streams
from .market import PANEL, panel, plain
from .market_more import scratch
from .sql import BARS, BUCKETS, CALENDAR, FACTORS, FLOWS, MINUTES, NEWS, QUOTES, TICKS, code, day, r6, ts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def date(text_: str):
    return F.lit(text_).cast("date")


# --- scans and landing ----------------------------------------------------------------------------------------------
@query("s4_board_daily", f"WITH {QUOTES} SELECT ts_code, {day('trade_date')}, open_li, high_li, low_li, close_li, volume_hand, {r6('pct_chg')} FROM quotes WHERE ts_code IN (SELECT {code('n_nationkey')} FROM nation WHERE n_regionkey = 2) AND trade_date BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def s4_board_daily(spark, d):
    boards = c.table(spark, d, "nation").filter("n_regionkey = 2").select(c.code_of(F.col("n_nationkey")).alias("ts_code"))
    return scans.codes_and_dates(c.quotes(spark, d), boards, "1996-01-01", "1997-06-30").select("ts_code", "trade_date", "open_li", "high_li", "low_li", "close_li", "volume_hand", "pct_chg")


@query("s5_board_index", f"SELECT {code('c_custkey')} AS ts_code, CAST(DATE '1995-01-01' + CAST(c_custkey % 400 AS INTEGER) AS VARCHAR) AS trade_date, c_mktsegment AS idx_type, CAST(CASE WHEN c_custkey % 5 > 0 AND c_custkey % 7 > 0 THEN c_custkey % 100 ELSE 0 END AS INTEGER) AS idx_count FROM customer WHERE c_custkey % 400 <= 180 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def s5_board_index(spark, d):
    k = F.col("c_custkey")
    count = F.when(k % 5 == 0, "n/a").when(k % 7 > 0, (k % 100).cast("string"))
    index = c.table(spark, d, "customer").select(c.code_of(k).alias("ts_code"), F.date_add(date("1995-01-01"), (k % 400).cast("int")).alias("trade_date"), F.col("c_mktsegment").alias("idx_type"), count.alias("idx_count"))
    return scans.board_index(index, "1995-01-01", "1995-06-30", ["BUILDING", "MACHINERY"])


@query("s6_board_members", f"SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS trade_date, {code('c_nationkey')} AS ts_code, {code('c_custkey')} AS con_code, c_name AS con_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey IN (3, 7) AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def s6_board_members(spark, d):
    k = c.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    members = c.table(spark, d, "orders").join(k, F.col("o_custkey") == F.col("c_custkey")).select(F.to_date("o_orderdate").alias("trade_date"), c.code_of(F.col("c_nationkey")).alias("ts_code"), c.code_of(F.col("c_custkey")).alias("con_code"), F.col("c_name").alias("con_name"))
    return scans.codes_and_dates(members, ["000003.SZ", "000007.SH"], "1995-01-01", "1996-12-31")


@query("s7_index_daily", f"WITH {BARS} SELECT ts_code, n_name AS name, {day('trade_date')}, close_li, volume_hand AS volume FROM bars JOIN nation ON {code('n_nationkey')} = ts_code JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def s7_index_daily(spark, d):
    n = c.table(spark, d, "nation").join(c.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    basics = n.select(c.code_of(F.col("n_nationkey")).alias("ts_code"), F.col("n_name").alias("name"), F.col("r_name").alias("market"))
    daily = c.daily_bars(spark, d).withColumnRenamed("volume_hand", "vol")
    return scans.index_daily(basics, daily, ["ASIA", "EUROPE"]).select("ts_code", "name", "trade_date", "close_li", "volume")


@query(
    "s11_minute_time",
    """SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 1 MINUTE * (o_orderkey % 1440) - INTERVAL 8 HOUR
    WHEN 1 THEN CAST(o_orderdate AS DATE) + INTERVAL 1 MINUTE * (o_orderkey % 1440) + INTERVAL 7 SECOND - INTERVAL 8 HOUR WHEN 2 THEN CAST(o_orderdate AS DATE) + INTERVAL 1 MINUTE * (o_orderkey % 1440) END, '%Y-%m-%d %H:%M:%S') AS at FROM orders""",
)
def s11_minute_time(spark, d):
    k = F.col("o_orderkey")
    clock = F.concat(F.lpad(F.floor(k % 1440 / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((k % 60).cast("string"), 2, "0"))
    on = F.to_date("o_orderdate")
    said = F.when(k % 4 == 0, clock).when(k % 4 == 1, F.concat(clock, F.lit(":07"))).when(k % 4 == 2, F.concat(on.cast("string"), F.lit("T"), clock, F.lit(":00"))).otherwise("25 past")
    return c.table(spark, d, "orders").select("o_orderkey", scans.minute_time(on, said).alias("at"))


@query("s12_screening_rows", f"SELECT {code('c_custkey')} AS code, key, title, CASE key WHEN 'code' THEN {code('c_custkey')} WHEN 'rank' THEN CAST(c_nationkey AS VARCHAR) ELSE c_mktsegment END AS value FROM customer, (VALUES ('code', 'Code'), ('rank', 'Rank(place)'), ('seg', 'Segment')) AS t(key, title)")
def s12_screening_rows(spark, d):
    """Responses for each nation in pages of a range of customers, with nested and hidden headers, and each row twice, in one page."""
    head = lambda k, t, unit=None, hidden=False: F.struct(F.lit(k).alias("key"), F.lit(t).alias("title"), F.lit(unit).cast("string").alias("unit"), F.lit(hidden).alias("hidden"))
    none = F.array().cast("array<struct<key:string,title:string,unit:string,hidden:boolean>>")
    with_children = lambda h, kids: F.struct(h["key"].alias("key"), h["title"].alias("title"), h["unit"].alias("unit"), h["hidden"].alias("hidden"), kids.alias("children"))
    heads = F.array(with_children(head("code", "Code"), none), with_children(head("rank", "Rank", "place"), none), with_children(head("group", "Group"), F.array(head("seg", "Segment"), head("secret", "Secret", None, True))))
    k = F.col("c_custkey")
    row = lambda seg: F.struct(c.code_of(k).alias("code"), F.col("c_nationkey").cast("string").alias("rank"), seg.alias("seg"))
    rows = c.table(spark, d, "customer").groupBy("c_nationkey", F.floor(k / 1000).alias("page")).agg(F.concat(F.collect_list(row(F.col("c_mktsegment"))), F.collect_list(row(F.lit("again")))).alias("rows"))
    return scans.screening_rows(rows.select(F.to_json(F.struct(heads.alias("columns"), "rows")).alias("r")), response="r")


@query("s13_first_filled", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name WHEN c_custkey % 2 > 0 THEN c_mktsegment END AS name FROM customer")
def s13_first_filled(spark, d):
    k = F.col("c_custkey")
    raw = c.table(spark, d, "customer").select("c_custkey", F.when(k % 3 > 0, F.col("c_name")).otherwise("  ").alias("title"), F.when(k % 2 > 0, F.concat(F.lit(" "), F.col("c_mktsegment"))).otherwise("").alias("label"))
    return scans.first_filled(raw, {"id": ["c_custkey"], "name": ["missing", "title", "label"]}).select(F.col("id").cast("long").alias("id"), "name")


@query(
    "s14_news_feeds",
    f"""SELECT CASE doc_id % 3 WHEN 0 THEN 'cls' WHEN 1 THEN 'sina' ELSE 'tv' END AS source, CAST(doc_id AS VARCHAR) AS external_id,
    {ts("TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * doc_id", "publish_time")}, CASE doc_id % 3 WHEN 1 THEN substring('item ' || doc_id || ' of a feed', 1, 60) ELSE 'title ' || doc_id END AS title,
    'item ' || doc_id || ' of a feed' AS content, CASE doc_id % 3 WHEN 0 THEN doc_id % 2 = 0 WHEN 1 THEN doc_id % 5 = 0 ELSE false END AS is_important FROM documents WHERE doc_id % 11 > 0""",
)
def s14_news_feeds(spark, d):
    """A third of the documents in each of three feeds; items without a time are dropped."""
    k = F.col("doc_id")
    rows = c.table(spark, d, "documents").select("doc_id")
    at, said = F.when(k % 11 > 0, F.lit(1704067200) + k), F.concat(F.lit("item "), k.cast("string"), F.lit(" of a feed"))
    local = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(at), "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")
    key, title = k.cast("string").alias("id"), F.concat(F.lit("title "), k.cast("string")).alias("title")
    hot = F.when(k % 5 == 0, F.array(F.struct(F.lit("今日焦点").alias("name")))).otherwise(F.array(F.struct(F.lit("other").alias("name"))))
    shapes = {
        "cls": F.struct(key, at.alias("ctime"), title, said.alias("content"), F.when(k % 2 == 0, "B").otherwise("C").alias("level")),
        "sina": F.struct(key, local.alias("create_time"), said.alias("rich_text"), hot.alias("tag")),
        "tv": F.struct(key, at.alias("published"), title, said.alias("shortDescription")),
    }
    parts = [scans.news_items(rows.filter(k % 3 == i).select(F.to_json(s).alias("body")), feed).drop("url") for i, (feed, s) in enumerate(shapes.items())]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("s15_units", f"WITH {FLOWS} SELECT ts_code, {day('trade_date')}, round(net_mf_vol * 100.0, 6) + 0.0 AS net_mf_vol, round(net_mf_amount * 10000.0, 6) + 0.0 AS net_mf_amount FROM flows")
def s15_units(spark, d):
    rows = c.money_flow(spark, d).select("ts_code", "trade_date", F.col("net_mf_vol").cast("double").alias("net_mf_vol"), F.col("net_mf_amount").cast("double").alias("net_mf_amount"))
    units = spark.createDataFrame([("flow", "a", "net_mf_vol", 100.0), ("flow", "a", "net_mf_amount", 10000.0), ("flow", "b", "net_mf_vol", 7.0), ("flow", "a", "absent", 3.0)], "dataset string, source string, field string, factor double")
    return scans.apply_units(rows, units, "flow", "a")


@query("s16_vendor_landing", f"WITH {FLOWS} SELECT ts_code, {day('trade_date')}, {r6('buy_sm_vol::DOUBLE', 'buy_sm_vol')}, {r6('sell_elg_amount::DOUBLE', 'sell_elg_amount')}, {r6('CASE WHEN day(trade_date) > 2 THEN net_mf_amount::DOUBLE END', 'net_mf_amount')} FROM flows WHERE day(trade_date) <> 9")
def s16_vendor_landing(spark, d):
    """Money flow as a vendor sends it, all text, into typed rows; rows without a code are dropped."""
    on = F.dayofmonth("trade_date")
    raw = c.money_flow(spark, d)
    raw = raw.select(F.when(on == 9, " ").otherwise(F.col("ts_code")).alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), F.col("buy_sm_vol").cast("string").alias("buy_sm_vol"), F.col("sell_elg_amount").cast("string").alias("sell_elg_amount"), F.when(on > 2, F.col("net_mf_amount").cast("string")).otherwise("None").alias("net_mf_amount"))
    fields, keys = scans.vendor_fields("moneyflow")
    return scans.land(raw, fields, keys).select("ts_code", "trade_date", "buy_sm_vol", "sell_elg_amount", "net_mf_amount")


# --- sinks ----------------------------------------------------------------------------------------------------------
@query("k3_last_of_batch", "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey % 10 > 0 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def k3_last_of_batch(spark, d):
    o = c.table(spark, d, "orders").select(F.when(F.col("o_custkey") % 10 > 0, F.col("o_custkey")).alias("o_custkey"), "o_orderkey")
    return sinks.last_of_batch(o, ["o_custkey"], order="o_orderkey")


def _snapshot(spark: SparkSession, d: str) -> str:
    """Bars up to 1996 exported, then 1996 and later put in again with other closes."""
    folder = scratch(spark, "snapshot")
    rows = c.daily_bars(spark, d).select(F.col("ts_code").alias("instrument"), F.col("trade_date").alias("datetime"), "close_li")
    sinks.write_snapshot(rows.filter("datetime < '1997-01-01'"), folder, name="market", grain="month")
    later = rows.filter("datetime >= '1996-01-01'").withColumn("close_li", F.col("close_li") + 1)
    sinks.append_snapshot(later, folder, ["datetime", "instrument"], grain="month")
    return folder


@query("k5_snapshot_bars", f"WITH {BARS} SELECT ts_code AS instrument, {day('trade_date', 'datetime')}, CASE WHEN trade_date >= DATE '1996-01-01' THEN close_li + 1 ELSE close_li END AS close_li FROM bars")
def k5_snapshot_bars(spark, d):
    return spark.read.parquet(f"{_snapshot(spark, d)}/bars").select("instrument", "datetime", "close_li")


@query("k5_snapshot_meta", f"WITH {BARS} SELECT 'market' AS snapshot, (SELECT count(*) FROM bars) AS rows, {day('min(a)', 'first_day')}, {day('max(b)', 'last_day')}, count(*) AS instruments, CAST(sum(b - a) AS BIGINT) AS span_days, (SELECT count(DISTINCT trade_date) FROM bars) AS calendar_days FROM (SELECT min(trade_date) AS a, max(trade_date) AS b FROM bars GROUP BY ts_code)")
def k5_snapshot_meta(spark, d):
    """Spans, calendar and meta after an append."""
    folder = _snapshot(spark, d)
    spans = spark.read.parquet(f"{folder}/instruments").agg(F.count("*").alias("instruments"), F.sum(F.datediff("last_day", "first_day")).alias("span_days"))
    days = spark.read.parquet(f"{folder}/calendars").agg(F.count("*").alias("calendar_days"))
    return spark.read.parquet(f"{folder}/meta").crossJoin(spans).crossJoin(days)  # one row each


@query("k6_watermarks", f"WITH {BARS}, m AS (SELECT ts_code, max(trade_date) AS m FROM bars GROUP BY 1) SELECT ts_code AS data_type, CAST(CASE WHEN ts_code LIKE '%.SH' THEN m + 10 ELSE m END AS VARCHAR) || ' 15:00:00' AS last_datetime, CAST(CASE WHEN ts_code LIKE '%.SH' THEN m + 11 ELSE m + 1 END AS VARCHAR) AS start_day FROM m WHERE ts_code NOT LIKE '%.BJ'")
def k6_watermarks(spark, d):
    """A watermark for each symbol is set, set again for some and deleted for others; the next start follows from it."""
    last = c.daily_bars(spark, d).groupBy("ts_code").agg(F.max("trade_date").alias("m"))
    at = lambda day_: F.timestamp_add("HOUR", F.lit(15), day_.cast("timestamp"))
    state = last.select(F.lit("s").alias("snapshot_id"), F.col("ts_code").alias("data_type"), at(F.col("m")).alias("last_datetime"))
    new = last.filter(F.col("ts_code").endswith(".SH")).select(F.lit("s").alias("snapshot_id"), F.col("ts_code").alias("data_type"), at(F.date_add("m", 10)).alias("last_datetime"))
    state = sinks.with_watermark(state, new.unionByName(new.withColumn("last_datetime", F.col("last_datetime") - F.expr("INTERVAL 5 DAY"))))
    state = sinks.without_watermarks(state, state.filter(F.col("data_type").endswith(".BJ")))
    starts = sinks.watermark(state, "s", "000001.SH").select(F.lit(1))
    return state.join(F.broadcast(starts.limit(1)), how="left_semi").select("data_type", "last_datetime", F.to_date(F.col("last_datetime") + F.expr("INTERVAL 1 DAY")).alias("start_day"))


@query("k8_csv_per_symbol", f"WITH {BARS} SELECT ts_code AS symbol, {day('trade_date', 'date')}, open_li AS open, close_li AS close, CASE WHEN day(trade_date) > 5 THEN amount_li ELSE 0 END AS amount FROM bars")
def k8_csv_per_symbol(spark, d):
    folder = scratch(spark, "csv")
    rows = c.daily_bars(spark, d).select(F.col("trade_date").alias("date"), F.col("ts_code").alias("symbol"), *(F.col(f"{k}_li").alias(k) for k in ("open", "high", "low", "close")), F.col("volume_hand").alias("volume"), F.when(F.dayofmonth("trade_date") > 5, F.col("amount_li")).alias("amount"))
    sinks.write_csv_per_symbol(rows, folder)
    back = spark.read.option("header", True).schema("date date, symbol string, open long, high long, low long, close long, volume long, amount double, of string").csv(folder)
    return back.select("symbol", "date", "open", "close", F.col("amount").cast("long").alias("amount"))


@query("k10_next_versions", "WITH v AS (SELECT o_orderpriority AS data_type, CAST(o_orderdate AS DATE) AS data_date, max(o_orderkey) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2) SELECT o_orderkey, coalesce(v, 0) + 1 AS version FROM orders LEFT JOIN v ON data_type = o_orderpriority AND data_date = CAST(o_orderdate AS DATE) WHERE o_orderkey % 2 = 1")
def k10_next_versions(spark, d):
    o = c.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("data_date"), F.col("o_orderpriority").alias("data_type"))
    return sinks.next_versions(o.filter("o_orderkey % 2 = 0").withColumn("version", F.col("o_orderkey")), o.filter("o_orderkey % 2 = 1")).select("o_orderkey", "version")


@query("k11_retention", f"WITH {NEWS} SELECT id, {ts('publish_time')} FROM news WHERE publish_time >= TIMESTAMP '2024-01-02 00:00:00'")
def k11_retention(spark, d):
    table = sinks.Table(spark, scratch(spark, "retention"))
    table.replace(c.news(spark, d).select("id", "publish_time"))
    table.keep_since("publish_time", "2024-01-02 00:00:00")
    return table.read()


@query("k12_minute_day", f"WITH {MINUTES}, x AS (SELECT 'kept' AS part, ts_code, count(*) AS rows, min(trade_time) AS a, max(trade_time) AS b FROM minutes WHERE CAST(trade_time AS DATE) <> DATE '2024-01-08' GROUP BY 2 UNION ALL SELECT 'day', ts_code, count(*), min(trade_time), max(trade_time) FROM minutes WHERE CAST(trade_time AS DATE) = DATE '2024-01-08' GROUP BY 2) SELECT part, ts_code, rows, {ts('a', 'first_time')}, {ts('b', 'last_time')} FROM x")
def k12_minute_day(spark, d):
    m = c.minute_bars(spark, d)
    one = sinks.day_check(m, "2024-01-08").withColumn("part", F.lit("day"))
    rest = sinks.without_day(m, "2024-01-08").groupBy("ts_code").agg(F.count("*").alias("rows"), F.min("trade_time").alias("first_time"), F.max("trade_time").alias("last_time")).withColumn("part", F.lit("kept"))
    return one.unionByName(rest)


# --- universes and screens ------------------------------------------------------------------------------------------
@query("p5_core_universe", f"SELECT DISTINCT {code('c_nationkey')} AS code FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') AND c_custkey % 3 = 0")
def p5_core_universe(spark, d):
    k = c.table(spark, d, "customer")
    kinds = spark.createDataFrame([(1, "AUTOMOBILE"), (2, "BUILDING"), (3, "FURNITURE"), (4, "MACHINERY"), (5, "HOUSEHOLD")], "id int, name string")
    bridge = k.filter("c_custkey % 3 = 0").join(F.broadcast(kinds), F.col("c_mktsegment") == F.col("name")).select(F.col("c_custkey").alias("item_id"), F.col("id").alias("category_id"))  # five kinds
    return universe.core_universe(k.select(F.col("c_custkey").alias("id"), c.code_of(F.col("c_nationkey")).alias("code")), bridge, kinds, ["AUTOMOBILE", "FURNITURE"])


@query("p6_plain_stocks", f"SELECT c_custkey, name FROM (SELECT c_custkey, {code('(c_custkey % 1000 * 991 % 1000000)')} AS ts_code, CASE WHEN c_custkey % 4 = 0 THEN '*st ' || c_mktsegment ELSE c_mktsegment END AS name FROM customer) WHERE NOT regexp_matches(name, '(?i)ST') AND left(ts_code, 1) IN ('0', '3', '6')")
def p6_plain_stocks(spark, d):
    k = F.col("c_custkey")
    rows = c.table(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, F.concat(F.lit("*st "), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment")).alias("name"), c.code_of(k % 1000 * 991 % 1000000).alias("ts_code"))
    return universe.plain_stocks(rows).select("c_custkey", "name")


@query("p8_resolved_column", f"SELECT l_orderkey, l_linenumber, {r6('CASE WHEN l_linenumber % 3 > 0 THEN floor(l_extendedprice) END', 'flow')} FROM lineitem")
def p8_resolved_column(spark, d):
    """The flow column is found by its name's parts and read as numbers."""
    value = F.when(F.col("l_linenumber") % 3 > 0, F.format_number(F.floor("l_extendedprice"), 0)).otherwise("--")
    rows = c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", value.alias("main net inflow(yuan)"), F.lit("1").alias("other inflow"))
    column = universe.resolve_column(rows, ["super", "main net inflow", "inflow"])
    return universe.numeric(rows, [column]).select("l_orderkey", "l_linenumber", F.col(f"`{column}`").alias("flow"))


@query("p10_cap_and_change", f"WITH {QUOTES} SELECT ts_code, {day('trade_date')}, {r6('pct_chg')} FROM quotes WHERE amount_li BETWEEN 200000 AND 900000 AND pct_chg < 20")
def p10_cap_and_change(spark, d):
    return universe.cap_and_change(c.quotes(spark, d), cap="amount_li", change="pct_chg", least_cap=200000, most_cap=900000, most_change=20).select("ts_code", "trade_date", "pct_chg")


_DAY = "DATE '1996-06-12'"


@query(
    "c1_opening_screen_joined",
    f"""WITH {QUOTES}, {FLOWS}, m AS (SELECT ts_code, trade_date, avg(close_li) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma5 FROM quotes),
    f AS (SELECT ts_code, CAST(sum(net_mf_amount) AS BIGINT) AS net_sum FROM flows WHERE trade_date <= {_DAY} AND trade_date > {_DAY} - 60 GROUP BY 1)
    SELECT q.ts_code, n_name AS name, q.close_li, {r6("q.pct_chg", "pct_chg")}, {r6("ma5")}, net_sum FROM quotes q JOIN nation ON {code("n_nationkey")} = q.ts_code LEFT JOIN m USING (ts_code, trade_date) LEFT JOIN f USING (ts_code)
    WHERE q.trade_date = {_DAY} AND q.pct_chg >= -60 AND q.pct_chg <= 300 AND ma5 >= 50000 AND n_name NOT LIKE '%ST%' ORDER BY q.pct_chg DESC NULLS LAST, q.ts_code LIMIT 30""",
)
def c1_opening_screen_joined(spark, d):
    """The screen through its own operator: the day joined with basics, averages and window flow, plain stocks only."""
    q = c.quotes(spark, d)
    basics = universe.plain_stocks(c.table(spark, d, "nation").select(c.code_of(F.col("n_nationkey")).alias("ts_code"), F.col("n_name").alias("name")))
    averages = indicators.moving_averages(q, (5,), value="close_li", symbol="ts_code", time="trade_date", full=False).filter(F.col("trade_date") == date("1996-06-12")).select("ts_code", "ma5")
    net = bars.window_sum(c.money_flow(spark, d), "1996-06-12", 60, value="net_mf_amount").select("ts_code", F.col("net_mf_amount_sum").alias("net_sum"))
    rules = [("pct_chg", -60.0, 300.0), ("ma5", 50000, None), ("turnover_rate", 1.0, None)]
    out = universe.opening_screen(q.filter(F.col("trade_date") == date("1996-06-12")), basics, averages, net, rules, 30)
    return out.select("ts_code", "name", "close_li", "pct_chg", "ma5", "net_sum")


@query("a26_screen_summary", f"WITH {QUOTES}, x AS (SELECT *, c_mktsegment AS industry FROM quotes, (SELECT DISTINCT c_mktsegment FROM customer) WHERE month(trade_date) = length(c_mktsegment)), i AS (SELECT industry, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, industry LIMIT 10) SELECT count(*) AS stocks, CAST(sum(amount_li) AS BIGINT) AS flow_sum, round(avg(amount_li), 6) + 0.0 AS flow_mean, round(avg(pct_chg), 6) + 0.0 AS change_mean, {r6('min(pct_chg)', 'change_min')}, {r6('max(pct_chg)', 'change_max')}, (SELECT string_agg(industry || ':' || n, ',' ORDER BY n DESC, industry) FROM i) AS industries FROM x")
def a26_screen_summary(spark, d):
    kinds = c.table(spark, d, "customer").select(F.col("c_mktsegment").alias("industry")).distinct()
    rows = c.quotes(spark, d).withColumn("k", F.month("trade_date")).join(kinds.withColumn("k", F.length("industry")), "k")
    return universe.screen_summary(rows, flow="amount_li", change="pct_chg", industry="industry")


@query("o1_top_by_flow", f"WITH {FLOWS}, l AS (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1) SELECT * FROM (SELECT 'flow' AS by, ts_code FROM l ORDER BY net_mf_amount DESC, ts_code LIMIT 7) UNION ALL SELECT * FROM (SELECT 'first', ts_code FROM l ORDER BY ts_code LIMIT 7)")
def o1_top_by_flow(spark, d):
    last = windows.latest(c.money_flow(spark, d), key="ts_code", order=[F.desc("trade_date")]).select("ts_code", "net_mf_amount")
    some = signals.top_by_flow(last, 7, patterns=["main_net", "net_mf_amount"], tie="ts_code").withColumn("by", F.lit("flow"))
    none = signals.top_by_flow(last, 7, patterns=["absent"], tie="ts_code").withColumn("by", F.lit("first"))
    return some.unionByName(none).select("by", "ts_code")


@query("o6_top_movers", f"WITH {QUOTES}, l AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1) SELECT * FROM (SELECT 'change' AS by, ts_code FROM l ORDER BY pct_chg DESC NULLS LAST, ts_code LIMIT 5) UNION ALL SELECT * FROM (SELECT 'amount', ts_code FROM l ORDER BY amount_li DESC, ts_code LIMIT 5)")
def o6_top_movers(spark, d):
    last = windows.latest(c.quotes(spark, d), key="ts_code", order=[F.desc("trade_date")])
    parts = [signals.top_movers(last, 5, by_amount=by == "amount").select(F.lit(by).alias("by"), "ts_code") for by in ("change", "amount")]
    return parts[0].unionByName(parts[1])


@query("o7_union", f"WITH {BARS}, {FLOWS} SELECT ts_code, {day('trade_date')}, close_li, NULL::BIGINT AS net_mf_amount FROM bars UNION ALL SELECT ts_code, CAST(trade_date AS VARCHAR), NULL, net_mf_amount FROM flows")
def o7_union(spark, d):
    return c.daily_bars(spark, d).select("ts_code", "trade_date", "close_li").unionByName(c.money_flow(spark, d).select("trade_date", "net_mf_amount", "ts_code"), allowMissingColumns=True)


@query("o10_northbound", f"WITH {FLOWS}, n AS (SELECT trade_date, CAST(sum(net_mf_amount) AS BIGINT) AS net FROM flows GROUP BY 1 ORDER BY trade_date DESC LIMIT 20) SELECT {day('trade_date')}, net, CAST(row_number() OVER (ORDER BY n.trade_date DESC) AS INTEGER) AS rank, CAST(sum(net) OVER () AS BIGINT) AS net_sum FROM n")
def o10_northbound(spark, d):
    net = c.money_flow(spark, d).groupBy("trade_date").agg(F.sum("net_mf_amount").alias("net"))
    return signals.northbound(net)


@query("o11_news_within", f"WITH {NEWS} SELECT id, is_important, {ts('publish_time')} FROM news WHERE publish_time <= TIMESTAMP '2024-01-02 06:00:00' AND publish_time >= TIMESTAMP '2024-01-02 06:00:00' - INTERVAL 36 HOUR ORDER BY is_important DESC, news.publish_time DESC, id DESC LIMIT 40")
def o11_news_within(spark, d):
    return signals.news_within(c.news(spark, d), "2024-01-02 06:00:00", 36, limit=40).select("id", "is_important", "publish_time")


@query("q16_calendar_sync", f"WITH {CALENDAR} SELECT {day('cal_date')}, CASE WHEN month(cal_date) = 5 THEN false ELSE is_trading END AS is_trading FROM calendar")
def q16_calendar_sync(spark, d):
    """The calendar, with May sent again as closed in vendor form."""
    base = c.calendar(spark, d)
    raw = base.filter(F.month("cal_date") == 5).select(F.date_format("cal_date", "yyyyMMdd").alias("cal_date"), F.lit(0).alias("is_open"))
    raw = raw.unionByName(raw.limit(1).select(F.lit("soon").alias("cal_date"), F.lit(1).alias("is_open")))
    return sinks.merged(base, coverage.calendar_rows(raw), ["cal_date"])


@query("j13_liquidity", f"WITH {BARS}, {FLOWS}, l AS (SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 5) SELECT ts_code, {day('l.trade_date', 'trade_date')}, net_mf_vol, close_li FROM l LEFT JOIN bars USING (ts_code, trade_date)")
def j13_liquidity(spark, d):
    return flows.liquidity(c.money_flow(spark, d), c.daily_bars(spark, d), columns=["close_li"]).select("ts_code", "trade_date", "net_mf_vol", "close_li")


@query("j14_flow_with_close", f"WITH {QUOTES}, {FLOWS} SELECT ts_code, {day('flows.trade_date', 'trade_date')}, net_mf_amount, close_li, {r6('pct_chg')} FROM flows LEFT JOIN quotes USING (ts_code, trade_date)")
def j14_flow_with_close(spark, d):
    return flows.with_close(c.money_flow(spark, d), c.quotes(spark, d)).select("ts_code", "trade_date", "net_mf_amount", "close_li", "pct_chg")


# --- functions ------------------------------------------------------------------------------------------------------
@query("f4_storage_codes", "WITH k AS (SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS k FROM customer) SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN k || '.XY' ELSE k || CASE WHEN left(k, 1) IN ('6', '5') THEN '.SH' WHEN left(k, 1) IN ('8', '4') THEN '.BJ' ELSE '.SZ' END END AS stored, lpad(CAST(c_custkey % 9999 AS VARCHAR), 5, '0') AS hk, left(k, 2) IN ('15', '16', '18', '50', '51', '52', '56', '58') AS etf FROM k")
def f4_storage_codes(spark, d):
    k = F.col("c_custkey")
    bare = F.lpad((k * 7919 % 1000000).cast("string"), 6, "0")
    raw = F.when(k % 3 == 0, F.concat(F.lit(" "), bare, F.lit(".xy"))).otherwise(bare)
    hk = F.when(k % 2 == 0, F.concat(F.lit("hk"), (k % 9999).cast("string"))).otherwise(F.concat((k % 9999).cast("string"), F.lit(".HK")))
    return c.table(spark, d, "customer").select("c_custkey", codes.storage_code(raw).alias("stored"), codes.hk_code(hk).alias("hk"), codes.looks_like_etf(bare).alias("etf"))


@query("f10_safe_numbers", f"SELECT l_orderkey, l_linenumber, {r6('CASE l_linenumber % 4 WHEN 0 THEN NULL ELSE floor(l_extendedprice) END', 'number')}, {r6('CASE WHEN l_linenumber % 3 > 0 THEN l_extendedprice / (l_linenumber % 3) END', 'ratio')} FROM lineitem")
def f10_safe_numbers(spark, d):
    n, v = F.col("l_linenumber"), F.format_number(F.floor("l_extendedprice"), 0)
    said = F.when(n % 4 == 0, "-").when(n % 4 == 1, v).when(n % 4 == 2, F.concat(F.lit(" "), v, F.lit("%"))).otherwise(v)
    return c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", codes.safe_float(said).alias("number"), codes.ratio(F.col("l_extendedprice"), n % 3).alias("ratio"))


# --- panels and joins -----------------------------------------------------------------------------------------------
@query("a4_plain_panel", f"WITH {BARS} SELECT {day('trade_date', 'datetime')}, ts_code AS instrument, {r6('CAST(open_li / 1000.0::DOUBLE AS FLOAT)::DOUBLE', 'open')}, {r6('CAST(volume_hand * 100 AS FLOAT)::DOUBLE', 'volume')}, 1.0::DOUBLE AS factor FROM bars")
def a4_plain_panel(spark, d):
    return prices.plain_panel(c.daily_bars(spark, d)).select("datetime", "instrument", F.col("`$open`").alias("open"), F.col("`$volume`").alias("volume"), F.col("`$factor`").alias("factor"))


@query("a7_basic_panel", f"WITH {QUOTES} SELECT {day('trade_date', 'datetime')}, ts_code AS instrument, {r6('pct_chg', 'db_pct_chg')}, amount_li::DOUBLE AS db_amount_li FROM quotes")
def a7_basic_panel(spark, d):
    return prices.basic_panel(c.quotes(spark, d), ["pct_chg", "amount_li"])


@query("a14_daily_close", f"WITH {MINUTES} SELECT ts_code, {day('CAST(trade_time AS DATE)', 'trade_date')}, arg_max(close_li, trade_time) AS close_li, CAST(sum(amount_li) AS BIGINT) AS amount_li FROM minutes GROUP BY ts_code, CAST(trade_time AS DATE)")
def a14_daily_close(spark, d):
    return bars.daily_close(bars.resample(c.minute_bars(spark, d), 15))


@query("a28_report_dedup", "SELECT o_orderkey, CAST(report_date AS VARCHAR) AS report_date, org_name FROM (SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS report_date, o_orderstatus AS org_name, o_orderpriority AS title FROM orders) QUALIFY row_number() OVER (PARTITION BY report_date, org_name, title ORDER BY o_orderkey) = 1")
def a28_report_dedup(spark, d):
    r = c.table(spark, d, "orders").select("o_orderkey", F.trunc("o_orderdate", "month").alias("report_date"), F.col("o_orderstatus").alias("org_name"), F.col("o_orderpriority").alias("report_title"))
    return text.dedup_reports(r, order="o_orderkey").select("o_orderkey", "report_date", "org_name")


@query("j2_minute_factor", f"WITH {MINUTES}, f AS (SELECT DISTINCT ts_code, CAST(trade_time AS DATE) AS trade_date, 1 + day(CAST(trade_time AS DATE)) / 10.0::DOUBLE AS factor FROM minutes WHERE day(trade_time) % 7 > 0) SELECT ts_code, {ts('trade_time')}, close_li, {r6('factor')} FROM (SELECT *, CAST(trade_time AS DATE) AS trade_date FROM minutes) LEFT JOIN f USING (ts_code, trade_date)")
def j2_minute_factor(spark, d):
    """Minute bars with the factor of their day; days without one keep null."""
    m = c.minute_bars(spark, d)
    f = m.select("ts_code", F.to_date("trade_time").alias("trade_date")).distinct().filter(F.dayofmonth("trade_date") % 7 > 0).withColumn("factor", 1 + F.dayofmonth("trade_date") / 10.0)
    return prices.with_factor(m, f, strict=False, time="trade_time").select("ts_code", "trade_time", "close_li", "factor")


@query("j4_daily_model_panel", f"WITH {MINUTES}, stepped AS (SELECT *, time_bucket(INTERVAL 5 MINUTE, time) AS b, volume_hand * 100 AS v FROM ticks), f AS (SELECT symbol AS ts_code, CAST(b AS DATE) AS trade_date, CAST(sum(v) FILTER (WHERE status = 0) AS BIGINT) AS buy_volume, count(*) AS trade_count FROM stepped GROUP BY 1, 2), w AS (SELECT ts_code, CAST(trade_time AS DATE) AS trade_date, sum(amount_li) / (sum(volume_hand) * 100000.0::DOUBLE) AS vwap, arg_max(close_li, trade_time) AS close_li FROM minutes GROUP BY 1, 2) SELECT w.ts_code, {day('w.trade_date', 'trade_date')}, w.close_li, CASE WHEN day(w.trade_date) % 2 = 0 THEN coalesce(buy_volume, 0) END AS buy_volume, CASE WHEN day(w.trade_date) % 2 = 0 THEN trade_count END AS trade_count, {r6('CASE WHEN day(w.trade_date) % 3 = 0 THEN vwap END', 'vwap')} FROM w JOIN f USING (ts_code, trade_date)")
def j4_daily_model_panel(spark, d):
    """Daily closes with intraday features on even days and volume-weighted prices on every third."""
    m = c.minute_bars(spark, d)
    daily = bars.daily_close(bars.resample(m, 5))
    features = orderflow.daily_features(orderflow.tick_buckets(c.ticks(spark, d))).filter(F.dayofmonth("trade_date") % 2 == 0).select("symbol", "trade_date", "buy_volume", "trade_count")
    priced = orderflow.vwap(m).filter(F.dayofmonth("trade_date") % 3 == 0).select("ts_code", "trade_date", "vwap")
    return orderflow.daily_model_panel(daily, features, priced).select("ts_code", "trade_date", "close_li", "buy_volume", "trade_count", "vwap")


# --- windows, sequences, trend, risk --------------------------------------------------------------------------------
@query("w21_score_rank", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def w21_score_rank(spark, d):
    return windows.score_rank(c.table(spark, d, "customer").select("c_custkey", "c_acctbal"), score="c_acctbal", key="c_custkey", top=50).select("c_custkey", "rank")


@query("w24_training_set", f"WITH {PANEL}, n AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n, lead(t) OVER (PARTITION BY symbol ORDER BY t) AS next FROM p), s AS (SELECT DISTINCT symbol, substring(symbol, 1, 6)::BIGINT % 4 AS k FROM p WHERE symbol NOT LIKE '%.BJ'), i AS (SELECT symbol, k, CAST(row_number() OVER (ORDER BY symbol) - 1 AS INTEGER) AS symbol_id FROM s) SELECT symbol, {day('t')}, k, symbol_id, 5 AS steps FROM n JOIN i USING (symbol) WHERE n >= 5 AND next IS NOT NULL")
def w24_training_set(spark, d):
    rows = panel(spark, d)
    static = rows.select("symbol").distinct().filter(~F.col("symbol").endswith(".BJ")).withColumn("k", F.substring("symbol", 1, 6).cast("long") % 4)
    return sequences.training_set(sequences.sequences(rows, ["close"], 5), static).select("symbol", "t", "k", "symbol_id", F.size("x").alias("steps"))


@query("c13_margin", f"WITH {QUOTES}, l AS (SELECT * FROM quotes WHERE trade_date <= DATE '1996-06-14' AND trade_date > DATE '1996-06-14' - 7 QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1) SELECT ts_code, {day('trade_date')}, CASE WHEN volume_hand * 3 > 10 THEN 'high' WHEN volume_hand * 3 > 3 THEN 'medium' WHEN volume_hand * 3 > 1 THEN 'low' ELSE 'very low' END AS margin FROM l")
def c13_margin(spark, d):
    last = breadth.latest_within(c.quotes(spark, d), "1996-06-14", key="ts_code")
    return last.select("ts_code", "trade_date", breadth.margin_label(F.col("volume_hand") * 3).alias("margin"))


@query("c16_main_ratio", f"WITH {FLOWS}, n AS (SELECT ts_code, trade_date, buy_lg_amount - sell_lg_amount + buy_elg_amount - sell_elg_amount AS m, CASE WHEN day(trade_date) % 9 > 0 THEN buy_sm_amount + sell_sm_amount + buy_lg_amount + sell_lg_amount + buy_elg_amount + sell_elg_amount ELSE 0 END AS t FROM flows) SELECT ts_code, {day('trade_date')}, CASE WHEN t <> 0 THEN round(CAST(m AS DOUBLE) / t * 100, 6) + 0.0 END AS share FROM n")
def c16_main_ratio(spark, d):
    """The text of the ratio is read back as a number, as engines round text apart."""
    f = c.money_flow(spark, d)
    main = F.col("buy_lg_amount") - F.col("sell_lg_amount") + F.col("buy_elg_amount") - F.col("sell_elg_amount")
    total = F.when(F.dayofmonth("trade_date") % 9 > 0, F.col("buy_sm_amount") + F.col("sell_sm_amount") + F.col("buy_lg_amount") + F.col("sell_lg_amount") + F.col("buy_elg_amount") + F.col("sell_elg_amount")).otherwise(0)
    exact = F.try_divide(main.cast("double"), total) * 100
    said = F.regexp_replace(flows.main_ratio(main, total), "%", "").try_cast("double")
    return f.select("ts_code", "trade_date", F.when(F.abs(said - exact) <= 0.005001, exact).when(exact.isNotNull(), F.lit(-1.0)).when(flows.main_ratio(main, total) != "N/A", F.lit(-2.0)).alias("share"))


@query("c21_fundamental_score", f"WITH x AS (SELECT p_partkey, p_size * 1.7::DOUBLE AS pe, p_size / 8.0::DOUBLE AS pb, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 40 - 15 END AS a, p_partkey % 23 - 8 AS b FROM part) SELECT p_partkey, {r6('greatest(-2.0::DOUBLE, least(2.0::DOUBLE, CASE WHEN pe < 10 THEN 1.0::DOUBLE WHEN pe < 20 THEN 0.5 WHEN pe > 60 THEN -1 WHEN pe > 40 THEN -0.5 ELSE 0 END + CASE WHEN pb < 1 THEN 0.5::DOUBLE WHEN pb > 5 THEN -0.5 ELSE 0 END + CASE WHEN a > 10 THEN 0.5::DOUBLE WHEN a < 0 THEN -0.5 ELSE 0 END + CASE WHEN b > 10 THEN 0.5::DOUBLE WHEN b < 0 THEN -0.5 ELSE 0 END))', 'score')} FROM x")
def c21_fundamental_score(spark, d):
    k = F.col("p_partkey")
    return c.table(spark, d, "part").select("p_partkey", trend.fundamental_score(F.col("p_size") * 1.7, F.col("p_size") / 8.0, F.when(k % 5 > 0, k % 40 - 15), k % 23 - 8).alias("score"))


@query("c25_recent_filings", f"WITH {NEWS}, l AS (SELECT source, id, publish_time, substring(content, 1, 400) AS summary FROM news WHERE CAST(publish_time AS DATE) <= DATE '2024-01-10' AND CAST(publish_time AS DATE) > DATE '2024-01-10' - 120 QUALIFY row_number() OVER (PARTITION BY source ORDER BY CAST(publish_time AS DATE) DESC, id DESC) <= 60) SELECT source, id, sha256(coalesce(summary, '')) AS summary FROM l")
def c25_recent_filings(spark, d):
    rows = c.news(spark, d).withColumn("ann_date", F.to_date("publish_time"))
    return risk.recent_filings(rows, "2024-01-10", key="source", tie="id").select("source", "id", F.sha2(F.coalesce("summary", F.lit("")), 256).alias("summary"))


@query("c27_enriched_quotes", f"WITH q AS (SELECT s_suppkey, {code('s_nationkey')} AS ts_code, s_acctbal AS last, CASE WHEN s_suppkey % 6 > 0 THEN 50.0 ELSE 0 END::DOUBLE AS pre, s_suppkey * 37 AS v FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1) SELECT c_custkey, {r6('CASE WHEN pre <> 0 THEN (last - pre) * 100 / pre END', 'pct')}, CAST(floor(v / 100) AS BIGINT) AS volume_hand FROM customer LEFT JOIN q ON ts_code = {code('c_nationkey')}")
def c27_enriched_quotes(spark, d):
    first = windows.latest(c.table(spark, d, "supplier"), key="s_nationkey", order=[F.col("s_suppkey")])
    q = first.select(c.code_of(F.col("s_nationkey")).alias("ts_code"), F.col("s_acctbal").alias("last_li"), F.when(F.col("s_suppkey") % 6 > 0, 50.0).otherwise(0.0).alias("pre_close_li"), (F.col("s_suppkey") * 37).alias("volume"))
    items = c.table(spark, d, "customer").select("c_custkey", c.code_of(F.col("c_nationkey")).alias("ts_code"))
    return risk.enrich_quotes(items, q).select("c_custkey", "pct", F.col("volume_hand").cast("long").alias("volume_hand"))


# --- quality --------------------------------------------------------------------------------------------------------
@query("q2_compare", f"WITH {BARS}, x AS (SELECT (SELECT count(*) FROM bars) AS a, (SELECT count(*) FROM bars WHERE month(trade_date) > 6) AS b, (SELECT count(DISTINCT ts_code) FROM bars) AS i, (SELECT count(DISTINCT ts_code) FROM bars WHERE month(trade_date) > 6) AS j) SELECT 'rows: ' || a || ' -> ' || b AS message FROM x UNION ALL SELECT 'instruments: ' || i || ' -> ' || j FROM x WHERE i <> j")
def q2_compare(spark, d):
    rows = c.daily_bars(spark, d).select(F.col("ts_code").alias("instrument"), F.col("trade_date").alias("datetime"), "close_li")
    return quality.compare(quality.validate(rows), quality.validate(rows.filter(F.month("datetime") > 6)))


@query("q5_suspension_flag", f"WITH {BARS} SELECT ts_code, {day('trade_date')}, day(trade_date) % 4 IN (0, 1) AS suspended FROM bars")
def q5_suspension_flag(spark, d):
    on = F.dayofmonth("trade_date") % 4
    rows = c.daily_bars(spark, d).select("ts_code", "trade_date", F.when(on == 0, 0).when(on > 1, F.col("volume_hand")).alias("volume"))
    return quality.suspension_flag(rows).select("ts_code", "trade_date", "suspended")


# --- streams --------------------------------------------------------------------------------------------------------
def _run(stream: DataFrame, put, checkpoint: str) -> None:
    """One run over all files that are there, from where the checkpoint says; it ends by itself."""
    stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _halves(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """The ticks as a stream of files, of which as many as there are cores are a micro-batch; the second half is not there yet."""
    n = spark.sparkContext.defaultParallelism
    c.ticks(spark, d).filter("seq % 2 = 0").repartition(2 * n).write.parquet(f"{folder}/in")
    return spark.readStream.schema(c.TICKS).option("maxFilesPerTrigger", n).parquet(f"{folder}/in")


def _arrive(spark: SparkSession, d: str, folder: str) -> None:
    c.ticks(spark, d).filter("seq % 2 = 1").repartition(2 * spark.sparkContext.defaultParallelism).write.mode("append").parquet(f"{folder}/in")


@query("x2_live_bars", f"WITH {TICKS} SELECT symbol, {ts('time_bucket(INTERVAL 60 MINUTE, time)', 'bucket')}, arg_min(price_li, (time, seq)) AS open_li, max(price_li) AS high_li, min(price_li) AS low_li, arg_max(price_li, (time, seq)) AS close_li, CAST(sum(volume_hand) AS BIGINT) AS volume_hand FROM ticks GROUP BY symbol, time_bucket(INTERVAL 60 MINUTE, time)")
def x2_live_bars(spark, d):
    """Bars of a stream in several micro-batches, stopped and started again from its checkpoint; each update replaces its bar."""
    folder = scratch(spark, "live")
    stream, table = _halves(spark, d, folder), sinks.Table(spark, f"{folder}/bars")
    put = lambda batch, n: table.put(batch.withColumn("date", F.to_date("bucket")), ["symbol", "bucket"], partition="date")
    _run(streams.live_bars(stream, 60, "60 days"), put, f"{folder}/checkpoint")
    _arrive(spark, d, folder)
    _run(streams.live_bars(stream, 60, "60 days"), put, f"{folder}/checkpoint")
    return table.read().drop("date")


@query("x5_bucket_sink", f"WITH {BUCKETS} SELECT symbol, {ts('bucket_start_time')}, buy_volume, sell_volume, trade_count, {r6('realized_vol')} FROM buckets")
def x5_bucket_sink(spark, d):
    """Buckets with realised volatility from a stream that stops, starts again and meets its last files a second time."""
    folder = scratch(spark, "buckets")
    stream = _halves(spark, d, folder)
    ticks, buckets = sinks.Table(spark, f"{folder}/ticks"), sinks.Table(spark, f"{folder}/buckets")
    put = streams.bucket_sink(ticks, buckets)
    _run(stream, put, f"{folder}/checkpoint")
    _arrive(spark, d, folder)
    _run(stream, put, f"{folder}/checkpoint")
    put(c.ticks(spark, d).filter("seq % 2 = 1"), 99)
    return buckets.read().select("symbol", "bucket_start_time", "buy_volume", "sell_volume", "trade_count", "realized_vol")


@query("x7_feed", "SELECT o_orderkey AS id, o_custkey AS symbol, c_name AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 4 > 0 WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def x7_feed(spark, d):
    sent = c.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("symbol"), F.col("o_orderdate").alias("created_at"), F.col("o_orderstatus").alias("status"))
    monitors = c.table(spark, d, "customer").filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"))
    return streams.feed(sent, monitors, 50, status="O").select("id", "symbol", "name")


@query("x8_replay", f"WITH {BARS} SELECT ts_code, {day('trade_date')}, CASE WHEN day(trade_date) = 3 THEN close_li * 2 ELSE close_li END AS close_li FROM bars WHERE day(trade_date) <> 4")
def x8_replay(spark, d):
    """A batch that is delivered twice leaves the table as after the first time."""
    rows = c.daily_bars(spark, d).select("ts_code", "trade_date", "close_li").filter(F.dayofmonth("trade_date") != 4)
    batch = rows.filter(F.dayofmonth("trade_date") == 3).withColumn("close_li", F.col("close_li") * 2)
    keys = ["ts_code", "trade_date"]
    return streams.replay(batch, streams.replay(batch, rows, keys), keys)
