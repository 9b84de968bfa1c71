"""Registered queries over the warehouse tables, each with its SQL twin where SQL has the words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..operators import bars, billboard, indicators, orderflow, prices, sequences, windows
from ..sources import contracts as c
from ..sources import scans

from .sql import BARS, BUCKETS, FACTORS, FLOWS, MINUTES, QUOTES, RECORDS, code, day, r6, ts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Dates and times as text, numbers rounded to six places: what two engines can be compared by."""
    out = []
    for f in df.schema.fields:
        kind, col = f.dataType.typeName(), F.col(f"`{f.name}`")
        if kind == "date":
            col = col.cast("string")
        elif kind in ("timestamp", "timestamp_ntz"):
            col = F.date_format(col, "yyyy-MM-dd HH:mm:ss")
        elif kind in ("double", "float"):
            col = F.round(col.cast("double"), 6) + 0.0
        out.append(col.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Daily bars in yuan under model names."""
    li = lambda k: (F.col(f"{k}_li") / 1000.0).alias(k)
    return c.daily_bars(spark, d).select(F.col("ts_code").alias("symbol"), F.col("trade_date").alias("t"), li("open"), li("high"), li("low"), li("close"), F.col("volume_hand").alias("volume"), F.col("amount_li").alias("amount"))


PANEL = f"""{BARS}, p AS (SELECT ts_code AS symbol, trade_date AS t, open_li / 1000.0::DOUBLE AS open, high_li / 1000.0::DOUBLE AS high, low_li / 1000.0::DOUBLE AS low,
    close_li / 1000.0::DOUBLE AS close, volume_hand AS volume, amount_li AS amount FROM bars)"""
OHLC = ("open_li", "high_li", "low_li", "close_li")


def screen_base(spark: SparkSession, d: str) -> DataFrame:
    rows = c.quotes(spark, d)
    rows = indicators.moving_averages(rows, (20,), value="close_li", symbol="ts_code", time="trade_date", full=False)
    return rows


# --- the first slice and prices -------------------------------------------------------------------------------------
@query(
    "slice_daily_screen",
    f"""WITH {QUOTES}, m AS (SELECT *, avg(close_li) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20 FROM quotes)
    SELECT ts_code, {day("trade_date")}, close_li, {r6("pct_chg")}, {r6("ma20")} FROM m WHERE close_li > ma20 AND pct_chg > 0 ORDER BY m.pct_chg DESC, m.ts_code, m.trade_date LIMIT 100""",
)
def slice_daily_screen(spark, d):
    rows = screen_base(spark, d).filter((F.col("close_li") > F.col("ma20")) & (F.col("pct_chg") > 0))
    return rows.orderBy(F.desc("pct_chg"), "ts_code", "trade_date").limit(100).select("ts_code", "trade_date", "close_li", "pct_chg", "ma20")


@query("s1_daily_scan", f"WITH {BARS} SELECT ts_code, {day('trade_date')}, {', '.join(OHLC)}, volume_hand, amount_li FROM bars WHERE ts_code IN ({code('1')}, {code('2')}) AND trade_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def s1_daily_scan(spark, d):
    return scans.codes_and_dates(c.daily_bars(spark, d), ["000001.SH", "000002.BJ"], "1995-01-01", "1996-12-31")


@query("s2_minute_scan", f"WITH {MINUTES} SELECT ts_code, {ts('trade_time')}, freq, {', '.join(OHLC)}, volume_hand, amount_li FROM minutes WHERE CAST(trade_time AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def s2_minute_scan(spark, d):
    return scans.minute_scan(c.minute_bars(spark, d), None, "2024-01-05", "2024-01-12", "1m")


@query("s8_distinct_codes", f"WITH {BARS} SELECT DISTINCT ts_code FROM bars")
def s8_distinct_codes(spark, d):
    return scans.distinct_values(c.daily_bars(spark, d), "ts_code")


@query("s9_minute_span", f"WITH {MINUTES} SELECT count(*) AS rows, {day('min(CAST(trade_time AS DATE))', 'first_day')}, {day('max(CAST(trade_time AS DATE))', 'last_day')} FROM minutes")
def s9_minute_span(spark, d):
    return scans.span(c.minute_bars(spark, d), time="trade_time")


@query(
    "s10_land_daily",
    f"""SELECT {code("(o_custkey % 25)")} AS ts_code, {day("CAST(o_orderdate AS DATE)", "trade_date")}, CAST(round(floor(o_totalprice) * 1000) AS INTEGER) AS open_li, CAST(round(floor(o_totalprice) * 1000) AS INTEGER) AS close_li
    FROM orders WHERE o_orderkey % 3 < 2 AND o_totalprice < 200000""",
)
def s10_land_daily(spark, d):
    price = F.floor("o_totalprice").cast("string")
    day_text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("none")
    raw = c.table(spark, d, "orders").filter(F.col("o_totalprice") < 200000).select(c.code_of(F.col("o_custkey") % 25).alias("code"), day_text.alias("date"), F.lit(" ").alias("Last"), price.alias("open"), price.alias("close"))
    fields = [scans.Field("ts_code", ("ts_code", "code"), "string"), scans.Field("trade_date", ("date",), "date"), scans.Field("open_li", ("open",), "int", 1000), scans.Field("close_li", ("Last", "close"), "int", 1000)]
    return scans.land(raw, fields, ["ts_code", "trade_date", "close_li"])


@query("s17_latest_cross_section", f"WITH {QUOTES} SELECT ts_code, {day('trade_date')}, close_li FROM quotes WHERE trade_date = (SELECT max(trade_date) FROM quotes)")
def s17_latest_cross_section(spark, d):
    return scans.cross_section(c.quotes(spark, d), time="trade_date").select("ts_code", "trade_date", "close_li")


@query("s18_billboard_scan", f"WITH {RECORDS} SELECT {day('date')}, stock_code, youzi_name, net_inflow FROM records WHERE isodow(date) < 6 AND date BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'")
def s18_billboard_scan(spark, d):
    return billboard.scan(c.billboard(spark, d), "1995-03-01", "1995-03-31").select("date", "stock_code", "youzi_name", "net_inflow")


@query("a1_forward_factor", f"WITH {FACTORS} SELECT ts_code, {day('trade_date')}, {r6('adj_factor / max(adj_factor) OVER (PARTITION BY ts_code)', 'by_max')}, {r6('adj_factor / arg_max(adj_factor, trade_date) OVER (PARTITION BY ts_code)', 'by_latest')} FROM factors")
def a1_forward_factor(spark, d):
    f = prices.forward_factor(c.adj_factor(spark, d), out="by_max")
    return prices.forward_factor(f, base="latest", out="by_latest").drop("adj_factor")


@query("a2_latest_factor", f"WITH {FACTORS} SELECT ts_code, {r6('arg_max(adj_factor, trade_date)', 'adj_factor')}, {day('max(trade_date)', 'trade_date')} FROM factors GROUP BY ts_code")
def a2_latest_factor(spark, d):
    return prices.latest_factor(c.adj_factor(spark, d))


_F32 = lambda x, name: r6(f"CAST({x} AS FLOAT)::DOUBLE", name)


@query(
    "a3_adjusted_panel",
    f"""WITH {FACTORS}, f AS (SELECT ts_code, trade_date, adj_factor / max(adj_factor) OVER (PARTITION BY ts_code) AS factor FROM factors)
    SELECT {day("trade_date", "datetime")}, ts_code AS instrument, {", ".join(_F32(f"{k}_li / 1000.0::DOUBLE * factor", k) for k in ("open", "high", "low", "close"))},
    {_F32("volume_hand * 100 / factor", "volume")}, {_F32("factor", "factor")}, {_F32("amount_li / 1000.0::DOUBLE", "amount")} FROM bars JOIN f USING (ts_code, trade_date)""",
)
def a3_adjusted_panel(spark, d):
    f = prices.forward_factor(c.adj_factor(spark, d))
    out = prices.adjusted_panel(prices.with_factor(c.daily_bars(spark, d), f))
    return out.select("datetime", "instrument", *(F.col(f"`${k}`").alias(k) for k in ("open", "high", "low", "close", "volume", "factor", "amount")))


@query(
    "a5_adjusted_series",
    f"""WITH {FACTORS}, j AS (SELECT b.*, CASE WHEN day(b.trade_date) > 3 THEN adj_factor END AS a FROM bars b JOIN factors USING (ts_code, trade_date)),
    g AS (SELECT *, coalesce(last_value(a IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date), first_value(a IGNORE NULLS) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1.0) AS f FROM j),
    h AS (SELECT *, f / last_value(f) OVER w AS q, f / first_value(f) OVER w AS k FROM g WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT ts_code, {day("trade_date")}, CAST(round_even(close_li * q, 0) AS INTEGER) AS close_qfq, CAST(round_even(close_li * k, 0) AS INTEGER) AS close_hfq, volume_hand FROM h""",
)
def a5_adjusted_series(spark, d):
    f = c.adj_factor(spark, d).filter(F.dayofmonth("trade_date") > 3)
    return prices.adjusted_series(c.daily_bars(spark, d), f).select("ts_code", "trade_date", "close_qfq", "close_hfq", "volume_hand")


_FLOW_COLUMNS = {f"mf_{size}_{side}_{short}": f"{side}_{size}_{kind} * {unit}" for size in ("sm", "md", "lg", "elg") for side in ("buy", "sell") for kind, short, unit in (("vol", "vol", 100), ("amount", "amt", 10000))}


@query("a6_flow_panel", f"WITH {FLOWS} SELECT {day('trade_date', 'datetime')}, ts_code AS instrument, {', '.join(f'{v} AS {k}' for k, v in _FLOW_COLUMNS.items())}, net_mf_vol * 100 AS mf_net_vol, net_mf_amount * 10000 AS mf_net_amt FROM flows")
def a6_flow_panel(spark, d):
    return prices.flow_panel(c.money_flow(spark, d))


@query("a8_resample_15m", f"WITH {MINUTES} SELECT ts_code, {ts('time_bucket(INTERVAL 15 MINUTE, trade_time)', 'bucket')}, arg_min(open_li, trade_time) AS open_li, max(high_li) AS high_li, min(low_li) AS low_li, arg_max(close_li, trade_time) AS close_li, CAST(sum(volume_hand) AS BIGINT) AS volume_hand, CAST(sum(amount_li) AS BIGINT) AS amount_li, '15m' AS freq FROM minutes GROUP BY ts_code, time_bucket(INTERVAL 15 MINUTE, trade_time)")
def a8_resample_15m(spark, d):
    return bars.resample(c.minute_bars(spark, d), 15)


@query("a9_weekly_bars", f"WITH {BARS} SELECT ts_code, {day('CAST(date_trunc(' + chr(39) + 'week' + chr(39) + ', trade_date) AS DATE) + 4', 'week_end_date')}, arg_min(open_li, trade_date) AS open_li, max(high_li) AS high_li, min(low_li) AS low_li, arg_max(close_li, trade_date) AS close_li, CAST(sum(volume_hand) AS BIGINT) AS volume_hand, CAST(sum(amount_li) AS BIGINT) AS amount_li FROM bars GROUP BY ts_code, CAST(date_trunc('week', trade_date) AS DATE) + 4")
def a9_weekly_bars(spark, d):
    return bars.weekly(c.daily_bars(spark, d))


# --- order flow -----------------------------------------------------------------------------------------------------
@query(
    "a10_tick_buckets",
    f"""WITH {BUCKETS} SELECT symbol, {ts("bucket_start_time")}, buy_volume, sell_volume, neutral_volume, big_trade_volume, big_trade_count, total_volume, trade_count, {r6("realized_vol")}, '5m' AS freq,
    {r6("CASE WHEN buy_volume + sell_volume > 0 THEN (buy_volume - sell_volume) / CAST(buy_volume + sell_volume AS DOUBLE) ELSE 0 END", "order_flow_imbalance")}, 0.0::DOUBLE AS big_trade_ratio, {r6("total_volume / CAST(trade_count AS DOUBLE)", "avg_trade_size")}, {r6("trade_count / 5.0::DOUBLE", "intensity")} FROM buckets""",
)
def a10_tick_buckets(spark, d):
    return orderflow.tick_buckets(c.ticks(spark, d))


DAILY_FLOW = f"""{BUCKETS}, daily AS (SELECT symbol, CAST(bucket_start_time AS DATE) AS trade_date, CAST(sum(buy_volume) AS BIGINT) AS buy_volume, CAST(sum(sell_volume) AS BIGINT) AS sell_volume, CAST(sum(total_volume) AS BIGINT) AS total_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count, sqrt(sum(realized_vol * realized_vol)) AS intraday_realized_vol FROM buckets GROUP BY 1, 2)"""


@query("a11_daily_features", f"WITH {DAILY_FLOW} SELECT symbol, {day('trade_date')}, buy_volume, sell_volume, total_volume, trade_count, {r6('intraday_realized_vol')}, {r6('(buy_volume - sell_volume) / CAST(total_volume AS DOUBLE)', 'intraday_volume_imbalance')} FROM daily")
def a11_daily_features(spark, d):
    out = orderflow.daily_features(orderflow.tick_buckets(c.ticks(spark, d)))
    return out.select("symbol", "trade_date", "buy_volume", "sell_volume", "total_volume", "trade_count", "intraday_realized_vol", "intraday_volume_imbalance")


@query("a12_vwap", f"WITH {MINUTES} SELECT ts_code, {day('CAST(trade_time AS DATE)', 'trade_date')}, {r6('sum(amount_li) / (sum(volume_hand) * 100000.0::DOUBLE)', 'vwap')} FROM minutes GROUP BY ts_code, CAST(trade_time AS DATE)")
def a12_vwap(spark, d):
    return orderflow.vwap(c.minute_bars(spark, d)).select("ts_code", "trade_date", "vwap")


@query("a13_hourly_features", f"WITH {BUCKETS} SELECT symbol, {ts('date_trunc(' + chr(39) + 'hour' + chr(39) + ', bucket_start_time)', 'hour')}, CAST(sum(buy_volume) AS BIGINT) AS buy_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count, {r6('sqrt(sum(realized_vol * realized_vol))', 'realized_vol')}, {r6('sum(total_volume) / CAST(sum(trade_count) AS DOUBLE)', 'avg_trade_size')}, {r6('sum(trade_count) / 60.0::DOUBLE', 'intensity')} FROM buckets GROUP BY symbol, date_trunc('hour', bucket_start_time)")
def a13_hourly_features(spark, d):
    return orderflow.hourly_features(orderflow.tick_buckets(c.ticks(spark, d))).select("symbol", "hour", "buy_volume", "trade_count", "realized_vol", "avg_trade_size", "intensity")


@query("j3_bars_with_flow", f"WITH {BUCKETS}, b AS (SELECT ts_code, time_bucket(INTERVAL 5 MINUTE, trade_time) AS bucket, arg_max(close_li, trade_time) AS close_li FROM ({'WITH ' + MINUTES + ' SELECT * FROM minutes'}) GROUP BY 1, 2) SELECT b.ts_code, {ts('b.bucket', 'bucket')}, close_li, buy_volume, trade_count FROM b LEFT JOIN buckets k ON k.symbol = b.ts_code AND k.bucket_start_time = b.bucket")
def j3_bars_with_flow(spark, d):
    out = orderflow.with_flow(bars.resample(c.minute_bars(spark, d), 5), orderflow.tick_buckets(c.ticks(spark, d)))
    return out.select("ts_code", "bucket", "close_li", "buy_volume", "trade_count")


@query("a16_opening_window", f"WITH {MINUTES} SELECT ts_code, {day('CAST(trade_time AS DATE)', 'trade_date')}, arg_min(open_li, trade_time) AS first_li, arg_max(close_li, trade_time) AS last_li, CAST(sum(volume_hand) AS BIGINT) AS volume_hand, {r6('CASE WHEN arg_min(open_li, trade_time) > 0 THEN (arg_max(close_li, trade_time) - arg_min(open_li, trade_time)) / CAST(arg_min(open_li, trade_time) AS DOUBLE) * 100 END', 'pct')} FROM minutes WHERE strftime(trade_time, '%H:%M') BETWEEN '09:30' AND '10:30' GROUP BY ts_code, CAST(trade_time AS DATE)")
def a16_opening_window(spark, d):
    return bars.opening_window(c.minute_bars(spark, d), "09:30", "10:30")


@query("a17_window_sum", f"WITH {FLOWS} SELECT ts_code, CAST(sum(net_mf_amount) AS BIGINT) AS net_mf_amount_sum, count(*) AS rows FROM flows WHERE trade_date <= DATE '1996-06-30' AND trade_date > DATE '1996-06-30' - 20 GROUP BY ts_code")
def a17_window_sum(spark, d):
    return bars.window_sum(c.money_flow(spark, d), "1996-06-30", 20, value="net_mf_amount")


@query("a18_turnover_trend", f"WITH {BARS}, t AS (SELECT trade_date, sum(amount_li) AS total, row_number() OVER (ORDER BY trade_date DESC) AS r FROM bars GROUP BY 1), o AS (SELECT max(trade_date) AS d, CAST(max(total) FILTER (WHERE r = 1) AS BIGINT) AS latest, avg(total) FILTER (WHERE r > 1) AS earlier FROM t WHERE r <= 10) SELECT {day('d', 'latest_date')}, latest, {r6('earlier')}, {r6('latest / earlier', 'ratio')}, CASE WHEN latest / earlier >= 1.05 THEN 'expanding' WHEN latest / earlier <= 0.95 THEN 'shrinking' ELSE 'steady' END AS label FROM o")
def a18_turnover_trend(spark, d):
    return bars.turnover_trend(c.daily_bars(spark, d), value="amount_li")


# --- billboard ------------------------------------------------------------------------------------------------------
@query("a19_top_seats", f"WITH {RECORDS} SELECT youzi_name, count(*) AS records, CAST(sum(buy_amount) AS BIGINT) AS buy_amount, CAST(sum(sell_amount) AS BIGINT) AS sell_amount, CAST(sum(net_inflow) AS BIGINT) AS net_inflow FROM records GROUP BY 1 ORDER BY net_inflow DESC, youzi_name LIMIT 20")
def a19_top_seats(spark, d):
    return billboard.top_seats(c.billboard(spark, d))


@query("a20_top_stocks", f"WITH {RECORDS} SELECT stock_code, min(stock_name) AS stock_name, count(DISTINCT youzi_name) AS seats, CAST(sum(buy_amount) AS BIGINT) AS buy_amount, CAST(sum(sell_amount) AS BIGINT) AS sell_amount, CAST(sum(net_inflow) AS BIGINT) AS net_inflow, string_agg(DISTINCT concepts, ',' ORDER BY concepts) AS concepts FROM records GROUP BY 1 ORDER BY net_inflow DESC, stock_code LIMIT 20")
def a20_top_stocks(spark, d):
    return billboard.top_stocks(c.billboard(spark, d))


@query("a21_summary", f"WITH {RECORDS} SELECT count(*) AS records, count(DISTINCT stock_code) AS stocks, count(DISTINCT youzi_name) AS seats, CAST(sum(buy_amount) AS BIGINT) AS buy_amount, CAST(sum(sell_amount) AS BIGINT) AS sell_amount, CAST(sum(net_inflow) AS BIGINT) AS net_inflow FROM records")
def a21_summary(spark, d):
    return billboard.summary(c.billboard(spark, d))


@query("a21_concepts", f"WITH {RECORDS} SELECT trim(x) AS concept, count(*) AS records FROM (SELECT unnest(string_split(concepts, ',')) AS x FROM records) WHERE trim(x) <> '' GROUP BY 1 ORDER BY records DESC, concept LIMIT 20")
def a21_concepts(spark, d):
    return billboard.concept_counts(c.billboard(spark, d))


@query(
    "c7_stock_scores",
    f"""WITH {RECORDS}, s AS (SELECT *, buy_amount > 0 AS b, youzi_name || ' ' || yingye_bu AS w FROM records),
    k AS (SELECT *, (w LIKE '%0001%' OR w LIKE '%0002%') AS t1, w LIKE '%0003%' AS t2, w LIKE '%0004%' AS inst, len(list_filter(string_split(concepts, ','), lambda x: x LIKE '%STEEL%' OR x LIKE '%TIN%')) AS hot FROM s),
    g AS (SELECT stock_code, count(DISTINCT youzi_name) AS seats, count(*) AS n, sum(CASE WHEN NOT b THEN 0 WHEN t1 THEN 10 WHEN t2 THEN 5 ELSE 1.5 END)::DOUBLE AS pts, sum(net_inflow)::DOUBLE AS net, sum(buy_amount)::DOUBLE AS buy, sum(sell_amount)::DOUBLE AS sell,
          count(*) FILTER (WHERE inst AND b) AS ib, count(*) FILTER (WHERE NOT inst AND b) AS ob, count(*) FILTER (WHERE t1 AND b) AS tc, sum(hot) AS hot FROM k GROUP BY 1),
    p AS (SELECT *, least(pts, 30) AS cq, CASE WHEN net <= 0 THEN 0 WHEN net / 10000 <= 1000 THEN net / 10000 / 100 WHEN net / 10000 <= 5000 THEN 10 + (net / 10000 - 1000) * 8 / 4000 WHEN net / 10000 <= 10000 THEN 18 + (net / 10000 - 5000) * 4 / 5000 WHEN net / 10000 <= 20000 THEN 22 + (net / 10000 - 10000) * 3 / 10000 ELSE 25 END AS inf,
          CASE WHEN buy <= 0 THEN 0 WHEN sell / buy <= 0.1 THEN 20 WHEN sell / buy <= 0.3 THEN 20 - (sell / buy - 0.1) * 25 WHEN sell / buy <= 0.5 THEN 15 - (sell / buy - 0.3) * 25 WHEN sell / buy <= 0.8 THEN 10 - (sell / buy - 0.5) * 5 / 0.3 WHEN sell / buy <= 1 THEN 5 - (sell / buy - 0.8) * 25 ELSE 0 END AS pr,
          CASE WHEN ib > 0 AND ob > 0 THEN 15 WHEN ib > 0 THEN least(8 + ib * 2, 12) WHEN ob > 0 THEN least(5 + ob, 10) ELSE 0 END AS ins,
          least(10, CASE WHEN n = 1 THEN 3 WHEN n = 2 THEN 2.5 WHEN n = 3 THEN 2 WHEN n <= 5 THEN 1.5 ELSE 1 END + least(hot * 0.3, 3) + least(2, n - 1)
                + CASE WHEN buy <= 0 THEN 0 WHEN buy / (sell + 1) >= 10 THEN 2 WHEN buy / (sell + 1) >= 5 THEN 1.5 WHEN buy / (sell + 1) >= 3 THEN 1 ELSE 0 END) AS bo FROM g)
    SELECT stock_code, seats, ib AS institution_count, tc AS tier1_count, round(cq::DOUBLE, 6) + 0.0 AS capital_quality, round(inf::DOUBLE, 6) + 0.0 AS inflow, round(pr::DOUBLE, 6) + 0.0 AS sell_pressure, ins::DOUBLE AS institutions, round(bo::DOUBLE, 6) + 0.0 AS bonus, round((cq + inf + pr + ins + bo)::DOUBLE, 4) + 0.0 AS score FROM p""",
)
def c7_stock_scores(spark, d):
    records = c.billboard(spark, d)
    scored = billboard.stock_scores(records, tier1=["0001", "0002"], tier2=["0003"], institutions=["0004"], hot=["STEEL", "TIN"])
    return scored.drop("stock_name")


# --- indicators and windows -----------------------------------------------------------------------------------------
@query("w1_moving_averages", f"WITH {PANEL} SELECT symbol, {day('t')}, " + ", ".join(r6(f"CASE WHEN count(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END", f"ma{n}") for n in (5, 10, 20, 60)) + " FROM p")
def w1_moving_averages(spark, d):
    return indicators.moving_averages(panel(spark, d)).select("symbol", "t", "ma5", "ma10", "ma20", "ma60")


def _smoothed(x: str, a: float, n: str, w: str) -> str:
    """An exponential mean in closed form: the first value and the later ones weighted by powers of 1 - a, over a window."""
    q = f"(1 - {a!r}::DOUBLE)"
    return f"(power({q}, {n}) * sum(CASE WHEN {n} = 0 THEN {x} ELSE {a!r}::DOUBLE * ({x}) * power({q}, -{n}) END) OVER {w})"


_RUN = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query(
    "w3_rsi",
    f"""WITH {PANEL}, l AS (SELECT symbol, t, close - lag(close) OVER (PARTITION BY symbol ORDER BY t) AS x, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS n FROM p),
    s AS (SELECT symbol, t, n, {_smoothed("greatest(coalesce(x, 0), 0)", 1 / 14, "n", _RUN)} AS up, {_smoothed("greatest(coalesce(-x, 0), 0)", 1 / 14, "n", _RUN)} AS down FROM l)
    SELECT symbol, {day("t")}, CASE WHEN n >= 13 THEN round(CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END, 3) + 0.0 END AS rsi FROM s""",
)
def w3_rsi(spark, d):
    return indicators.rsi(panel(spark, d)).select("symbol", "t", F.round("rsi", 3).alias("rsi"))


@query(
    "w4_macd",
    f"""WITH {PANEL}, l AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS n FROM p),
    e AS (SELECT symbol, t, n, {_smoothed("close", 2 / 13, "n", _RUN)} - {_smoothed("close", 2 / 27, "n", _RUN)} AS line FROM l),
    m AS (SELECT symbol, t, line, n - 25 AS m FROM e WHERE n >= 25), g AS (SELECT symbol, t, m, line, {_smoothed("line", 2 / 10, "m", _RUN)} AS mean FROM m)
    SELECT symbol, {day("t")}, round(line, 3) + 0.0 AS macd, CASE WHEN m >= 8 THEN round(mean, 3) + 0.0 END AS macd_signal, CASE WHEN m >= 8 THEN round(line - mean, 3) + 0.0 END AS macd_hist FROM l LEFT JOIN g USING (symbol, t)""",
)
def w4_macd(spark, d):
    return indicators.macd(panel(spark, d)).select("symbol", "t", *(F.round(k, 3).alias(k) for k in ("macd", "macd_signal", "macd_hist")))


W20 = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("w5_bollinger", f"WITH {PANEL}, b AS (SELECT symbol, t, count(close) OVER {W20} AS n, avg(close) OVER {W20} AS m, stddev_pop(close) OVER {W20} AS s FROM p) SELECT symbol, {day('t')}, round(CASE WHEN n = 20 THEN m END, 6) + 0.0 AS bb_mid, round(CASE WHEN n = 20 THEN m + 2 * s END, 6) + 0.0 AS bb_upper FROM b")
def w5_bollinger(spark, d):
    return indicators.bollinger(panel(spark, d)).select("symbol", "t", "bb_mid", "bb_upper")


W14 = "(PARTITION BY symbol ORDER BY t ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"


@query("w6_stochastic", f"WITH {PANEL}, b AS (SELECT symbol, t, CASE WHEN count(low) OVER {W14} = 14 AND max(high) OVER {W14} > min(low) OVER {W14} THEN (close - min(low) OVER {W14}) * 100 / (max(high) OVER {W14} - min(low) OVER {W14}) END AS k FROM p) SELECT symbol, {day('t')}, {r6('k')}, {r6('CASE WHEN count(k) OVER w = 3 THEN avg(k) OVER w END', 'd')} FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def w6_stochastic(spark, d):
    return indicators.stochastic(panel(spark, d)).select("symbol", "t", "k", "d")


@query("w7_volume_averages", f"WITH {PANEL}, b AS (SELECT symbol, t, volume, CASE WHEN count(volume) OVER w = 5 THEN avg(volume) OVER w END AS m FROM p WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT symbol, {day('t')}, {r6('m', 'volume_ma5')}, {r6('volume / m', 'volume_ratio')} FROM b")
def w7_volume_averages(spark, d):
    return indicators.volume_averages(panel(spark, d)).select("symbol", "t", "volume_ma5", "volume_ratio")


@query("w8_latest_rows", f"WITH {PANEL} SELECT symbol, {day('t')}, {r6('close')} FROM p QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY t DESC) = 1")
def w8_latest_rows(spark, d):
    return indicators.latest_indicators(panel(spark, d)).select("symbol", "t", "close")


ARBR = f"""{PANEL}, l AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY t) AS c1 FROM p),
    s AS (SELECT symbol, t, count(c1) OVER w AS n, sum(high - open) OVER w AS ho, sum(open - low) OVER w AS ol, sum(high - c1) OVER w AS hc, sum(c1 - low) OVER w AS cl FROM l WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)),
    ab AS (SELECT symbol, t, 100 * ho / nullif(ol, 0) AS ar, 100 * hc / nullif(cl, 0) AS br FROM s WHERE n = 26)"""


@query("w9_arbr", f"WITH {ARBR} SELECT symbol, {day('t')}, round(ar, 4) + 0.0 AS ar, round(br, 4) + 0.0 AS br, CAST(sign(CASE WHEN ar > 150 THEN -1 WHEN ar < 70 THEN 1 ELSE 0 END + CASE WHEN br > 300 THEN -1 WHEN br < 50 THEN 1 ELSE 0 END) AS INTEGER) AS signal FROM ab WHERE ar IS NOT NULL AND br IS NOT NULL")
def w9_arbr(spark, d):
    return indicators.arbr_signals(indicators.arbr(panel(spark, d))).select("symbol", "t", F.round("ar", 4).alias("ar"), F.round("br", 4).alias("br"), "signal")


_ARBR_STATS = ", ".join(f"round({f}({k}), 4) + 0.0 AS {k}_{name}" for k in ("ar", "br") for name, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query(
    "w10_arbr_summary",
    f"""WITH {ARBR}, marks AS (SELECT *, sign(CASE WHEN ar > 150 THEN -1 WHEN ar < 70 THEN 1 ELSE 0 END + CASE WHEN br > 300 THEN -1 WHEN br < 50 THEN 1 ELSE 0 END) AS g FROM ab WHERE ar IS NOT NULL AND br IS NOT NULL)
    SELECT symbol, count(*) AS rows, count(*) FILTER (WHERE g = 1) AS buys, count(*) FILTER (WHERE g = -1) AS sells, count(*) FILTER (WHERE g = 0) AS neutrals, {_ARBR_STATS}, {r6("count(*) FILTER (WHERE g = 1) / count(*)::DOUBLE", "buys_ratio")},
    CASE WHEN avg(ar) > 180 THEN 'extremely overbought' WHEN avg(ar) > 150 THEN 'overbought' WHEN avg(ar) < 40 THEN 'extremely oversold' WHEN avg(ar) < 70 THEN 'oversold' ELSE 'normal' END AS label FROM marks GROUP BY 1""",
)
def w10_arbr_summary(spark, d):
    out = indicators.arbr_summary(indicators.arbr_signals(indicators.arbr(panel(spark, d))))
    rounded = {f"{k}_{name}": F.round(f"{k}_{name}", 4) for k in ("ar", "br") for name in ("mean", "std", "min", "max")}
    return out.withColumns(rounded).drop("sells_ratio", "neutrals_ratio")


@query("w12_log_return", f"WITH {PANEL} SELECT symbol, {day('t')}, {r6('ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t))', 'log_return')} FROM p")
def w12_log_return(spark, d):
    return windows.log_return(panel(spark, d)).select("symbol", "t", "log_return")


@query("w13_fill", f"WITH {PANEL}, h AS (SELECT symbol, t, CASE WHEN day(t) % 3 > 0 THEN close END AS close FROM p) SELECT symbol, {day('t')}, {r6('coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t), first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))', 'close')} FROM h")
def w13_fill(spark, d):
    rows = panel(spark, d).withColumn("close", F.when(F.dayofmonth("t") % 3 > 0, F.col("close")))
    return windows.fill(rows, ["close"], how="both").select("symbol", "t", "close")


@query("w14_outliers", f"WITH {PANEL} SELECT symbol, {day('t')}, volume FROM p QUALIFY volume > avg(volume) OVER (PARTITION BY symbol) + 3 * stddev_samp(volume) OVER (PARTITION BY symbol)")
def w14_outliers(spark, d):
    return windows.outliers(panel(spark, d), value="volume", k=3).select("symbol", "t", "volume")


@query("w15_rating_changes", "SELECT o_custkey, o_orderkey, o_orderpriority AS rating, p AS previous FROM (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders) WHERE p <> o_orderpriority")
def w15_rating_changes(spark, d):
    o = c.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "rating")
    return windows.changes(o, value="rating", key="o_custkey", time="o_orderdate", tie="o_orderkey").select("o_custkey", "o_orderkey", "rating", "previous")


@query("w16_islands", f"WITH {BARS}, n AS (SELECT ts_code, trade_date, trade_date - CAST(row_number() OVER (PARTITION BY ts_code ORDER BY trade_date) AS INTEGER) AS i FROM bars) SELECT ts_code, {day('min(trade_date)', 'first_day')}, {day('max(trade_date)', 'last_day')}, count(*) AS days FROM n GROUP BY ts_code, i")
def w16_islands(spark, d):
    return windows.islands(c.daily_bars(spark, d), day="trade_date", keys=["ts_code"])


@query("w17_span_change", f"WITH {BARS}, l AS (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 5) SELECT ts_code, count(*) AS rows, arg_max(close_li, trade_date) - arg_min(close_li, trade_date) AS close_li_change, CAST(sum(amount_li) AS BIGINT) AS amount_li_sum FROM l GROUP BY 1")
def w17_span_change(spark, d):
    return windows.span_change(c.daily_bars(spark, d), 5, key="ts_code", time="trade_date", level="close_li", flows=["amount_li"])


@query("w18_index_metrics", f"WITH {BARS}, l AS (SELECT *, lag(close_li) OVER (PARTITION BY ts_code ORDER BY trade_date) AS p FROM bars WHERE trade_date <= DATE '1996-06-30') SELECT ts_code, {day('trade_date')}, close_li - p AS diff, {r6('(close_li - p) * 100.0::DOUBLE / p', 'pct')}, CAST(row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS INTEGER) AS rank FROM l QUALIFY rank <= 6")
def w18_index_metrics(spark, d):
    return windows.index_metrics(c.daily_bars(spark, d), "1996-06-30").select("ts_code", "trade_date", "diff", "pct", "rank")


@query("w19_heat", f"WITH {QUOTES}, s AS (SELECT ts_code, trade_date, coalesce(pct_chg, 0)::DOUBLE AS a, amount_li::DOUBLE AS b FROM quotes), n AS (SELECT ts_code, trade_date, CASE WHEN max(a) OVER w > min(a) OVER w THEN (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) * 2 - 1 ELSE -1 END AS x, CASE WHEN max(b) OVER w > min(b) OVER w THEN (b - min(b) OVER w) / (max(b) OVER w - min(b) OVER w) * 2 - 1 ELSE -1 END AS y FROM s WINDOW w AS (PARTITION BY trade_date)) SELECT ts_code, {day('trade_date')}, {r6('0.4::DOUBLE * x + 0.6::DOUBLE * y', 'heat')} FROM n")
def w19_heat(spark, d):
    return windows.blended_heat(c.quotes(spark, d), alpha=0.4, time="trade_date", flow="amount_li").select("ts_code", "trade_date", "heat")


@query("w20_volume_ratio", f"WITH {BARS}, l AS (SELECT *, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS r FROM bars QUALIFY r <= 5), g AS (SELECT ts_code, max(volume_hand) FILTER (WHERE r = 1) AS latest, avg(volume_hand) FILTER (WHERE r > 1) AS earlier FROM l GROUP BY 1) SELECT ts_code, latest, {r6('earlier')}, {r6('latest / earlier', 'ratio')} FROM g")
def w20_volume_ratio(spark, d):
    return windows.volume_ratio(c.daily_bars(spark, d))


@query(
    "w22_sequences",
    f"""WITH {PANEL}, z AS (SELECT symbol, t, (close - avg(close) OVER (PARTITION BY symbol)) / (stddev_pop(close) OVER (PARTITION BY symbol) + 1e-8) AS z, ln(lead(close) OVER (PARTITION BY symbol ORDER BY t) / close) AS y, row_number() OVER (PARTITION BY symbol ORDER BY t) AS n FROM p),
    s AS (SELECT *, sum(z) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x, first_value(z) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS x0 FROM z)
    SELECT symbol, {day("t")}, 10 AS steps, round(x, 4) + 0.0 AS x_sum, round(x0, 4) + 0.0 AS x_first, {r6("y")} FROM s WHERE n >= 10 AND y IS NOT NULL""",
)
def w22_sequences(spark, d):
    out = sequences.sequences(panel(spark, d), ["close"], 10)
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v[0])
    return out.select("symbol", "t", F.size("x").alias("steps"), F.round(total, 4).alias("x_sum"), F.round(F.col("x")[0][0], 4).alias("x_first"), "y")


@query(
    "w23_last_sequence",
    f"""WITH {PANEL}, z AS (SELECT symbol, t, (close - avg(close) OVER w) / (stddev_pop(close) OVER w + 1e-8) AS a, (volume - avg(volume) OVER w) / (stddev_pop(volume) OVER w + 1e-8) AS b FROM p WINDOW w AS (PARTITION BY symbol)),
    l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t DESC) AS r FROM z QUALIFY r <= 10)
    SELECT symbol, {day("max(t)", "t")}, count(*) AS steps, {r6("arg_max(a, t)", "last_close")}, {r6("arg_min(b, t)", "first_volume")}, round(sum(a * (11 - r)), 4) + 0.0 AS weighted_close FROM l GROUP BY symbol HAVING count(*) = 10""",
)
def w23_last_sequence(spark, d):
    out = sequences.last_sequence(panel(spark, d), ["close", "volume"], 10)
    weighted = F.aggregate(F.transform("x", lambda v, i: v[0] * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return out.select("symbol", "t", F.size("x").cast("long").alias("steps"), F.element_at(F.element_at("x", -1), 1).alias("last_close"), F.col("x")[0][1].alias("first_volume"), F.round(weighted, 4).alias("weighted_close"))


STATIC = f"""{BARS}, r AS (SELECT ts_code, amount_li, ln(close_li / CAST(lag(close_li) OVER (PARTITION BY ts_code ORDER BY trade_date) AS DOUBLE)) AS lr FROM bars),
    g AS (SELECT ts_code, avg(amount_li) AS a, stddev_samp(lr) AS v FROM r GROUP BY 1), q AS (SELECT quantile_cont(a, [0.25, 0.5, 0.75]) AS qa, quantile_cont(v, [0.25, 0.5, 0.75]) AS qv FROM g)"""


@query("a15_static_features", f"WITH {STATIC} SELECT ts_code, round(a, 4) + 0.0 AS mean_amount, {r6('v', 'volatility')}, CASE WHEN a <= qa[1] THEN 'S' WHEN a <= qa[2] THEN 'M' WHEN a <= qa[3] THEN 'L' ELSE 'XL' END AS size_bucket, CASE WHEN v IS NULL THEN 'HIGH' WHEN v <= qv[1] THEN 'LOW' WHEN v <= qv[2] THEN 'MID' WHEN v <= qv[3] THEN 'HIGH' ELSE 'VERY_HIGH' END AS volatility_bucket FROM g, q")
def a15_static_features(spark, d):
    out = sequences.static_features(c.daily_bars(spark, d))
    return out.select("ts_code", F.round("mean_amount", 4).alias("mean_amount"), "volatility", "size_bucket", "volatility_bucket")


@query("a29_category_codes", "WITH k AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS s FROM customer), r AS (SELECT c_custkey, CASE WHEN s IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY s NULLS LAST) - 1 END AS z FROM k) SELECT c_custkey, round((z - (SELECT avg(z) FROM r)) / ((SELECT stddev_samp(z) FROM r) + 1e-8), 6) + 0.0 AS segment_z FROM r")
def a29_category_codes(spark, d):
    rows = c.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 > 0, F.col("c_mktsegment")).alias("segment"))
    return sequences.category_codes(rows, ["segment"]).select("c_custkey", "segment_z")


@query("j6_as_of", f"WITH {FACTORS}, f AS (SELECT ts_code, trade_date AS as_of_date, adj_factor FROM factors WHERE day(trade_date) % 10 = 1) SELECT b.ts_code, {day('b.trade_date', 'trade_date')}, {r6('adj_factor')} FROM bars b ASOF LEFT JOIN f ON b.ts_code = f.ts_code AND b.trade_date >= f.as_of_date")
def j6_as_of(spark, d):
    f = c.adj_factor(spark, d).filter(F.dayofmonth("trade_date") % 10 == 1).withColumnRenamed("trade_date", "as_of_date")
    return sequences.as_of(c.daily_bars(spark, d).select("ts_code", "trade_date"), f, key="ts_code", time="trade_date", right_time="as_of_date", values=["adj_factor"])
