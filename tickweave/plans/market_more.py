"""Registered queries of screens, joins, quality, coverage, breadth, text, trend, risk, signals, sinks and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes
from ..operators import bars, breadth, coverage, flows, indicators, prices, quality, risk, signals, text, trend, universe, windows
from ..sources import contracts as c
from ..sources import sinks
from ..streaming import streams
from .market import plain
from .sql import BARS, BUCKETS, CALENDAR, FACTORS, FLOWS, NEWS, QUOTES, TICKS, code, day, r6, ts

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tickweave-")
    return f"{base.rstrip('/')}/tickweave-{label}-{uuid.uuid4().hex}"


# --- scalar functions -----------------------------------------------------------------------------------------------
KEYS = "SELECT c_custkey, lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR), 6, '0') AS k FROM customer"


def _keys(spark, d) -> DataFrame:
    return c.table(spark, d, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0").alias("k"))


@query("f1_codes", f"WITH x AS ({KEYS}), y AS (SELECT *, k || CASE WHEN k LIKE '6%' THEN '.SH' WHEN k LIKE '8%' OR k LIKE '4%' THEN '.BJ' ELSE '.SZ' END AS a, k || CASE WHEN k LIKE '6%' OR k LIKE '5%' THEN '.SH' WHEN k LIKE '8%' OR k LIKE '4%' THEN '.BJ' ELSE '.SZ' END AS b FROM x) SELECT c_custkey, a AS ingest_code, b AS app_code, right(a, 2) || k AS instrument, a AS back, k AS bare FROM y")
def f1_codes(spark, d):
    k = _keys(spark, d).withColumn("a", codes.ingest_ts_code(F.col("k")))
    return k.select("c_custkey", F.col("a").alias("ingest_code"), codes.app_ts_code(F.col("k")).alias("app_code"), codes.instrument(F.col("a")).alias("instrument"), codes.from_instrument(codes.instrument(F.col("a"))).alias("back"), codes.bare_code(F.col("a")).alias("bare"))


@query("f6_dates", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders")
def f6_dates(spark, d):
    o = c.table(spark, d, "orders")
    text_of = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("2024-13")
    return o.select("o_orderkey", codes.any_date(text_of).alias("day"))


@query("f9_json", "SELECT event_id, coalesce(json_extract_string(props, '$.rating'), json_extract_string(props, '$.k')) AS rating FROM events")
def f9_json(spark, d):
    return c.table(spark, d, "events").select("event_id", codes.json_rating(F.col("props"), "$.rating", "$.k").alias("rating"))


@query("f12_concat", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def f12_concat(spark, d):
    return c.table(spark, d, "customer").groupBy("c_nationkey").agg(codes.ordered_concat(F.col("c_mktsegment")).alias("segments"))


@query("f13_cut", "SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE text END AS cut FROM documents")
def f13_cut(spark, d):
    return c.table(spark, d, "documents").select("doc_id", codes.cut(F.col("text"), 500).alias("cut"))


# --- universes and screens ------------------------------------------------------------------------------------------
@query("p1_exchange", f"WITH {BARS} SELECT ts_code, count(*) AS rows FROM bars WHERE ts_code LIKE '%.SH' OR ts_code LIKE '%.SZ' GROUP BY 1")
def p1_exchange(spark, d):
    return universe.by_exchange(c.daily_bars(spark, d)).groupBy("ts_code").agg(F.count("*").alias("rows"))


@query("p4_universe", f"WITH {BARS} SELECT DISTINCT ts_code FROM bars WHERE trade_date BETWEEN DATE '1995-06-01' AND DATE '1995-12-31' AND (ts_code LIKE '%.SH' OR ts_code LIKE '%.SZ') AND ts_code NOT IN (SELECT {code('n_nationkey')} FROM nation WHERE n_regionkey = 1) AND ts_code NOT IN (SELECT {code('n_nationkey')} FROM nation WHERE n_nationkey % 6 = 0)")
def p4_universe(spark, d):
    n = c.table(spark, d, "nation")
    st = n.filter("n_regionkey = 1").select(c.code_of(F.col("n_nationkey")).alias("ts_code"))
    basics = n.select(c.code_of(F.col("n_nationkey")).alias("ts_code"), F.when(F.col("n_nationkey") % 6 == 0, "D").otherwise("L").alias("list_status"))
    return universe.traded_universe(c.daily_bars(spark, d), "1995-06-01", "1995-12-31", st, basics, time="trade_date")


@query("p9_units", "SELECT p_partkey, round(CASE WHEN (SELECT max(p_retailprice * 1000) FROM part) > 100000 THEN p_retailprice * 1000 / 1e8 ELSE p_retailprice * 1000 END, 6) + 0.0 AS cap FROM part")
def p9_units(spark, d):
    return universe.to_hundred_millions(c.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") * 1000).alias("cap")), "cap")


@query("p11_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'al') OR contains(lower(p_type), 'al')")
def p11_search(spark, d):
    return universe.keyword_search(c.table(spark, d, "part"), "AL", ("p_name", "p_type")).select("p_partkey", "p_name")


@query("p12_membership", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def p12_membership(spark, d):
    items, bridge, _ = _watch(spark, d)
    return universe.in_category(items, bridge, 1).select(F.col("id").alias("c_custkey"), F.col("name").alias("c_name"))


def _watch(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as watched items, market segments as categories (numbered in order)."""
    k = c.table(spark, d, "customer")
    names = k.select(F.col("c_mktsegment").alias("name")).distinct()
    from pyspark.sql import Window

    categories = names.withColumn("id", F.row_number().over(Window.orderBy("name")))  # a handful of segments
    bridge = k.join(F.broadcast(categories), F.col("c_mktsegment") == F.col("name")).select(F.col("c_custkey").alias("item_id"), F.col("id").alias("category_id"))
    return k.select(F.col("c_custkey").alias("id"), c.code_of(F.col("c_nationkey")).alias("code"), F.col("c_name").alias("name"), "c_acctbal"), bridge, categories


@query(
    "c1_opening_screen",
    f"""WITH {QUOTES}, m AS (SELECT *, avg(close_li) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma20 FROM quotes),
    {FLOWS}, f AS (SELECT ts_code, sum(net_mf_amount) AS net_sum FROM flows WHERE trade_date <= DATE '1996-06-30' AND trade_date > DATE '1996-06-30' - 60 GROUP BY 1)
    SELECT m.ts_code, {day("m.trade_date", "trade_date")}, close_li, {r6("pct_chg")}, {r6("ma20")}, CAST(net_sum AS BIGINT) AS net_sum FROM m LEFT JOIN f USING (ts_code)
    WHERE trade_date BETWEEN DATE '1996-06-01' AND DATE '1996-06-30' AND pct_chg >= -50 AND pct_chg <= 400 AND close_li >= 100000 ORDER BY m.pct_chg DESC NULLS LAST, m.ts_code, m.trade_date LIMIT 30""",
)
def c1_opening_screen(spark, d):
    rows = indicators.moving_averages(c.quotes(spark, d), (20,), value="close_li", symbol="ts_code", time="trade_date", full=False)
    rows = rows.filter(F.col("trade_date").between(F.lit("1996-06-01").cast("date"), F.lit("1996-06-30").cast("date")))
    net = bars.window_sum(c.money_flow(spark, d), "1996-06-30", 60, value="net_mf_amount").select("ts_code", F.col("net_mf_amount_sum").alias("net_sum"))
    kept, _, _ = universe.threshold_chain(rows.join(net, "ts_code", "left"), [("pct_chg", -50.0, 400.0), ("close_li", 100000, None), ("turnover_rate", 1.0, None)])
    return kept.orderBy(F.desc_nulls_last("pct_chg"), "ts_code", "trade_date").limit(30).select("ts_code", "trade_date", "close_li", "pct_chg", "ma20", "net_sum")


# --- joins ----------------------------------------------------------------------------------------------------------
@query("j1_price_factor", f"WITH {FACTORS} SELECT ts_code, {day('bars.trade_date', 'trade_date')}, close_li, {r6('adj_factor', 'factor')} FROM bars JOIN factors USING (ts_code, trade_date)")
def j1_price_factor(spark, d):
    f = c.adj_factor(spark, d).withColumnRenamed("adj_factor", "factor")
    return prices.with_factor(c.daily_bars(spark, d), f).select("ts_code", "trade_date", "close_li", "factor")


@query("j7_board_daily", f"WITH {BARS} SELECT ts_code, n_name AS name, r_name AS idx_type, close_li, amount_li AS amount FROM bars JOIN nation ON {code('n_nationkey')} = ts_code JOIN region ON n_regionkey = r_regionkey WHERE trade_date = DATE '1995-06-07' ORDER BY r_name, amount DESC NULLS LAST, ts_code LIMIT 10")
def j7_board_daily(spark, d):
    members = c.board_members(spark, d)
    at = F.array(F.lit("1995-01-01").cast("date"), F.lit(None).cast("date"), F.lit("1999-01-01").cast("date"))
    index = members.select(F.col("con_code").alias("ts_code"), F.explode(at).alias("trade_date"), F.col("con_name").alias("n"), F.col("board_code").alias("idx_type"))
    index = index.withColumn("name", F.when(F.col("trade_date") == F.lit("1995-01-01").cast("date"), F.col("n")).otherwise("other"))
    daily = c.daily_bars(spark, d).withColumnRenamed("amount_li", "amount")
    return signals.board_daily(daily, index, "1995-06-07", 10).select("ts_code", "name", "idx_type", "close_li", "amount")


@query("j8_latest_per_parent", "SELECT c_custkey, o_orderkey, o_orderpriority FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON o_custkey = c_custkey")
def j8_latest_per_parent(spark, d):
    o = c.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return signals.latest_per_parent(c.table(spark, d, "customer").select("c_custkey"), o, key="c_custkey", time="o_orderdate", tie="o_orderkey", columns=["o_orderkey", "o_orderpriority"])


@query("j9_top_constituents", f"WITH {QUOTES} SELECT con_code, n_name AS con_name, close_li, amount_li FROM (SELECT {code('n_nationkey')} AS con_code, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)) JOIN (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1) ON ts_code = con_code ORDER BY amount_li DESC NULLS LAST, con_code LIMIT 5")
def j9_top_constituents(spark, d):
    last = windows.latest(c.quotes(spark, d), key="ts_code", order=[F.desc("trade_date")])
    members = c.board_members(spark, d)
    first = members.agg(F.min("board_code").alias("board_code"))
    chosen = members.join(F.broadcast(first), "board_code").withColumn("board_code", F.lit("first"))
    return signals.top_constituents(chosen, last, "first", "amount_li", 5).select("con_code", "con_name", "close_li", "amount_li")


@query("j10_categories", "SELECT c_custkey AS id, c_mktsegment AS categories, CAST(1 AS BIGINT) AS n_categories FROM customer")
def j10_categories(spark, d):
    return signals.with_categories(*_watch(spark, d)).select("id", "categories", "n_categories")


# --- flows, breadth, text, trend, risk ------------------------------------------------------------------------------
@query("c8_breadth", f"WITH {QUOTES}, b AS (SELECT trade_date, count(*) AS total, count(*) FILTER (WHERE pct_chg > 0) AS up, count(*) FILTER (WHERE pct_chg < 0) AS down, count(*) FILTER (WHERE pct_chg = 0) AS flat, count(*) FILTER (WHERE pct_chg >= 9.5) AS limit_up, count(*) FILTER (WHERE pct_chg <= -9.5) AS limit_down FROM quotes WHERE pct_chg IS NOT NULL GROUP BY 1) SELECT {day('trade_date')}, total, up, down, flat, limit_up, limit_down, {r6('(up - down) * 100.0::DOUBLE / total', 'sentiment')}, {r6('CASE WHEN limit_up + limit_down > 0 THEN limit_up * 100.0::DOUBLE / (limit_up + limit_down) ELSE 50 END', 'limit_ratio')}, {r6('greatest(0, least(100, 50 + (up / total - 0.5) * 60))', 'fear_greed')}, CASE WHEN (up - down) * 100.0::DOUBLE / total > 30 THEN 'very bullish' WHEN (up - down) * 100.0::DOUBLE / total > 10 THEN 'bullish' WHEN (up - down) * 100.0::DOUBLE / total > -10 THEN 'neutral' WHEN (up - down) * 100.0::DOUBLE / total > -30 THEN 'bearish' ELSE 'very bearish' END AS sentiment_label, CASE WHEN limit_up + limit_down = 0 THEN 'even' WHEN limit_up * 100.0::DOUBLE / (limit_up + limit_down) > 70 THEN 'very strong' WHEN limit_up * 100.0::DOUBLE / (limit_up + limit_down) > 60 THEN 'strong' WHEN limit_up * 100.0::DOUBLE / (limit_up + limit_down) > 40 THEN 'even' WHEN limit_up * 100.0::DOUBLE / (limit_up + limit_down) > 30 THEN 'weak' ELSE 'very weak' END AS limit_label, CASE WHEN greatest(0, least(100, 50 + (up / total - 0.5) * 60)) >= 75 THEN 'extreme greed' WHEN greatest(0, least(100, 50 + (up / total - 0.5) * 60)) >= 60 THEN 'greed' WHEN greatest(0, least(100, 50 + (up / total - 0.5) * 60)) >= 40 THEN 'neutral' WHEN greatest(0, least(100, 50 + (up / total - 0.5) * 60)) >= 25 THEN 'fear' ELSE 'extreme fear' END AS fear_greed_label FROM b")
def c8_breadth(spark, d):
    return breadth.breadth(c.quotes(spark, d)).select("trade_date", "total", "up", "down", "flat", "limit_up", "limit_down", "sentiment", "limit_ratio", "fear_greed", "sentiment_label", "limit_label", "fear_greed_label")


@query("c12_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 20 THEN 'very high' WHEN l_quantity > 10 THEN 'high' WHEN l_quantity > 5 THEN 'normal' WHEN l_quantity > 2 THEN 'low' ELSE 'very low' END AS turnover, CASE WHEN l_tax * 100 > 10 THEN 'high' WHEN l_tax * 100 > 3 THEN 'medium' WHEN l_tax * 100 > 1 THEN 'low' ELSE 'very low' END AS margin FROM lineitem")
def c12_labels(spark, d):
    return c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", breadth.turnover_label(F.col("l_quantity")).alias("turnover"), breadth.margin_label(F.col("l_tax") * 100).alias("margin"))


@query("c15_net_flows", f"WITH {FLOWS}, n AS (SELECT ts_code, trade_date, buy_sm_amount - sell_sm_amount AS net_sm, buy_lg_amount - sell_lg_amount + buy_elg_amount - sell_elg_amount AS net_main, buy_sm_amount + buy_md_amount + buy_lg_amount + buy_elg_amount + sell_sm_amount + sell_md_amount + sell_lg_amount + sell_elg_amount AS traded FROM flows) SELECT ts_code, {day('trade_date')}, net_sm, net_main, {r6('net_main * 100.0::DOUBLE / nullif(traded, 0)', 'main_share')} FROM n QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 20")
def c15_net_flows(spark, d):
    return flows.net_flows(c.money_flow(spark, d), 20).select("ts_code", "trade_date", "net_sm", "net_main", "main_share")


@query(
    "c14_chip_changes",
    f"""WITH {BARS}, g AS (SELECT ts_code, count(*) AS days, arg_min(low_li, trade_date)::DOUBLE AS a15, arg_max(low_li, trade_date)::DOUBLE AS b15, arg_min(open_li, trade_date)::DOUBLE AS aw, arg_max(open_li, trade_date)::DOUBLE AS bw,
    arg_min(close_li, trade_date)::DOUBLE AS a50, arg_max(close_li, trade_date)::DOUBLE AS b50, arg_min(high_li, trade_date)::DOUBLE AS a85, arg_max(high_li, trade_date)::DOUBLE AS b85 FROM bars GROUP BY 1),
    k AS (SELECT *, (a85 - a15) * 100 / a50 AS c0, (b85 - b15) * 100 / b50 AS c1, b50 - a50 AS d50, bw - aw AS dw, b85 - a85 AS d85, b15 - a15 AS d15 FROM g),
    s AS (SELECT *, CASE WHEN c1 < c0 AND c1 <= 30 THEN 2 ELSE 0 END + CASE WHEN dw > 0 AND d50 > 0 AND d85 > 0 AND abs(d85) > abs(d15) * 1.5 THEN -3 ELSE 0 END + CASE WHEN c1 > c0 AND c1 > 30 THEN -2 ELSE 0 END + CASE WHEN abs(d15) < abs(a15) * 0.1 AND d50 > 0 THEN 1 ELSE 0 END AS behaviour FROM k)
    SELECT ts_code, days, {r6("d50 * 100 / a50", "cost_50pct_change")}, {r6("c1", "concentration")}, CASE WHEN dw > 0 AND d50 > 0 THEN 'up' WHEN dw < 0 AND d50 < 0 THEN 'down' ELSE 'swinging' END AS peak_direction, behaviour,
    CASE WHEN behaviour >= 3 THEN 'accumulating' WHEN behaviour >= 1 THEN 'perhaps accumulating' WHEN behaviour <= -3 THEN 'distributing' WHEN behaviour <= -1 THEN 'perhaps distributing' ELSE 'consolidating' END AS behaviour_label FROM s""",
)
def c14_chip_changes(spark, d):
    costs = c.daily_bars(spark, d).select("ts_code", "trade_date", *(F.col(x).cast("double").alias(k) for k, x in (("cost_5pct", "low_li"), ("cost_15pct", "low_li"), ("cost_50pct", "close_li"), ("cost_85pct", "high_li"), ("cost_95pct", "high_li"), ("weight_avg", "open_li"))))
    return flows.chip_changes(costs).select("ts_code", "days", "cost_50pct_change", "concentration", "peak_direction", "behaviour", "behaviour_label")


POSITIVE, NEGATIVE, TOPICS = ["the", "ing", "que"], ["schaft", "ation", "en"], ["th", "er", "an", "la", "de"]
_HITS = lambda words, x: " + ".join(f"CAST(contains({x}, '{w}') AS INTEGER)" for w in words)


@query("c17_sentiment", f"WITH h AS (SELECT doc_id, {_HITS(POSITIVE, 'text')} AS p, {_HITS(NEGATIVE, 'text')} AS n, text FROM documents) SELECT doc_id, p AS positive, n AS negative, CASE WHEN p > n * 1.5 THEN 'positive' WHEN n > p * 1.5 THEN 'negative' ELSE 'neutral' END AS sentiment, {r6('(p - n) * 100.0::DOUBLE / greatest(p + n, 1)', 'sentiment_score')}, array_to_string(list_filter(['th', 'er', 'an', 'la', 'de'], lambda w: contains(text, w)), ',') AS topics FROM h")
def c17_sentiment(spark, d):
    return text.keyword_sentiment(c.table(spark, d, "documents"), text="text", positive=POSITIVE, negative=NEGATIVE, topics=TOPICS).select("doc_id", "positive", "negative", "sentiment", "sentiment_score", "topics")


@query("c18_event_score", f"WITH h AS (SELECT source, CAST(sum({_HITS(POSITIVE, 'text')}) AS BIGINT) AS positive, CAST(sum({_HITS(NEGATIVE, 'text')}) AS BIGINT) AS negative FROM documents GROUP BY 1) SELECT source, positive, negative, {r6('greatest(-2.0, least(2.0, (positive - negative) * 0.4))::DOUBLE', 'score')} FROM h")
def c18_event_score(spark, d):
    return text.event_score(c.table(spark, d, "documents"), key="source", text="text", positive=POSITIVE, negative=NEGATIVE, weight=0.4, limit=2.0)


@query("a24_news_stats", f"WITH {NEWS} SELECT source, count(*) AS items, count(*) FILTER (WHERE is_important) AS important, {ts('min(publish_time)', 'first_time')}, {ts('max(publish_time)', 'last_time')} FROM news GROUP BY 1")
def a24_news_stats(spark, d):
    return text.news_stats(c.news(spark, d))


@query(
    "a27_report_stats",
    """WITH r AS (SELECT o_custkey, o_orderpriority AS rating, o_clerk AS x FROM (SELECT *, o_orderstatus AS o_clerk FROM orders))
    SELECT o_custkey, count(*) AS reports, count(DISTINCT x) AS institutions, count(*) FILTER (WHERE rating LIKE '%URGENT%') AS buy, count(*) FILTER (WHERE rating LIKE '%LOW%') AS sell,
    round(count(*) FILTER (WHERE rating LIKE '%URGENT%') / CAST(count(*) AS DOUBLE), 6) + 0.0 AS buy_ratio FROM r GROUP BY 1""",
)
def a27_report_stats(spark, d):
    o = c.table(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("rating"), F.col("o_orderstatus").alias("org_name"), F.col("o_totalprice").alias("target_price"), F.lit(None).cast("double").alias("eps"), F.col("o_orderdate").alias("report_date"), F.col("o_orderkey").cast("string").alias("report_title"))
    return text.report_stats(o, key="o_custkey", buy="URGENT", sell="LOW").select("o_custkey", "reports", "institutions", "buy", "sell", "buy_ratio")


def _outlook(spark, d) -> DataFrame:
    rows = c.quotes(spark, d).select("ts_code", "trade_date", "pct_chg", (F.col("volume_hand") * 10.0).alias("rsi"), (F.col("volume_hand") / 3.0).alias("volume_ratio"), ((F.col("close_li") % 401 - 200) / 100.0).alias("s"))
    out = trend.baseline(rows)
    for name in trend.FACTORS:
        out = trend.adjust(out, name, "s")
    return trend.spread(out)


def _outlook_sql() -> str:
    """The baseline for each horizon, then a step for each factor."""
    rows = ", ".join(f"('{h}', {i}, {trend.ADD_ON[h]}, {trend.RANGES[h][0] / 2}, {trend.RANGES[h][2] / 2})" for i, h in enumerate(trend.HORIZONS))
    pick = lambda i: f"CASE WHEN score + added >= 2 THEN {trend.BULL[i]}::DOUBLE WHEN score + added <= -2 THEN {trend.BEAR[i]}::DOUBLE ELSE {trend.PLAIN[i]}::DOUBLE END"
    steps = [
        f"""q AS (SELECT ts_code, trade_date, coalesce(pct_chg, 0)::DOUBLE AS c, coalesce(nullif(volume_hand * 10.0::DOUBLE, 0), 50) AS r, coalesce(nullif(volume_hand / 3.0::DOUBLE, 0), 1) AS v, (close_li % 401 - 200) / 100.0::DOUBLE AS s FROM quotes),
        g AS (SELECT *, CASE WHEN abs(c) > 3 THEN 2.0 WHEN abs(c) > 0.5 THEN 1.0 ELSE 0 END::DOUBLE * sign(c) + CASE WHEN r > 70 THEN -0.5 WHEN r < 30 THEN 0.5 ELSE 0 END::DOUBLE + CASE WHEN v > 1.5 THEN 0.5 WHEN v < 0.7 THEN -0.5 ELSE 0 END::DOUBLE AS score FROM q),
        h AS (SELECT ts_code, trade_date, s, score, horizon, no, rise, fall, {pick(0)} AS up, {pick(1)} AS flat, {pick(2)} AS down FROM g, (VALUES {rows}) AS t(horizon, no, added, rise, fall)),
        p0 AS (SELECT *, (up * rise + down * fall)::DOUBLE AS expected_move FROM h)"""
    ]
    for n, (k, scale, weights, band) in enumerate(trend.FACTORS.values()):
        w = "CASE no " + " ".join(f"WHEN {i} THEN {x}::DOUBLE" for i, x in enumerate(weights)) + " END"
        keep = "ts_code, trade_date, s, score, horizon, no, expected_move"
        steps.append(
            f"""a{n} AS (SELECT *, (s = 0 OR abs(s) < {band}) AS still, {k}::DOUBLE * s / {scale} * {w} AS d FROM p{n}),
            b{n} AS (SELECT *, greatest(0.05::DOUBLE, least(0.9::DOUBLE, up + d)) AS u1, greatest(0.05::DOUBLE, least(0.9::DOUBLE, down - d)) AS d1 FROM a{n}),
            c{n} AS (SELECT *, u1 / (greatest(u1 + d1, 0.95::DOUBLE) / 0.95::DOUBLE) AS u2, d1 / (greatest(u1 + d1, 0.95::DOUBLE) / 0.95::DOUBLE) AS d2 FROM b{n}),
            e{n} AS (SELECT *, greatest(1 - u2 - d2, 0.05::DOUBLE) AS f2 FROM c{n}),
            p{n + 1} AS (SELECT {keep}, CASE WHEN still THEN up ELSE u2 / (u2 + d2 + f2) END AS up, CASE WHEN still THEN flat ELSE f2 / (u2 + d2 + f2) END AS flat, CASE WHEN still THEN down ELSE d2 / (u2 + d2 + f2) END AS down FROM e{n})"""
        )
    numbers = ", ".join(r6(x, name) for x, name in (("score", "score"), ("expected_move", "expected_move"), ("up", "prob_up"), ("down", "prob_down"), ("flat", "prob_flat")))
    return f"WITH {QUOTES}, {', '.join(steps)} SELECT ts_code, {day('trade_date')}, horizon, {numbers} FROM p{len(trend.FACTORS)}"


@query("c20_outlook", _outlook_sql())
def c20_outlook(spark, d):
    """Score, expected move and the three probabilities of each horizon, after all adjustments."""
    return _outlook(spark, d).select("ts_code", "trade_date", "horizon", "score", "expected_move", "prob_up", "prob_down", "prob_flat")


@query("c22_rating", "SELECT p_partkey, CASE WHEN x >= 30 THEN 'strong buy' WHEN x >= 15 THEN 'buy' WHEN x >= 5 THEN 'accumulate' WHEN x > -5 THEN 'hold' WHEN x > -15 THEN 'reduce' ELSE 'sell' END AS rating FROM (SELECT p_partkey, p_size - 25 AS x FROM part)")
def c22_rating(spark, d):
    return c.table(spark, d, "part").select("p_partkey", trend.rating(F.col("p_size") - 25).alias("rating"))


@query("c23_lockups", f"WITH {BARS} SELECT ts_code, {day('trade_date')}, CASE WHEN trade_date < DATE '1996-06-30' THEN 'history' ELSE 'upcoming' END AS \"window\" FROM bars WHERE trade_date BETWEEN DATE '1996-06-30' - 365 AND DATE '1996-06-30' + 365")
def c23_lockups(spark, d):
    return risk.lockups(c.daily_bars(spark, d), "1996-06-30", day="trade_date").select("ts_code", "trade_date", "window")


@query("c24_holder_trades", f"WITH {FLOWS}, l AS (SELECT * FROM flows WHERE trade_date <= DATE '1997-01-01' AND trade_date > DATE '1997-01-01' - 365 QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 30) SELECT ts_code, count(*) AS trades, count(*) FILTER (WHERE net_mf_vol < 0) AS sells, {day('max(trade_date) FILTER (WHERE net_mf_vol < 0)', 'latest_sell')}, {day('max(trade_date)', 'latest_trade')} FROM l GROUP BY 1")
def c24_holder_trades(spark, d):
    return risk.holder_trades(c.money_flow(spark, d), "1997-01-01", day="trade_date", change="net_mf_vol")


@query("c26_positions", f"SELECT l_orderkey, l_linenumber, {r6('l_quantity * 12.5 - l_quantity * 10', 'pnl')}, {r6('(l_quantity * 12.5 - l_quantity * 10) * 100 / (l_quantity * 10)', 'pnl_pct')}, {r6('l_quantity * 12.5 / 1000000', 'exposure')}, CAST(floor(least(1000000 * 0.1, l_extendedprice) / l_quantity / 100) * 100 AS BIGINT) AS lot FROM lineitem WHERE l_quantity > 0")
def c26_positions(spark, d):
    rows = c.table(spark, d, "lineitem").filter("l_quantity > 0").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.lit(10.0).alias("cost_price"), F.lit(12.5).alias("price"), "l_extendedprice")
    out = risk.positions(rows, total_assets=1_000_000.0)
    return out.select("l_orderkey", "l_linenumber", "pnl", "pnl_pct", "exposure", risk.lot_size(F.lit(1_000_000), 0.1, F.col("l_extendedprice"), F.col("quantity")).alias("lot"))


@query("c28_signal_rows", "SELECT vec_id AS symbol, '2024-01-02 00:00:00' AS as_of_time, CASE WHEN label > 4 THEN 'up' WHEN label < 4 THEN 'down' ELSE 'flat' END AS direction, round((label - 4) / 100.0::DOUBLE, 6) + 0.0 AS expected_return, round(label / 50.0::DOUBLE, 6) + 0.0 AS expected_volatility FROM embeddings")
def c28_signal_rows(spark, d):
    v = c.table(spark, d, "embeddings").select("vec_id", ((F.col("label") - 4) / 100.0).alias("mu"), (F.col("label") / -50.0).alias("sigma"))
    return signals.signal_rows(v, symbol="vec_id", at="2024-01-02", mean="mu", deviation="sigma", frequency="1d", horizon="1w").select("symbol", "as_of_time", "direction", "expected_return", "expected_volatility")


@query("c29_indicator_pivot", "SELECT period, CAST(sum(v) FILTER (WHERE p_brand = 'A') AS BIGINT) AS \"A\", CAST(sum(v) FILTER (WHERE p_brand = 'B') AS BIGINT) AS \"B\" FROM (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'B' END AS p_brand, period, CASE period WHEN 'q1' THEN p_partkey WHEN 'q2' THEN p_partkey * 2 ELSE p_partkey * 3 END AS v FROM part, (VALUES ('q1'), ('q2'), ('q3')) AS t(period)) GROUP BY 1")
def c29_indicator_pivot(spark, d):
    k = c.table(spark, d, "part").groupBy(F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("B").alias("indicator")).agg(F.sum("p_partkey").alias("q1"), F.sum(F.col("p_partkey") * 2).alias("q2"), F.sum(F.col("p_partkey") * 3).alias("q3"))
    return signals.indicator_pivot(k, ["q1", "q2", "q3"], ["A", "B"])


# --- quality and coverage -------------------------------------------------------------------------------------------
def _frame(spark, d) -> DataFrame:
    li = lambda k: (F.col(f"{k}_li") / 1000.0).alias(k)
    return c.daily_bars(spark, d).select(F.col("trade_date").alias("datetime"), F.col("ts_code").alias("instrument"), li("open"), li("high"), li("low"), li("close"), F.col("volume_hand").alias("volume"))


FRAME = f"{BARS}, f AS (SELECT trade_date AS datetime, ts_code AS instrument, close_li / 1000.0::DOUBLE AS close, volume_hand AS volume FROM bars)"


@query("q1_validate", f"WITH {FRAME} SELECT count(*) AS rows, {day('min(datetime)', 'first_time')}, {day('max(datetime)', 'last_time')}, count(DISTINCT instrument) AS instruments, count(*) - count(DISTINCT (instrument, datetime)) AS duplicate_keys, 7 AS columns, count(*) FILTER (WHERE close IS NULL) AS close_nulls FROM f")
def q1_validate(spark, d):
    return quality.validate(_frame(spark, d)).select("rows", "first_time", "last_time", "instruments", "duplicate_keys", "columns", "close_nulls")


@query("q3_missing_dates", f"WITH {FRAME}, {CALENDAR}, m AS (SELECT instrument, cal_date, row_number() OVER (PARTITION BY instrument ORDER BY cal_date) AS r FROM (SELECT DISTINCT instrument FROM f) i, (SELECT cal_date FROM calendar WHERE is_trading) k WHERE NOT EXISTS (SELECT 1 FROM f x WHERE x.instrument = i.instrument AND x.datetime = k.cal_date)) SELECT instrument, count(*) AS missing, string_agg(CAST(cal_date AS VARCHAR), ',' ORDER BY cal_date) FILTER (WHERE r <= 10) AS first_missing FROM m GROUP BY 1")
def q3_missing_dates(spark, d):
    return quality.missing_dates(_frame(spark, d), c.calendar(spark, d).filter("is_trading"))


@query("q4_fill_suspension", f"WITH {FRAME}, h AS (SELECT datetime, instrument, CASE WHEN day(datetime) % 5 > 0 THEN close END AS close, CASE WHEN day(datetime) % 5 > 0 THEN volume END AS volume FROM f) SELECT {day('datetime')}, instrument, {r6('last_value(close IGNORE NULLS) OVER (PARTITION BY instrument ORDER BY datetime)', 'close')}, coalesce(volume, 0) AS volume FROM h")
def q4_fill_suspension(spark, d):
    on = F.dayofmonth("datetime") % 5 > 0
    rows = _frame(spark, d)
    rows = rows.withColumns({k: F.when(on, F.col(k)) for k in ("open", "high", "low", "close", "volume")})
    return quality.fill_suspension(rows).select("datetime", "instrument", "close", "volume")


@query("q6_column_stats", f"WITH {FRAME} SELECT 'close' AS \"column\", 'double' AS dtype, count(close) AS count, {r6('min(close)', 'min')}, {r6('max(close)', 'max')}, round(avg(close), 4) + 0.0 AS mean, CAST(0 AS BIGINT) AS nulls FROM f UNION ALL SELECT 'volume', 'bigint', count(volume), min(volume)::DOUBLE, max(volume)::DOUBLE, round(avg(volume), 4) + 0.0, 0 FROM f")
def q6_column_stats(spark, d):
    return quality.column_stats(_frame(spark, d), ["close", "volume"]).select("column", "dtype", "count", "min", "max", F.round("mean", 4).alias("mean"), "nulls")


@query("q7_price_anomalies", f"WITH {FRAME}, p AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS pct_change FROM f) SELECT instrument, {day('p.datetime', 'datetime')}, {r6('close')}, {r6('pct_change')}, 1 AS kind FROM p WHERE abs(pct_change) > 0.21 ORDER BY p.instrument, p.datetime LIMIT 1000")
def q7_price_anomalies(spark, d):
    return quality.price_anomalies(_frame(spark, d))


@query("q8_volume_anomalies", f"WITH {FRAME} SELECT instrument, {day('f.datetime', 'datetime')}, volume FROM f QUALIFY volume > avg(volume) OVER (PARTITION BY instrument) + 3 * stddev_samp(volume) OVER (PARTITION BY instrument) ORDER BY f.instrument, f.datetime LIMIT 1000")
def q8_volume_anomalies(spark, d):
    return quality.volume_anomalies(_frame(spark, d), k=3.0).select("instrument", "datetime", "volume")


@query("q10_report", f"WITH {FRAME}, {CALENDAR}, p AS (SELECT *, close / lag(close) OVER (PARTITION BY instrument ORDER BY datetime) - 1 AS pc FROM f), s AS (SELECT count(*) AS rows, count(DISTINCT instrument) AS instruments, count(*) FILTER (WHERE abs(pc) > 0.21 OR close <= 0) AS anomalies, (SELECT count(*) FROM calendar WHERE is_trading) AS days FROM p), k AS (SELECT *, least(1, rows / (days * instruments)) AS coverage FROM s) SELECT rows, instruments, days, anomalies, {r6('coverage')}, {r6('greatest(0, least(100, 100 - (1 - coverage) * 100 - least(10, anomalies / rows * 1000)))', 'score')} FROM k")
def q10_report(spark, d):
    return quality.report(_frame(spark, d), c.calendar(spark, d).filter("is_trading")).select("rows", "instruments", "days", "anomalies", "coverage", "score")


@query("q11_source_check", f"WITH {FACTORS}, k AS (SELECT ts_code, trade_date, CASE WHEN ts_code LIKE '%.BJ' THEN 1 ELSE adj_factor END AS adj_factor FROM factors WHERE day(trade_date) > 2) SELECT count(*) AS bars, count(DISTINCT ts_code) AS codes, {day('min(trade_date)', 'first_day')}, {day('max(trade_date)', 'last_day')}, count(adj_factor) AS with_factor, count(*) FILTER (WHERE close_li <= 0) AS not_positive, {r6('min(adj_factor)', 'least_factor')}, {r6('max(adj_factor)', 'largest_factor')}, (SELECT count(*) FROM (SELECT ts_code FROM k GROUP BY 1 HAVING min(adj_factor) = 1 AND max(adj_factor) = 1)) AS all_ones, {r6('count(adj_factor) / CAST(count(*) AS DOUBLE)', 'factor_coverage')} FROM bars LEFT JOIN k USING (ts_code, trade_date)")
def q11_source_check(spark, d):
    f = c.adj_factor(spark, d).filter(F.dayofmonth("trade_date") > 2)
    f = f.withColumn("adj_factor", F.when(F.col("ts_code").endswith(".BJ"), 1.0).otherwise(F.col("adj_factor")))
    return quality.source_check(c.daily_bars(spark, d), f)


@query("q12_consistency", f"WITH {BARS}, e AS (SELECT abs(amount_li - close_li * volume_hand) / CAST(amount_li AS DOUBLE) AS e FROM bars) SELECT count(*) AS rows, {r6('max(e)', 'max_error')}, {r6('median(e)', 'median_error')} FROM e")
def q12_consistency(spark, d):
    b = c.daily_bars(spark, d).withColumn("value", F.col("amount_li"))
    derived = b.withColumn("value", F.col("close_li").cast("long") * F.col("volume_hand"))
    return quality.consistency(b, derived, keys=["ts_code", "trade_date"], value="value")


DATA = "x AS (SELECT * FROM bars WHERE month(trade_date) % 5 > 0)"


def _data(spark, d) -> DataFrame:
    return c.daily_bars(spark, d).filter(F.month("trade_date") % 5 > 0)


@query("q13_gap_ranges", f"WITH {BARS}, {CALENDAR}, {DATA}, m AS (SELECT cal_date FROM calendar WHERE is_trading AND cal_date NOT IN (SELECT trade_date FROM x)), i AS (SELECT cal_date, cal_date - CAST(row_number() OVER (ORDER BY cal_date) AS INTEGER) AS i FROM m) SELECT {day('min(cal_date)', 'first_day')}, {day('max(cal_date)', 'last_day')}, count(*) AS days FROM i GROUP BY i")
def q13_gap_ranges(spark, d):
    return coverage.gap_ranges(c.calendar(spark, d), _data(spark, d), time="trade_date")


@query("q13_gap_report", f"WITH {BARS}, {CALENDAR}, {DATA}, t AS (SELECT cal_date FROM calendar WHERE is_trading AND cal_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'), y AS (SELECT * FROM x WHERE trade_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') SELECT (SELECT count(*) FROM t) AS trading_days, (SELECT count(*) FROM t WHERE cal_date IN (SELECT trade_date FROM y)) AS covered_days, (SELECT count(DISTINCT ts_code) FROM y) AS symbols, (SELECT count(*) FROM t WHERE cal_date NOT IN (SELECT trade_date FROM y)) AS missing_days, (SELECT count(DISTINCT i) FROM (SELECT cal_date - CAST(row_number() OVER (ORDER BY cal_date) AS INTEGER) AS i FROM t WHERE cal_date NOT IN (SELECT trade_date FROM y))) AS gap_ranges")
def q13_gap_report(spark, d):
    return coverage.gap_report(c.calendar(spark, d), _data(spark, d), time="trade_date", symbol="ts_code", start="1995-01-01", end="1996-12-31")


@query("q14_next_load", f"WITH {BARS}, {CALENDAR}, b AS (SELECT max(trade_date) AS m FROM bars WHERE trade_date < DATE '1996-06-01') SELECT {day('(SELECT min(cal_date) FROM calendar WHERE is_trading AND cal_date > m)', 'start_day')}, {day('(SELECT max(cal_date) FROM calendar WHERE is_trading AND cal_date <= DATE ' + chr(39) + '1996-07-07' + chr(39) + ')', 'end_day')}, {day('m', 'last_day')} FROM b")
def q14_next_load(spark, d):
    rows = c.daily_bars(spark, d).filter(F.col("trade_date") < F.lit("1996-06-01").cast("date"))
    return coverage.next_load(c.calendar(spark, d), rows, "1996-07-07", time="trade_date")


@query("q15_index_coverage", f"WITH {BARS}, {CALENDAR}, s AS (SELECT ts_code, min(trade_date) AS a, max(trade_date) AS b, count(*) AS days FROM bars GROUP BY 1) SELECT ts_code, {day('a', 'first_day')}, {day('b', 'last_day')}, days, b - a + 1 - days AS natural_missing, (SELECT count(*) FROM calendar WHERE is_trading AND cal_date BETWEEN a AND b) - (SELECT count(*) FROM bars x JOIN calendar ON cal_date = x.trade_date WHERE is_trading AND x.ts_code = s.ts_code) AS trading_missing FROM s")
def q15_index_coverage(spark, d):
    return coverage.index_coverage(c.daily_bars(spark, d), c.calendar(spark, d), symbol="ts_code", time="trade_date")


@query("a22_group_stats", "SELECT event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_time, count(*) AS rows, count(DISTINCT user_id) AS distinct_values FROM events GROUP BY 1")
def a22_group_stats(spark, d):
    return coverage.group_stats(c.table(spark, d, "events"), key="event_type", time="ts", distinct="user_id")


@query("a23_dataset_stats", f"WITH {BARS}, {FLOWS} SELECT 'bars' AS dataset, {day('min(trade_date)', 'first_day')}, {day('max(trade_date)', 'last_day')}, count(*) AS rows FROM bars UNION ALL SELECT 'flows', CAST(min(trade_date) AS VARCHAR), CAST(max(trade_date) AS VARCHAR), count(*) FROM flows")
def a23_dataset_stats(spark, d):
    return coverage.dataset_stats({"bars": (c.daily_bars(spark, d), "trade_date"), "flows": (c.money_flow(spark, d), "trade_date")})


@query("a25_rows_per_day", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS trade_date, count(*) AS rows FROM events GROUP BY 1")
def a25_rows_per_day(spark, d):
    return coverage.rows_per_day(c.table(spark, d, "events"), time="ts")


# --- sorts and pages ------------------------------------------------------------------------------------------------
@query("o2_both_ends", f"WITH {QUOTES}, l AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1), r AS (SELECT ts_code, pct_chg, row_number() OVER (ORDER BY pct_chg DESC NULLS LAST, ts_code) AS a, row_number() OVER (ORDER BY pct_chg ASC NULLS LAST, ts_code) AS b FROM l) SELECT ts_code, {r6('pct_chg')}, 'top' AS side, CAST(a AS INTEGER) AS rank FROM r WHERE a <= 10 UNION ALL SELECT ts_code, {r6('pct_chg')}, 'bottom', CAST(b AS INTEGER) FROM r WHERE b <= 10")
def o2_both_ends(spark, d):
    last = windows.latest(c.quotes(spark, d), key="ts_code", order=[F.desc("trade_date")])
    return signals.both_ends(last, value="pct_chg", tie="ts_code").select("ts_code", "pct_chg", "side", "rank")


@query("o3_page", "SELECT c_custkey, c_name, c_acctbal, (SELECT count(*) FROM customer) AS total FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 20 OFFSET 40")
def o3_page(spark, d):
    rows = c.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return signals.page(rows, "balance", allowed={"name": "c_name", "balance": "c_acctbal"}, tie="c_custkey", offset=40, limit=20)


@query("o4_newest_news", f"WITH {NEWS} SELECT id, source, {ts('publish_time')}, title FROM news WHERE source = 'src3' ORDER BY news.publish_time DESC, id DESC LIMIT 20 OFFSET 5")
def o4_newest_news(spark, d):
    return signals.newest(c.news(spark, d), time="publish_time", tie="id", limit=20, offset=5, source="src3").select("id", "source", "publish_time", "title")


@query("o5_latest_n", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def o5_latest_n(spark, d):
    return windows.latest(c.table(spark, d, "orders"), 3, key="o_custkey", order=[F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("o12_latest_open_day", f"WITH {CALENDAR} SELECT {day('max(cal_date)', 'cal_date')} FROM calendar WHERE is_trading AND cal_date <= DATE '1996-07-07'")
def o12_latest_open_day(spark, d):
    return coverage.latest_open_day(c.calendar(spark, d), "1996-07-07")


# --- sinks and streams ----------------------------------------------------------------------------------------------
@query("k1_upsert", f"WITH {BARS} SELECT ts_code, {day('trade_date')}, CASE WHEN month(trade_date) = 6 THEN close_li + 1 ELSE close_li END AS close_li FROM bars")
def k1_upsert(spark, d):
    """Bars are stored, June comes again with other closes, twice; the table is read back."""
    rows = c.daily_bars(spark, d).select("ts_code", "trade_date", "close_li")
    rows = rows.withColumn("month", F.date_trunc("month", "trade_date").cast("date"))
    table = sinks.Table(spark, scratch(spark, "upsert"))
    june = rows.filter(F.month("trade_date") == 6).withColumn("close_li", F.col("close_li") + 1)
    for part in (rows, june, june):
        table.put(part, ["ts_code", "trade_date"], partition="month")
    return table.read().select("ts_code", "trade_date", "close_li")


@query("k1_upsert_versions", f"WITH {BARS} SELECT ts_code, {day('trade_date')}, CASE WHEN month(trade_date) = 6 THEN close_li + 1 ELSE close_li END AS close_li FROM bars")
def k1_upsert_versions(spark, d):
    """The same in a table of versions, where a delta names some keys twice and the larger order wins."""
    rows = c.daily_bars(spark, d).select("ts_code", "trade_date", "close_li").withColumn("n", F.lit(1))
    table = sinks.Table(spark, scratch(spark, "versions"))
    table.upsert(rows, ["ts_code", "trade_date"])
    june = rows.filter(F.month("trade_date") == 6)
    twice = june.withColumn("n", F.lit(2)).withColumn("close_li", F.col("close_li") + 1).unionByName(june.withColumn("close_li", F.lit(0)))
    table.upsert(twice, ["ts_code", "trade_date"], order="n")
    return table.read().drop("n")


@query("k2_insert_absent", f"WITH {NEWS}, k AS (SELECT id, source, external_id FROM news WHERE id % 2 = 0 OR external_id IS NULL OR (source, external_id) NOT IN (SELECT source, external_id FROM news WHERE id % 2 = 0 AND external_id IS NOT NULL)) SELECT source, external_id, count(*) AS rows FROM (SELECT * FROM k WHERE external_id IS NULL UNION ALL SELECT * FROM k WHERE id % 2 = 0 AND external_id IS NOT NULL UNION ALL SELECT any_value(id), source, external_id FROM k WHERE id % 2 = 1 AND external_id IS NOT NULL GROUP BY 2, 3) GROUP BY 1, 2")
def k2_insert_absent(spark, d):
    n = c.news(spark, d).select("id", "source", "external_id")
    base, delta = n.filter("id % 2 = 0"), n.filter("id % 2 = 1")
    fresh = sinks.absent(base, delta, ["source", "external_id"])
    return base.unionByName(fresh).groupBy("source", "external_id").agg(F.count("*").alias("rows"))


@query("k4_snapshot_spans", f"WITH {BARS} SELECT ts_code AS instrument, {day('min(trade_date)', 'first_day')}, {day('max(trade_date)', 'last_day')} FROM bars GROUP BY 1")
def k4_snapshot_spans(spark, d):
    return sinks.instrument_spans(c.daily_bars(spark, d), symbol="ts_code", time="trade_date").withColumnRenamed("ts_code", "instrument")


@query("k7_resume", f"WITH {BARS}, s AS (SELECT ts_code, DATE '1996-01-01' + CAST(right(split_part(ts_code, '.', 1), 2) AS INTEGER) AS l FROM (SELECT DISTINCT ts_code FROM bars) WHERE ts_code LIKE '%.SH') SELECT ts_code, {day('trade_date')}, close_li FROM bars LEFT JOIN s USING (ts_code) WHERE trade_date >= DATE '1995-06-01' AND (l IS NULL OR trade_date > l)")
def k7_resume(spark, d):
    rows = c.daily_bars(spark, d)
    n = F.substring("ts_code", 5, 2).cast("int")
    state = rows.select("ts_code").distinct().filter(F.col("ts_code").endswith(".SH")).select("ts_code", F.date_add(F.lit("1996-01-01").cast("date"), n).alias("last_success"))
    return sinks.resume(rows, state, symbol="ts_code", requested="1995-06-01").select("ts_code", "trade_date", "close_li")


@query("k10_latest_capture", "SELECT o_orderpriority AS data_type, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS data_date, o_orderkey AS version FROM orders WHERE o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1")
def k10_latest_capture(spark, d):
    o = c.table(spark, d, "orders").select(F.col("o_orderpriority").alias("data_type"), F.to_date("o_orderdate").alias("data_date"), F.col("o_orderkey").alias("version"), (F.col("o_orderstatus") == "F").alias("fetch_success"))
    return sinks.latest_capture(o).select("data_type", "data_date", "version")


@query("k13_news_dedup", f"WITH {NEWS} SELECT min(id) AS id, source, {ts('publish_time')} FROM news GROUP BY source, publish_time, coalesce(external_id, '')")
def k13_news_dedup(spark, d):
    return sinks.first_stored(c.news(spark, d)).select("id", "source", "publish_time")


@query("x1_tick_stream", f"WITH {BUCKETS} SELECT symbol, {ts('bucket_start_time')}, buy_volume, sell_volume, neutral_volume, total_volume, trade_count FROM buckets")
def x1_tick_stream(spark, d):
    """Ticks as a stream of four files, a micro-batch each, in update mode into a table kept by day."""
    folder = scratch(spark, "ticks")
    c.ticks(spark, d).repartition(4).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(c.TICKS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    table = sinks.Table(spark, f"{folder}/buckets")
    put = lambda batch, n: table.put(batch.withColumn("date", F.to_date("bucket_start_time")), ["symbol", "bucket_start_time"], partition="date")
    run = streams.tick_stream(stream, delay="60 days").writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return table.read().drop("date")


@query("x3_news_stream", f"WITH {NEWS}, k AS (SELECT DISTINCT source, coalesce(external_id, 'title:' || coalesce(title, '')) AS k, publish_time FROM news) SELECT source, count(*) AS items, count(*) AS ids FROM k GROUP BY 1")
def x3_news_stream(spark, d):
    """The same news twice: each item comes out once."""
    folder = scratch(spark, "news")
    n = c.news(spark, d).drop("content")
    n.write.parquet(f"{folder}/in")
    n.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(n.schema).parquet(f"{folder}/in")
    run = streams.news_stream(stream, "60 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(n.schema).parquet(f"{folder}/out").groupBy("source").agg(F.count("*").alias("items"), F.countDistinct("id").alias("ids"))


@query(
    "x4_alerts",
    f"""WITH RECURSIVE {TICKS}, t AS (SELECT symbol, time, price_li / 100.0::DOUBLE AS p FROM ticks), m AS (SELECT symbol, quantile_cont(p, 0.4) AS a, quantile_cont(p, 0.6) AS b, quantile_cont(p, 0.95) AS c, quantile_cont(p, 0.05) AS d FROM t GROUP BY 1),
    f AS (SELECT symbol, time, p, unnest(list_filter([CASE WHEN p BETWEEN a AND b THEN 'entry' END, CASE WHEN p >= c THEN 'take_profit' END, CASE WHEN p <= d THEN 'stop_loss' END], lambda x: x IS NOT NULL)) AS kind FROM t JOIN m USING (symbol)),
    r AS (SELECT symbol, kind, min(time) AS time FROM f GROUP BY 1, 2 UNION ALL SELECT r.symbol, r.kind, min(f.time) FROM r JOIN f ON f.symbol = r.symbol AND f.kind = r.kind AND f.time >= r.time + INTERVAL 60 MINUTE GROUP BY r.symbol, r.kind)
    SELECT r.symbol, r.kind, {ts("r.time", "time")}, {r6("min(f.p)", "price")} FROM r JOIN f USING (symbol, kind, time) GROUP BY r.symbol, r.kind, r.time""",
)
def x4_alerts(spark, d):
    """Ticks as quotes against a monitor for each symbol; each kind at most once in an hour."""
    t = c.ticks(spark, d).select("symbol", "time", (F.col("price_li") / 100.0).alias("price"))
    monitors = t.groupBy("symbol").agg(F.percentile("price", 0.4).alias("entry_min"), F.percentile("price", 0.6).alias("entry_max"), F.percentile("price", 0.95).alias("take_profit"), F.percentile("price", 0.05).alias("stop_loss")).withColumn("notification_enabled", F.lit(True))
    return streams.alerts(streams.triggers(t, monitors))


@query("x6_due", "SELECT c_custkey FROM customer WHERE c_custkey % 9 = 0 OR (c_custkey % 120) + (c_custkey % 60) <= 100")
def x6_due(spark, d):
    at = F.timestamp_seconds(F.lit(1704067200) + (F.col("c_custkey") % 120) * 60)
    rows = c.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, at).alias("last_checked"), (F.col("c_custkey") % 60).cast("int").alias("check_interval"))
    return streams.due(rows, "2024-01-01 01:40:00").select("c_custkey")
