"""Registered queries of stores that are only added to, and of streams whose state outlives a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, signals, universe, windows
from ..sources import contracts as c
from ..sources import scans, sinks
from ..streaming import streams
from . import market_more
from .market import plain
from .market_more import scratch
from .sql import BARS, NEWS, code, day, r6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return f

    return add


KEYED = f"""{NEWS}, keyed AS (SELECT *, coalesce(external_id, 'title:' || coalesce(title, '')) AS dedup_id FROM news),
    k AS (SELECT source, dedup_id, publish_time, bool_or(id % 2 = 0) AS early FROM keyed GROUP BY ALL)"""


def _news(spark: SparkSession, d: str) -> DataFrame:
    n = c.news(spark, d).select("id", "source", "external_id", "publish_time", "title")
    return n.withColumn("dedup_id", F.coalesce("external_id", F.concat(F.lit("title:"), F.coalesce("title", F.lit(""))))).withColumn("day", F.to_date("publish_time"))


@query(
    "k2_append_only",
    f"""WITH {KEYED}, later AS (SELECT source, dedup_id, publish_time + INTERVAL 1000 DAY FROM k)
    SELECT 'stored' AS what, source AS name, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'stored', 'later', count(*) FROM later
    UNION ALL SELECT 'rows', '1', count(*) FILTER (WHERE early) FROM k UNION ALL SELECT 'rows', '2', 0 UNION ALL SELECT 'rows', '3', count(*) FILTER (WHERE NOT early) FROM k
    UNION ALL SELECT 'rows', '4', count(*) FROM later UNION ALL SELECT 'files written', '2', 0 UNION ALL SELECT 'files read', '4', 0""",
)
def k2_append_only(spark, d):
    """Half of the news, the same again, all of them, then news of other days: what was added, and that a repeat writes
    no file and other days read none."""
    store, news = streams.news_store(spark, scratch(spark, "append")), _news(spark, d)
    half = news.filter("id % 2 = 0")
    later = news.withColumns({"publish_time": F.col("publish_time") + F.expr("INTERVAL 1000 DAY"), "source": F.lit("later"), "dedup_id": F.concat("source", F.lit(" "), "dedup_id")})
    done = [store.insert(x) for x in (half, half, news, later.withColumn("day", F.to_date("publish_time")))]
    notes = [("rows", str(i), x.rows) for i, x in enumerate(done, 1)] + [("files written", "2", done[1].files_written), ("files read", "4", done[3].files_read)]
    stored = store.read().groupBy(F.lit("stored").alias("what"), F.col("source").alias("name")).agg(F.count("*").alias("n"))
    return stored.unionByName(spark.createDataFrame(notes, "what string, name string, n long"))


@query(
    "k11_drop_days",
    f"""WITH {KEYED} SELECT CAST(CAST(publish_time AS DATE) AS VARCHAR) AS day, count(*) AS items, 0 AS added FROM k WHERE publish_time >= TIMESTAMP '2024-01-04' GROUP BY 1""",
)
def k11_drop_days(spark, d):
    """Old days are dropped by name; inserting everything again adds none of them."""
    store, news = streams.news_store(spark, scratch(spark, "retention")), _news(spark, d)
    store.insert(news)
    store.keep_since("2024-01-04")
    again = store.insert(news)
    return store.read().groupBy("day").agg(F.count("*").alias("items"), F.lit(again.rows).alias("added"))


@query("x3_news_once", f"WITH {KEYED} SELECT source, count(*) AS items, count(*) AS ids, 0 AS added_by_repeats FROM k GROUP BY 1")
def x3_news_once(spark, d):
    """A stream of news that stops and starts again; repeats come in later micro-batches, when the state that knew them
    is gone, and are not stored again. Each run takes the files that one write left, however many there are."""
    folder = scratch(spark, "news-once")
    news, store = c.news(spark, d).select("id", "source", "external_id", "publish_time", "title"), streams.news_store(spark, f"{folder}/stored")
    pieces = []
    for part in (news.filter("id % 2 = 0"), news, news):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(news.schema).parquet(f"{folder}/in")
        run = streams.news_stream(stream, "0 seconds").writeStream.foreachBatch(streams.news_sink(store)).option("checkpointLocation", f"{folder}/checkpoint")
        run.trigger(availableNow=True).start().awaitTermination()
        pieces.append(store.pieces())
    stored = store.read().groupBy("source").agg(F.count("*").alias("items"), F.countDistinct("source", "dedup_id", "publish_time").alias("ids"))
    return stored.withColumn("added_by_repeats", F.lit(pieces[2] - pieces[1]))


@query("x4_alert_stream", market_more.ORACLES["x4_alerts"])
def x4_alert_stream(spark, d):
    """Ticks out of order in four parts of many files, stopped after each and started again with open state; then late
    ticks, which are left out, and a quote of an unknown stock that moves the watermark past all others."""
    folder = scratch(spark, "alerts")
    ticks = c.ticks(spark, d).select("symbol", "time", (F.col("price_li") / 100.0).alias("price"), "seq")
    monitors = ticks.groupBy("symbol").agg(F.percentile("price", 0.4).alias("entry_min"), F.percentile("price", 0.6).alias("entry_max"), F.percentile("price", 0.95).alias("take_profit"), F.percentile("price", 0.05).alias("stop_loss")).withColumn("notification_enabled", F.lit(True))
    low, high = ticks.agg(F.unix_micros(F.min("time")), F.unix_micros(F.max("time"))).first()
    file = F.floor((F.unix_micros("time") - low + (F.col("seq") % 5) * 100_000_000) * 4 / (high - low + 500_000_000))  # up to 400 seconds out of order
    late = ticks.filter(file == 0).withColumn("time", F.col("time") - F.expr("INTERVAL 1 DAY"))
    clock = ticks.limit(1).select(F.lit("unknown").alias("symbol"), F.timestamp_micros(F.lit(high + 86_400_000_000)).alias("time"), F.lit(0.0).alias("price"), F.lit(0).cast("long").alias("seq"))
    parts = [ticks.filter(file == i) for i in range(4)]
    for part in (*parts, late, clock):
        part.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(ticks.schema).parquet(f"{folder}/in")
        with streams.keyed_state(spark):
            run = streams.alert_stream(stream, monitors).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            run.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("symbol string, kind string, time timestamp, price double").parquet(f"{folder}/out").withColumn("price", F.round("price", 6))


# --- snapshots, ranks, pages, medians, search -----------------------------------------------------------------------
@query(
    "k5_three_appends",
    f"""WITH {BARS}, s AS (SELECT ts_code, min(trade_date) AS a, max(trade_date) AS b, count(*) AS n FROM bars WHERE trade_date < DATE '1998-07-01' GROUP BY 1)
    SELECT 'market' AS snapshot, CAST(sum(n) AS BIGINT) AS rows, {day('min(a)', 'first_day')}, {day('max(b)', 'last_day')}, CAST(sum(b - a) AS BIGINT) AS span_days,
           (SELECT count(DISTINCT trade_date) FROM bars WHERE trade_date < DATE '1998-07-01') AS calendar_days, 0 AS other_files_changed FROM s""",
)
def k5_three_appends(spark, d):
    """Bars to 1995 exported, three years appended, each of which meets rows that are there already; partitions before
    the last append keep the files they had."""
    folder = scratch(spark, "appends")
    rows = c.daily_bars(spark, d).select(F.col("ts_code").alias("instrument"), F.col("trade_date").alias("datetime"), "close_li")
    sinks.write_snapshot(rows.filter("datetime < '1996-01-01'"), folder, name="market", grain="month")
    files = lambda: {f for f in spark.read.parquet(f"{folder}/bars").inputFiles() if f.rpartition("/date=")[2][:7] < "1997-06"}
    for start, end in (("1995-07-01", "1997-01-01"), ("1996-07-01", "1997-07-01"), ("1997-06-01", "1998-07-01")):
        before = files()
        sinks.append_snapshot(rows.filter(f"datetime >= '{start}' and datetime < '{end}'"), folder, ["datetime", "instrument"], grain="month")
    changed = len(before ^ files())
    spans = spark.read.parquet(f"{folder}/instruments").agg(F.sum(F.datediff("last_day", "first_day")).alias("span_days"))
    days = spark.read.parquet(f"{folder}/calendars").agg(F.count("*").alias("calendar_days"))
    return spark.read.parquet(f"{folder}/meta").crossJoin(spans).crossJoin(days).withColumn("other_files_changed", F.lit(changed))  # one row each


@query("w21_total_rank", "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS INTEGER) AS rank FROM lineitem")
def w21_total_rank(spark, d):
    """Every row of a table ranked, without a task that holds them all."""
    rows = c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return windows.score_rank(rows, score="l_extendedprice", key="tie").select("l_orderkey", "l_linenumber", "rank")


@query("o3_deep_page", "SELECT l_orderkey, l_linenumber, l_extendedprice, (SELECT count(*) FROM lineitem) AS total FROM lineitem ORDER BY l_extendedprice, l_orderkey * 10 + l_linenumber LIMIT 50 OFFSET 5000")
def o3_deep_page(spark, d):
    rows = c.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tie"))
    return signals.page(rows, "price", allowed={"price": "l_extendedprice"}, tie="tie", offset=5000, limit=50, descending=False).drop("tie")


@query("q12_refined_median", f"SELECT count(*) AS rows, {r6('max(e)', 'max_error')}, {r6('median(e)', 'median_error')} FROM (SELECT abs(o_custkey * 100 - o_totalprice) / o_totalprice AS e FROM orders)")
def q12_refined_median(spark, d):
    """The median where counts of ranges are refined until a hundred values are left."""
    raw = c.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"), "o_custkey")
    derived = raw.withColumn("v", (F.col("o_custkey") * 100).cast("double"))
    return quality.consistency(raw, derived, keys=["o_orderkey"], value="v", few=100)


@query("p11_indexed_search", "SELECT p_partkey, p_name, true AS pruned FROM part WHERE contains(lower(p_name), 'l gizm') OR contains(lower(p_type), 'l gizm')")
def p11_indexed_search(spark, d):
    """A keyword looked up in trigram lists that were written with the table; fewer rows are looked at than there are."""
    folder, rows = scratch(spark, "search"), c.table(spark, d, "part")
    universe.search_index(rows, "p_partkey", ("p_name", "p_type")).write.parquet(folder)
    index = spark.read.parquet(folder)
    tried = universe.search_candidates(index, "L GIZM", "p_partkey").count()
    found = universe.indexed_search(rows, index, "L GIZM", "p_partkey", ("p_name", "p_type"))
    return found.select("p_partkey", "p_name", F.lit(tried < rows.count()).alias("pruned"))


# --- vendor tables --------------------------------------------------------------------------------------------------
def _vendor_kinds() -> list[tuple[str, int, str, str]]:
    """Table, place, name and kind of every field of the vendor tables."""
    return [(t, i, f.name, f.kind) for t in scans.VENDOR_TABLES for i, f in enumerate(scans.vendor_fields(t)[0])]


def _vendor_sql() -> str:
    """What is filled and its total for each field: numbers, days since 1990, or characters."""
    filled = {"string": "length({0})", "date": "(c_custkey % 1000 + {1})", "double": "CASE WHEN c_custkey % 5 <> {1} % 5 THEN (c_custkey % 97 + {1}) / 4.0 END"}
    text = lambda name: code("c_custkey") if name == "ts_code" else "c_name"
    one = [f"SELECT '{t}' AS vendor_table, '{name}' AS field, count({v}) AS filled, CAST(sum({v}) AS DOUBLE) AS total FROM c" for t, i, name, kind in _vendor_kinds() for v in [filled[kind].format(text(name), i)]]
    return "WITH c AS (SELECT * FROM customer WHERE c_custkey % 10 <> 9) " + " UNION ALL ".join(one)


@query("s16_all_vendor_tables", _vendor_sql())
def s16_all_vendor_tables(spark, d):
    """Each of the vendor tables as text, landed in typed rows; rows without a code are dropped."""
    customers, n = c.table(spark, d, "customer"), F.col("c_custkey")
    symbol = F.concat(F.lpad(n.cast("string"), 6, "0"), F.element_at(F.array(F.lit(".SZ"), F.lit(".SH"), F.lit(".BJ")), (n % 3 + 1).cast("int")))
    total = {"string": lambda x: F.length(x), "date": lambda x: F.datediff(x, F.lit("1990-01-01").cast("date")), "double": lambda x: x}
    out = None
    for name in scans.VENDOR_TABLES:
        fields, keys = scans.vendor_fields(name)
        raw = {
            "string": lambda f, i: F.when(n % 10 == 9, " ").otherwise(symbol) if f.name == "ts_code" else F.col("c_name"),
            "date": lambda f, i: F.date_format(F.date_add(F.lit("1990-01-01").cast("date"), (n % 1000 + i).cast("int")), "yyyyMMdd"),
            "double": lambda f, i: F.when(n % 5 == i % 5, "None").otherwise(((n % 97 + i) / 4.0).cast("string")),
        }
        landed = scans.land(customers.select(*(raw[f.kind](f, i).alias(f.name) for i, f in enumerate(fields))), fields, keys)
        sums = landed.agg(*(F.struct(F.count(f.name).alias("filled"), F.sum(total[f.kind](F.col(f.name))).cast("double").alias("total")).alias(f.name) for f in fields))
        rows = sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("vendor_table"), F.lit(f.name).alias("field"), F.col(f"{f.name}.filled").alias("filled"), F.col(f"{f.name}.total").alias("total")) for f in fields))).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out
