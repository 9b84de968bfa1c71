"""Small frames for behaviour that tables do not show."""

import datetime as dt
import json
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickweave.functions import codes
from tickweave.operators import bars, billboard, coverage, indicators, orderflow, prices, quality, sequences, signals, trend, universe, windows
from tickweave.sources import scans, sinks
from tickweave.streaming import streams

D = dt.date


def test_tick_bucket_by_hand(spark):
    rows = [("a", "2025-11-03 09:30:01", 10000, 5, 0, 1), ("a", "2025-11-03 09:31:00", 10100, 3, 1, 2), ("a", "2025-11-03 09:31:00", 10000, 2, 2, 3), ("a", "2025-11-03 09:35:00", 0, 1, 0, 4), ("a", "2025-11-03 09:35:10", 10000, 1, 7, 5), ("a", None, 10000, 1, 0, 6)]
    t = spark.createDataFrame(rows, "symbol string, time string, price_li bigint, volume_hand bigint, status int, seq bigint").withColumn("time", F.col("time").cast("timestamp"))
    got = {r["bucket_start_time"].minute: r for r in orderflow.tick_buckets(t).collect()}
    a, b = got[30], got[35]
    assert (a["buy_volume"], a["sell_volume"], a["neutral_volume"], a["trade_count"]) == (500, 300, 200, 3)
    assert a["order_flow_imbalance"] == pytest.approx(0.25) and a["avg_trade_size"] == pytest.approx(1000 / 3) and a["intensity"] == pytest.approx(0.6)
    assert a["realized_vol"] == pytest.approx((0.01**2 + (10000 / 10100 - 1) ** 2) ** 0.5)
    assert b["neutral_volume"] == 100 and b["realized_vol"] == 0
    assert all(r["buy_volume"] + r["sell_volume"] + r["neutral_volume"] == r["total_volume"] for r in got.values())


def test_factor_by_max_latest_and_date(spark):
    f = spark.createDataFrame([("x", D(2025, 1, d), v) for d, v in ((1, 1.0), (2, 2.0), (3, 1.5))], "ts_code string, trade_date date, adj_factor double")
    by = lambda **k: [r["factor"] for r in prices.forward_factor(f, **k).orderBy("trade_date").collect()]
    assert by() == [0.5, 1.0, 0.75]
    assert by(base="latest") == pytest.approx([1 / 1.5, 2 / 1.5, 1.0])
    assert by(base_date="2025-01-01") == [1.0, 2.0, 1.5]
    assert by(base_date="2024-01-01") == [1.0, 1.0, 1.0]


def test_strict_join_fails_on_a_missing_factor(spark):
    b = spark.createDataFrame([("x", D(2025, 1, 1), 1)], "ts_code string, trade_date date, close_li int")
    f = spark.createDataFrame([], "ts_code string, trade_date date, factor double")
    with pytest.raises(Exception, match="no factor"):
        prices.with_factor(b, f).collect()
    assert prices.with_factor(b, f, strict=False).first()["factor"] is None


def test_rsi_and_macd_against_a_loop(spark):
    values = [10 + (i * 37 % 11) - (i * 13 % 7) for i in range(60)]
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(values)], "symbol string, t int, close double")
    up = down = 0.0
    want = []
    for i, v in enumerate(values):
        change = v - values[i - 1] if i else None
        if change is not None:
            u, w = max(change, 0.0), max(-change, 0.0)
            up, down = (0.0 if i == 0 else up), (0.0 if i == 0 else down)
        else:
            u = w = 0.0
        up, down = (u, w) if i == 0 else (up + (u - up) / 14, down + (w - down) / 14)
        want.append(None if i < 13 else (100 - 100 / (1 + up / down) if down else 100.0))
    got = [r["rsi"] for r in indicators.rsi(df).orderBy("t").collect()]
    for a, b in zip(got[13:], want[13:], strict=True):
        assert a == pytest.approx(b)
    e12 = e26 = values[0]
    line = []
    for v in values:
        e12, e26 = e12 + (v - e12) * 2 / 13, e26 + (v - e26) * 2 / 27
        line.append(e12 - e26)
    got = [r["macd"] for r in indicators.macd(df).orderBy("t").collect()]
    assert got[30:] == pytest.approx(line[30:])


def test_islands_split_on_weekends_or_not(spark):
    cal = spark.createDataFrame([(D(2025, 11, 3) + dt.timedelta(i), (D(2025, 11, 3) + dt.timedelta(i)).weekday() < 5) for i in range(12)], "cal_date date, is_trading boolean")
    data = cal.filter(~F.col("cal_date").isin(D(2025, 11, 7), D(2025, 11, 10))).select(F.col("cal_date").alias("t"))
    assert coverage.gap_ranges(cal, data, time="t").count() == 2
    assert coverage.gap_ranges(cal, data, time="t", adjacent="trading").count() == 1


def test_upsert_is_idempotent_and_versions_survive(spark, tmp_path):
    t = sinks.Table(spark, f"file://{tmp_path}/t")
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    delta = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    t.upsert(base, ["k"])
    t.upsert(delta, ["k"])
    once = sorted(map(tuple, t.read().collect()))
    t.upsert(delta, ["k"])
    assert once == sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_null_keys_never_conflict(spark):
    base = spark.createDataFrame([("s", None, 1), ("s", "1", 2)], "source string, external_id string, n int")
    delta = spark.createDataFrame([("s", None, 3), ("s", "1", 4), ("s", "2", 5), ("s", "2", 6)], "source string, external_id string, n int")
    got = sinks.absent(base, delta, ["source", "external_id"])
    assert {r["external_id"] for r in got.collect()} == {None, "2"} and got.count() == 2


def test_snapshot_append_rewrites_touched_days(spark, tmp_path):
    rows = spark.createDataFrame([(D(2025, 1, d), i, float(d)) for d in (1, 2) for i in ("a", "b")], "datetime date, instrument string, v double")
    folder = f"file://{tmp_path}/snap"
    sinks.write_snapshot(rows, folder, name="x")
    sinks.append_snapshot(spark.createDataFrame([(D(2025, 1, 2), "a", 9.0), (D(2025, 1, 3), "a", 3.0)], rows.schema), folder, ["datetime", "instrument"])
    got = spark.read.parquet(f"{folder}/bars")
    assert got.count() == 5 and got.filter("instrument = 'a' and date = '2025-01-02'").first()["v"] == 9.0


def test_watermark_start(spark):
    state = spark.createDataFrame([("s", "bars", dt.datetime(2025, 1, 5, 15))], "snapshot_id string, data_type string, last_datetime timestamp")
    row = sinks.export_start(state, "s", "bars", "2025-01-10").first()
    assert row["start_day"] == D(2025, 1, 6) and not row["empty"]
    assert sinks.export_start(state, "none", "bars", "2025-01-10", back_days=7).first()["start_day"] == D(2025, 1, 3)
    assert sinks.export_start(state, "s", "bars", "2025-01-05").first()["empty"]


def test_alerts_at_59_60_and_61_minutes(spark):
    at = dt.datetime(2025, 1, 1, 9)
    found = spark.createDataFrame([("s", "entry", at + dt.timedelta(minutes=m), 1.0) for m in (0, 59, 60, 121)], "symbol string, kind string, time timestamp, price double")
    assert sorted((r["time"] - at).seconds // 60 for r in streams.alerts(found).collect()) == [0, 60, 121]


def test_alert_stream_equals_batch_over_a_restart(spark, tmp_path):
    at = dt.datetime(2025, 1, 1, 9)
    minutes = [0, 10, 61, 70, 62, 125, 119, 300, 301, 362]
    quotes = [(s, at + dt.timedelta(minutes=m), 1.0 + m % 3 / 10) for s in "ab" for m in minutes]
    schema = "symbol string, time timestamp, price double"
    monitors = spark.createDataFrame([("a", 1.0, 2.0, 9.0, 0.5, True), ("b", 1.0, 2.0, 9.0, 0.5, True)], "symbol string, entry_min double, entry_max double, take_profit double, stop_loss double, notification_enabled boolean")
    files = [quotes[:3] + quotes[10:12], quotes[3:5] + quotes[12:16], quotes[5:10] + quotes[16:], [("b", at - dt.timedelta(days=1), 1.0)], [("z", at + dt.timedelta(days=3), 1.0)]]
    for some in (files[:2], files[2:]):
        for rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with streams.keyed_state(spark):
            run = streams.alert_stream(stream, monitors, "90 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        run.awaitTermination()
    got = spark.read.schema("symbol string, kind string, time timestamp, price double").parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.alerts(streams.triggers(spark.createDataFrame(quotes, schema), monitors)).collect()))


def test_bucket_sink_equals_batch_and_replays(spark, tmp_path):
    t = spark.createDataFrame([("a", dt.datetime(2025, 1, 1, 9, 30 + i // 4, i), 100 + i % 5, 1 + i % 3, i % 3, i) for i in range(40)], "symbol string, time timestamp, price_li bigint, volume_hand bigint, status int, seq bigint")
    ticks, buckets = sinks.Table(spark, f"file://{tmp_path}/t"), sinks.Table(spark, f"file://{tmp_path}/b")
    put = streams.bucket_sink(ticks, buckets)
    for n, part in enumerate((t.filter("seq % 2 = 0"), t.filter("seq % 2 = 1"), t.filter("seq % 2 = 1"))):
        put(part, n)
    a, b = (df.select("bucket_start_time", "trade_count", F.round("realized_vol", 9)).orderBy("bucket_start_time").collect() for df in (buckets.read(), orderflow.tick_buckets(t)))
    assert a == b


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("x", c, r, v, s) for c in (-5.0, 0.0, 5.0, None) for r in (20.0, 60.0, 90.0, None) for v in (0.5, 2.0) for s in (-2.0, -0.1, 0.0, 2.0, None)], "ts_code string, pct_chg double, rsi double, volume_ratio double, s double")
    out = trend.baseline(df)
    for name in trend.FACTORS:
        out = trend.adjust(out, name, "s")
    for r in trend.spread(out).collect():
        assert r["prob_up"] + r["prob_down"] + r["prob_flat"] == pytest.approx(1)
        assert min(r["prob_up"], r["prob_down"], r["prob_flat"]) > 0.04


def test_as_of_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 8, None), ("b", 6, "z")], "k string, rt int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in sequences.as_of(left, right, key="k", time="t", right_time="rt", values=["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): "x", ("a", 9): None, ("b", 5): None}


def test_sequences_count_and_missing_feature(spark):
    df = spark.createDataFrame([("s", i, float(i + 1)) for i in range(15)], "symbol string, t int, close double")
    got = sequences.sequences(df, ["close"], 10).collect()
    assert len(got) == 5 and all(len(r["x"]) == 10 for r in got)
    with pytest.raises(ValueError):
        sequences.last_sequence(df, ["nothing"], 3)


def test_landing_minute_times_and_screening(spark):
    df = spark.createDataFrame([("09:31",), ("2025-01-02T09:31:00+08:00",), ("2025-01-02 01:31:00",), ("x",)], "t string")
    got = [r[0] for r in df.select(scans.minute_time(F.lit("2025-01-02").cast("date"), F.col("t"))).collect()]
    assert got[:3] == [dt.datetime(2025, 1, 2, 1, 31)] * 3 and got[3] is None
    body = '{"columns":[{"key":"code","title":"Code"},{"key":"g","title":"G","children":[{"key":"p","title":"Price","unit":"yuan"},{"key":"h","title":"H","hidden":true}]}],"rows":[{"code":"1","p":"2.5","h":"x"},{"code":"1","p":"9"}]}'
    rows = scans.screening_rows(spark.createDataFrame([(body,)], "b string"), response="b").collect()
    assert {(r["code"], r["title"], r["value"]) for r in rows} == {("1", "Code", "1"), ("1", "Price(yuan)", "2.5")}


def test_rows_of_a_long_response_do_not_carry_it(spark):
    head = [{"key": "code", "title": "Code"}, {"key": "v", "title": "V"}]
    bodies = [(json.dumps({"columns": head, "rows": [{"code": str(c), "v": w} for w in ("a", "b") for c in range(page, 40, 2)]}),) for page in (0, 1)]
    got = scans.screening_rows(spark.createDataFrame(bodies, "b string"), response="b")
    assert sorted(map(tuple, got.filter("key = 'v'").collect())) == sorted((str(c), "v", "V", "a") for c in range(40))
    dealt = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate posexplode" in line]
    assert len(dealt) == 1 and re.search(r"Generate posexplode\(rows#\d+\), \[heads#\d+\]", dealt[0])


def test_news_feeds(spark):
    cls = spark.createDataFrame([('{"id":"1","ctime":1700000000,"title":"t","content":"c","level":"B"}',)], "body string")
    sina = spark.createDataFrame([('{"id":"2","create_time":"2025-01-02 08:00:00","rich_text":"r","tag":[{"name":"焦点新闻"}]}',)], "body string")
    a, b = scans.news_items(cls, "cls").first(), scans.news_items(sina, "sina").first()
    assert a["is_important"] and b["is_important"] and b["publish_time"] == dt.datetime(2025, 1, 2, 0, 0)


def test_screens_skip_absent_columns(spark):
    df = spark.createDataFrame([("600000.SH", "X", 5.0), ("000001.SZ", "*ST Y", 9.0), ("430047.BJ", "Z", 1.0)], "ts_code string, name string, pct_chg double")
    kept, applied, skipped = universe.threshold_chain(universe.plain_stocks(df), [("pct_chg", 1.0, None), ("pe", 0.0, 50.0)])
    assert [r["ts_code"] for r in kept.collect()] == ["600000.SH"] and applied == ["pct_chg"] and skipped == ["pe"]


def test_latest_by_either_code(spark):
    items = spark.createDataFrame([("600000.SH",), ("000001",)], "code string")
    rows = spark.createDataFrame([("600000", 1, 1, "a"), ("600000.SH", 2, 2, "b"), ("000001", 1, 3, "c")], "code string, t int, id int, v string")
    got = {r["code"]: r["v"] for r in signals.latest_by_either_code(items, rows, time="t", tie="id", columns=["v"]).collect()}
    assert got == {"600000.SH": "b", "000001": "c"}


def test_outlier_needs_enough_rows(spark):
    df = spark.createDataFrame([("s", i, 100000 if i == 0 else 100) for i in range(121)], "symbol string, t int, volume int")
    assert windows.outliers(df, value="volume").count() == 1
    assert windows.outliers(df.limit(50), value="volume").count() == 0


def test_codes(spark):
    df = spark.createDataFrame([("600000",), ("000001",), ("430047",), ("510300",), ("12",)], "c string")
    got = df.select(codes.ingest_ts_code(F.col("c")).alias("a"), codes.app_ts_code(F.col("c")).alias("b"), codes.looks_like_etf(F.col("c")).alias("e")).collect()
    assert [r["a"] for r in got] == ["600000.SH", "000001.SZ", "430047.BJ", "510300.SZ", None]
    assert [r["b"] for r in got] == ["600000.SH", "000001.SZ", "430047.BJ", "510300.SH", "12"]
    assert [r["e"] for r in got] == [False, False, False, True, False]


def test_scores_are_bounded(spark):
    rows = [(D(2025, 1, 1), "s", "n", f"seat{i}", "b", 10_000_000 * i, 1_000_000, 9_000_000 * i, "x,hot") for i in range(1, 9)]
    df = spark.createDataFrame(rows, "date date, stock_code string, stock_name string, youzi_name string, yingye_bu string, buy_amount bigint, sell_amount bigint, net_inflow bigint, concepts string")
    r = billboard.stock_scores(df, tier1=["seat1"], tier2=["seat2"], institutions=["seat3"], hot=["hot"]).first()
    assert 0 <= r["capital_quality"] <= 30 and 0 <= r["inflow"] <= 25 and 0 <= r["sell_pressure"] <= 20 and 0 <= r["institutions"] <= 15 and 0 <= r["bonus"] <= 10
    assert r["tier1_count"] == 1 and r["institution_count"] == 1


def test_weekly_contains_daily(spark):
    b = spark.createDataFrame([("x", D(2025, 1, 6) + dt.timedelta(i), i, i + 5, i - 5, i, 1, 1) for i in range(10)], "ts_code string, trade_date date, open_li int, high_li int, low_li int, close_li int, volume_hand bigint, amount_li bigint")
    rows = bars.weekly(b, "2025-01-08").orderBy("week_end_date").collect()
    assert [r["week_end_date"] for r in rows] == [D(2025, 1, 10), D(2025, 1, 17)] and rows[0]["high_li"] == 11 and rows[0]["open_li"] == 0


def test_compare_reports(spark):
    a = pd.DataFrame({"rows": [3], "instruments": [1], "duplicate_keys": [0]})
    got = quality.compare(spark.createDataFrame(a), spark.createDataFrame(a.assign(rows=[4]))).collect()
    assert [r["message"] for r in got] == ["rows: 3 -> 4"]
