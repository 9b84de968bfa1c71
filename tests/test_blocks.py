"""Series cut into blocks against plain loops and windows over the whole series."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickweave.operators import indicators, sequences, windows
from tickweave.operators.blocks import Ranges, carried_lag

START = dt.date(2000, 1, 1)


def series(rng, n, gap=3):
    day, out = START, []
    for _ in range(n):
        day += dt.timedelta(days=rng.randint(1, gap))
        out.append((day, round(50 + 20 * rng.random(), 3)))
    return out


def mean(xs, weight):
    out = []
    for x in xs:
        out.append(x if not out else (1 - weight) * out[-1] + weight * x)
    return out


@pytest.mark.parametrize("days", [20, 100_000])
def test_one_symbol_over_many_blocks_equals_the_loop(spark, days):
    rng = random.Random(1)
    rows = {"long": series(rng, 900), "short": series(rng, 5), "one": series(rng, 1), "flat": [(d, 7.0) for d, _ in series(rng, 40)]}
    df = spark.createDataFrame([(s, d, v) for s, x in rows.items() for d, v in x], "symbol string, t date, close double")
    assert days > 1000 or df.filter("symbol = 'long'").select(F.floor(F.unix_date("t") / days)).distinct().count() > 50
    got = {(r["symbol"], r["t"]): r for r in indicators.macd(indicators.rsi(df, days=days), days=days).collect()}
    assert len(got) == df.count()
    for s, x in rows.items():
        v = [c for _, c in x]
        change = [0.0, *(b - a for a, b in zip(v, v[1:], strict=False))]
        up, down = (mean([max(sign * c, 0.0) for c in change], 1 / 14) for sign in (1, -1))
        line = [a - b for a, b in zip(mean(v, 2 / 13), mean(v, 2 / 27), strict=True)]
        signal = mean(line[25:], 2 / 10)
        for i, (d, _) in enumerate(x):
            r = got[s, d]
            rsi = None if i < 13 else 100.0 if down[i] == 0 else 100 - 100 / (1 + up[i] / down[i])
            want = (rsi, line[i] if i >= 25 else None, signal[i - 25] if i >= 33 else None)
            for a, b in zip((r["rsi"], r["macd"], r["macd_signal"]), want, strict=True):
                assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


def test_indicators_stay_in_the_engine(spark):
    df = spark.createDataFrame([("a", START, 1.0)], "symbol string, t date, close double")
    plan = indicators.macd(indicators.rsi(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "SinglePartition" not in plan


@pytest.mark.parametrize("how", ["forward", "backward", "both"])
def test_fill_over_blocks_equals_one_window(spark, how):
    rng = random.Random(2)
    rows = [(s, d, v if rng.random() < 0.1 else None, v if rng.random() < 0.02 else None) for s in ("a", "b", None) for d, v in series(rng, 300)]
    df = spark.createDataFrame(rows, "symbol string, t date, x double, y double")
    w = Window.partitionBy("symbol").orderBy("t")
    before, after = ((lambda c: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))), (lambda c: F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing))))
    want = df.withColumns({c: {"forward": before(c), "backward": after(c), "both": F.coalesce(before(c), after(c))}[how] for c in ("x", "y")})
    got = windows.fill(df, ["x", "y"], how=how, days=15)
    assert sorted(map(str, got.select(df.columns).collect())) == sorted(map(str, want.collect()))


def test_as_of_over_blocks_equals_a_loop(spark):
    rng = random.Random(3)
    left = [(k, START + dt.timedelta(days=rng.randint(0, 900)), i) for i, k in enumerate("aab" * 100)]
    right = [(k, START + dt.timedelta(days=rng.randint(0, 900)), float(i)) for i, k in enumerate("abc" * 8)]
    got = sequences.as_of(spark.createDataFrame(left, "k string, t date, n int"), spark.createDataFrame(right, "k string, r date, v double"), key="k", time="t", right_time="r", values=["v"], days=10)
    want = sorted((n, max(((r, v) for kk, r, v in right if kk == k and r <= t), default=(None, None))[1]) for k, t, n in left)
    assert sorted((r["n"], r["v"]) for r in got.collect()) == want


def test_lag_over_blocks(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(s, d, v if rng.random() < 0.8 else None) for s in "ab" for d, v in series(rng, 80)], "s string, t date, v double")
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("s").orderBy("t")))
    assert sorted(map(str, carried_lag(df, "v", symbol="s", time="t", out="p", days=10).select("s", "t", "v", "p").collect())) == sorted(map(str, want.collect()))


def test_ranges_rank_and_page_like_one_window(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 1.0, 1.0, 2.0, round(rng.random(), 2)]), "x") for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, score double, other string").repartition(5)
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    got = windows.score_rank(df, score="score", key="k")
    assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["rank"] for r in got.collect()} == {r[0]: i for i, r in enumerate(ordered, 1)}
    ranges = Ranges(df, [("score", True), ("k", False)])
    for offset in (0, 1990, 3995, 5000):
        assert [r["k"] for r in ranges.page(offset, 10).collect()] == [r[0] for r in ordered[offset : offset + 10]]
    assert windows.score_rank(df.limit(0), score="score", key="k").count() == 0
