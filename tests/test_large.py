"""Operators that must not gather a table: exact quantiles, snapshots that grow, trigram lists."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tickweave.operators import quality, universe
from tickweave.sources import sinks


@pytest.mark.parametrize("values", [[0.5], [1.0, 2.0], [3.0] * 50 + [4.0] * 50, [float(i) for i in range(101)], [1e-9 * i for i in range(500)] + [1e12, -1e12], [7.0] * 333])
def test_refined_median_is_exact(spark, values):
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double")
    assert quality.exact_quantile(df, F.col("v"), few=3, bins=4) == pytest.approx(statistics.median(values), abs=0)
    assert quality.exact_quantile(df, F.col("v"), q=1.0, few=3, bins=4) == max(values)
    assert quality.exact_quantile(df.limit(0), F.col("v")) is None


def test_snapshot_after_appends_is_as_if_written_whole(spark, tmp_path):
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)
    rows = lambda days, add: spark.createDataFrame([(s, day(i), i + add) for i in days for s in ("a", "b") if s == "a" or i % 2], "instrument string, datetime timestamp, close int")
    folder = f"{tmp_path}/s"
    sinks.write_snapshot(rows(range(5, 60), 0), folder, name="n", grain="month")
    for part in (rows(range(50, 100), 1), rows(range(0, 8), 2), rows(range(0, 8), 2)):
        sinks.append_snapshot(part, folder, ["instrument", "datetime"], grain="month")
    read = lambda kind: spark.read.parquet(f"{folder}/{kind}")
    assert read("bars").count() == 150 == read("meta").first()["rows"] and read("calendars").count() == 100
    assert {r["instrument"]: (r["first_day"], r["last_day"]) for r in read("instruments").collect()} == {"a": (day(0).date(), day(99).date()), "b": (day(1).date(), day(99).date())}
    meta = read("meta").first()
    assert (meta["first_day"], meta["last_day"], meta["snapshot"]) == (day(0).date(), day(99).date(), "n")
    assert sorted(r["rows"] for r in read("counts").collect()) == sorted(r["count"] for r in read("bars").groupBy("date").count().collect())


@pytest.mark.parametrize("word", ["ring", "G R", "al", "", "zzz", "\u00c9t\u00e9", "a%b"])
def test_indexed_search_equals_the_scan(spark, word):
    rows = [(1, "Large Ring", "x"), (2, "ring", None), (3, None, "stRING"), (4, "rin", "ing"), (5, "al", "big red"), (6, "\u00e9t\u00e9", "a%b"), (7, "", ""), (2, "ring again", "y")]
    df = spark.createDataFrame(rows, "id int, code string, name string")
    got = universe.indexed_search(df, universe.search_index(df, "id"), word, "id")
    assert sorted(map(str, got.select(*df.columns).collect())) == sorted(map(str, universe.keyword_search(df, word).collect()))


def test_ranges_of_a_search_index_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(universe, "RANGE_CHARS", 500)
    df = spark.range(400).selectExpr("id % 390 AS id", "concat('part number ', id % 390) AS code", "CAST(NULL AS STRING) AS name")
    index = universe.search_index(df, "id")
    sizes = [r["count"] for r in index.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 1500
    assert index.count() == index.distinct().count() == sum(len({x[i : i + 3] for i in range(len(x) - 2)}) for x in (f"part number {i}" for i in range(390)))


def test_a_delta_is_worked_out_once_when_it_is_put_in(spark, tmp_path):
    """Also deltas that cost much, as buckets of all stored ticks do."""
    worked = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def costly(x):
        worked.add(1)
        return x

    folder, keys = f"file://{tmp_path}/t", ["id"]
    at = lambda a, b, v: spark.range(a, b).selectExpr("id", f"{v} AS v", "CAST(id % 3 AS INT) AS p")
    sinks.upsert_partitions(at(0, 30, 1), folder, keys, partition="p")
    sinks.upsert_partitions(at(20, 40, 2).union(at(25, 30, 0)).withColumn("p", costly("p")), folder, keys, partition="p")
    assert worked.value == 25
    assert {r["id"]: r["v"] for r in spark.read.parquet(folder).collect()} == {i: 1 if i < 20 else 2 for i in range(40)}
