"""The store that rows are only added to: what it keeps, what it reads and what it writes."""

import pytest
from pyspark.sql import functions as F

from tickweave.plans import market_store
from tickweave.sources.keyed import KeyedStore

SCHEMA = "source string, id long, day string, text string"


def rows(spark, ids, source="s", text="x"):
    return spark.createDataFrame([(source, i, None if i is None else f"2024-01-{1 + i % 9:02d}", text) for i in ids], SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    return KeyedStore(spark, f"file://{tmp_path}/store", ["source", "id"], partition="day")


def test_inserts_add_only_what_is_absent(spark, store):
    first = store.insert(rows(spark, range(0, 500)))
    assert (first.rows, first.files_read, first.files_written) == (500, 0, 9)
    again = store.insert(rows(spark, range(0, 500), text="other"))
    assert (again.rows, again.files_written) == (0, 0) and store.pieces() == 1
    more = store.insert(rows(spark, [*range(400, 600), 599, 599]))
    assert more.rows == 100 and store.pieces() == 2
    got = store.read()
    assert got.count() == 600 == got.select("id").distinct().count() and got.filter("text = 'other'").count() == 0


def test_only_partitions_that_a_filter_hits_are_read(spark, store):
    store.insert(rows(spark, range(0, 900)))
    assert store.insert(rows(spark, [9 * 7])).files_read == 1  # its day's file alone
    assert store.insert(rows(spark, range(10_000, 10_009), source="else")).files_read <= 1  # all new: a filter may be wrong


def test_rows_with_a_null_in_the_key_always_count(spark, store):
    for _ in range(2):
        assert store.insert(rows(spark, [None, None, 1])).rows >= 2
    assert store.read().filter("id is null").count() == 4 and store.read().filter("id = 1").count() == 1


def test_dropped_days_do_not_come_back(spark, store):
    store.insert(rows(spark, range(0, 90)))
    assert store.keep_since("2024-01-05") == 4
    assert store.read().agg(F.min("day")).first()[0] == "2024-01-05" and store.read().count() == 50
    assert store.insert(rows(spark, range(0, 90))).rows == 0


def test_compaction_keeps_rows_and_filters(spark, store):
    for i in range(4):
        store.insert(rows(spark, range(i * 50, i * 50 + 60)))
    assert not store.compact(4) and store.compact(3) and store.pieces() == 1
    assert store.read().count() == 210 and store.insert(rows(spark, range(0, 210))).files_written == 0


def test_of_two_writers_at_once_one_fails(spark, store):
    store.insert(rows(spark, [1]))
    log = store._log()
    store.insert(rows(spark, [2]))
    with pytest.raises(Exception, match="exist"):
        store._write_piece(rows(spark, [3]), log)
    assert sorted(r["id"] for r in store.read().collect()) == [1, 2]


def test_an_empty_insert_and_an_empty_store(spark, store):
    with pytest.raises(ValueError):
        store.read()
    assert store.insert(rows(spark, [1]).limit(0)).files_written == 0 and store.pieces() == 0


def test_news_come_in_as_many_files_as_their_table_has_parts(spark, sf_dir, tmp_path, monkeypatch):
    """No task writes or reads all news."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(f"{tmp_path}/sf/documents.parquet")
    monkeypatch.setattr(market_store, "scratch", lambda spark, label: f"file://{tmp_path}/{label}")
    got = market_store.QUERIES["x3_news_once"](spark, f"{tmp_path}/sf").collect()
    assert got and all(r["items"] == r["ids"] and r["added_by_repeats"] == 0 for r in got)
    files = spark.read.parquet(f"{tmp_path}/news-once/in").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 9 and max(r["count"] for r in files) < docs.count() / 2
