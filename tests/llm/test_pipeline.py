"""Stages of the pipeline on odd tables, and the near-duplicate stage against brute force."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_join import brute, near_copies  # noqa: E402

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd_rows():
    return [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two three four five six", "en", "a", 27), (3, "one two three four five six", "en", "a", 27), (4, "x" * 1_000_000, "en", "b", 1_000_000)]


def test_stages_take_odd_and_empty_tables(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).selectExpr("*", "1 as __language", "'a' as _language", "2 as language", "3 as sid", "4 as component_id", "5 as mix_s", "6 as score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, DIR)
        kept = out.columns[: len(df.columns)]
        assert kept == df.columns and out.count() <= 5 * df.count(), name
        assert stage(spark, df.limit(0), DIR).count() == 0, name


def test_of_each_group_of_near_copies_one_row_stays(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for size, n, most in ((90, 25, 5), (12, 10, 1), (6, 6, 1)):
        texts += near_copies(rng, " ".join(rng.choices(words, k=size)), n, most)
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)] + ["", None, texts[0], texts[0]]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    out = corpus_pipeline.one_of_each_group(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), DIR)
    want = {least for _, _, least in brute([(r[0], r[1]) for r in rows])}
    got = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert sorted(got) == sorted(want)


def test_stages_take_long_texts_in_batches_of_bounded_size(spark):
    """What a worker gets at a time is bounded in bytes, in tables that are kept and in results that a caller writes."""
    from tickweave.llm import common

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.get_total_buffer_size()], pa.int64())], ["n"])

    def largest():
        return docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0]

    docs = spark.range(600).selectExpr("id as doc_id", "repeat(cast(id as string), 20000) as text", "'en' as lang", "'a' as source", "0 as n_chars").coalesce(1)
    most = 8 << 20
    assert common.keep(docs.mapInArrow(sizes, "n long"), "sizes").agg({"n": "max"}).first()[0] <= most
    settings = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    try:
        for name, stage in corpus_pipeline.STAGES:
            for key in settings:
                spark.conf.unset(key)
            stage(spark, docs.limit(0), DIR)
            assert largest() <= most, name
    finally:
        for key in settings:
            spark.conf.unset(key)
