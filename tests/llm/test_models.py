"""Held-out accuracy of the classifiers, and odd inputs."""

from pyspark.sql import functions as F

from tickweave.llm import langid, quality
from tickweave.llm.common import held_out

BIG = "/root/testdata/sf0.01"


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    got = quality.quality(docs, labels).withColumn("h", held_out()).join(labels, "doc_id").filter("h").toPandas()
    assert len(got) > 50 and (got["predicted"] == got["quality"]).mean() >= 0.95
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    got = langid.language(docs).withColumn("h", held_out()).join(docs.select("doc_id", "lang"), "doc_id").filter("h").toPandas()
    assert len(got) > 150 and (got["lang_pred"] == got["lang"]).mean() >= 0.98
    assert got["score"].between(0, 1).all()


def test_no_leak_of_labels_or_ids(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    swapped = docs.withColumn("lang", F.when(held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = (langid.language(d).filter("doc_id < 50").orderBy("doc_id").collect() for d in (docs, swapped))
    assert a == b


def test_odd_rows(spark):
    odd = [(None, None), (1, ""), (2, "123 !!! 456"), (3, "é" * 5000), (3, "é" * 5000), (4, "a"), (5, "😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
    docs = spark.createDataFrame([(*r, "en") for r in odd], "doc_id bigint, text string, lang string").selectExpr("*", "0.5 as score", "'x' as predicted", "'y' as lang_pred")
    train = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text", "lang").withColumn("doc_id", F.col("doc_id") + 1000)
    labels = spark.read.parquet(f"{BIG}/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    both = docs.unionByName(train, allowMissingColumns=True)
    q = quality.quality(both, labels).filter("doc_id is null or doc_id < 1000").collect()
    assert len(q) == len(odd) and all(0 <= r["score"] <= 1 for r in q)
    found = [(r["doc_id"], r["lang_pred"]) for r in langid.language(both).filter("doc_id is null or doc_id < 1000").collect()]
    assert found.count((None, "und")) == 1 and (1, "und") in found and (2, "und") in found and len(found) == len(odd)
    assert quality.quality(docs.limit(0), labels).count() == 0 and langid.language(docs.limit(0)).count() == 0
    assert {r["lang_pred"] for r in langid.language(docs.filter("doc_id is null or doc_id = 2")).collect()} == {"und"}


def test_without_labels_nothing_is_rejected(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.quality(docs, labels).first()["predicted"] == 1


def test_language_sample_counts_ids_once(spark):
    """An id that repeats more often than the sample is large takes one place in it."""
    from pyspark.sql import functions as F

    from tickweave.llm import langid

    words = {"en": "the cat sat on the mat and it was good".split(), "de": "der hund und die katze sind nicht gut".split()}
    rows = [(i * 2 + k, " ".join(words[c][(i + j) % 9 % len(words[c])] for j in range(12)), c) for i in range(60) for k, c in enumerate(words)]
    many = rows + [(4, "the the the", "en")] * 200 + [(5, "der der der", "de")] * 200
    df = spark.createDataFrame(many, "doc_id long, text string, lang string")
    got = langid.language(df, sample=30, keep_columns=True)
    assert got.filter(F.col("lang") == F.col("lang_pred")).count() == len(many)
