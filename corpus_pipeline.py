"""The corpus pipeline: five stages over ``documents``, each an operator of ``tickweave.llm``.

A stage is written as Parquet and read again as the next stage's input; ``run`` does the same through the folder that
the cluster shares. Stages keep all columns of their input, whatever their names; the last adds those of the mix.

All stages take empty tables (and give empty ones), texts of any length, repeated rows (each is judged by itself, but of
a group of near copies one row stays) and rows with null ids, which are kept or dropped by their text alone. A null text
is judged as an empty one.

Stages bound what the session's tasks hold of long rows at a time (``common.bounded``) and leave the session so, as their
results are only computed when they are written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm import common, decontaminate, langid, mixing, ngram_join, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A language is only doubted below this score, which is far under what short clean texts get.
LANGUAGE_SCORE = 0.25


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on their labels, predicts to be good: a score from ``quality.THRESHOLD`` on.

    Without labelled texts of both kinds nothing is known against a document, and all stay.
    """
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return docs.filter(quality.scorer(spark, model)(F.col("text")) >= quality.THRESHOLD)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be determined, with a score of at least LANGUAGE_SCORE.

    Null texts and texts without a letter have none and go, as do all where there is no language to learn from.
    """
    predict, at = langid.predictor(spark, langid.fit(docs)), common.unused(docs, "language")
    found = docs.withColumn(at, predict(F.col("text")))
    return found.filter((F.col(f"{at}.lang") != langid.UNDETERMINED) & (F.col(f"{at}.score") >= LANGUAGE_SCORE)).drop(at)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id; of rows that share that id, one.

    Documents with a null id are in no group and stay. Documents without words are linked with nothing and stay.
    """
    groups = ngram_join.ngram_join(docs)
    stays = common.keep(groups.filter("doc_id = component_id").select("doc_id").distinct(), "pipeline-stays")
    kept = docs.join(common.small(stays, ngram_join.BROADCAST_ROWS), "doc_id", "left_semi")
    twice = common.keep(groups.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-twice")
    if not twice.isEmpty():
        again = common.small(twice, ngram_join.BROADCAST_ROWS)
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.unionByName(docs.filter("doc_id is null")).select(*docs.columns)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark, within the edits that ``decontaminate`` allows.

    Null and empty texts hold none; empty and null items are in no document.
    """
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources brought half the way to equal weights, each repeated four times at most, in as many words as came in.

    A null source is a source of its own; one without any words has no weight and is left out. Columns named ``epoch``,
    ``place`` and ``repeat_rate`` are replaced.
    """
    return mixing.mix(docs)


def _bounded(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.bounded(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("quality", _bounded(good_quality)),
    ("language", _bounded(known_language)),
    ("near_duplicates", _bounded(one_of_each_group)),
    ("decontamination", _bounded(no_benchmark)),
    ("mixing", _bounded(mixed)),
]
#: The stages are models, edit distances and hashes that DuckDB has no words for; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
