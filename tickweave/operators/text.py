"""Keyword sentiment, news statistics and research reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import latest


def words_in(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds, each once."""
    return reduce(Column.__add__, (F.coalesce(text.contains(w), F.lit(False)).cast("int") for w in words), F.lit(0))


def keyword_sentiment(df: DataFrame, *, text: str, positive: list[str], negative: list[str], topics: list[str], n_topics: int = 10) -> DataFrame:
    """Positive and negative words present, a label (one side 1.5 times the other), a score from -100 to 100, and topics."""
    out = df.withColumn("positive", words_in(F.col(text), positive)).withColumn("negative", words_in(F.col(text), negative))
    p, n = F.col("positive"), F.col("negative")
    out = out.withColumn("sentiment", F.when(p > n * 1.5, "positive").when(n > p * 1.5, "negative").otherwise("neutral"))
    out = out.withColumn("sentiment_score", (p - n) * 100.0 / F.greatest(p + n, F.lit(1)))
    found = F.filter(F.array(*map(F.lit, topics)), lambda w: F.coalesce(F.col(text).contains(w), F.lit(False)))
    return out.withColumn("topics", F.concat_ws(",", F.slice(found, 1, n_topics)))


def event_score(df: DataFrame, *, key: str, text: str, positive: list[str], negative: list[str], weight: float, limit: float) -> DataFrame:
    """Weighted difference of keyword hits over all of a key's items, clipped: filings .4 and 2, news .3 and 1.5."""
    hits = df.groupBy(key).agg(F.sum(words_in(F.col(text), positive)).alias("positive"), F.sum(words_in(F.col(text), negative)).alias("negative"))
    raw = (F.col("positive") - F.col("negative")) * weight
    return hits.withColumn("score", F.greatest(F.lit(-limit), F.least(F.lit(limit), raw)))


def news_stats(news: DataFrame, since: str | None = None) -> DataFrame:
    """Per source: items, important ones, first and last time; from a time on, if given."""
    rows = news if since is None else news.filter(F.col("publish_time") >= F.lit(since).cast("timestamp"))
    return rows.groupBy("source").agg(F.count("*").alias("items"), F.count_if("is_important").alias("important"), F.min("publish_time").alias("first_time"), F.max("publish_time").alias("last_time"))


def dedup_reports(reports: DataFrame, *, order: str) -> DataFrame:
    """The first report of each date, institution and title."""
    return latest(reports, key=["report_date", "org_name", "report_title"], order=[F.col(order)])


def report_stats(reports: DataFrame, *, key: str = "ts_code", buy: str = "(?i)buy|overweight|add", sell: str = "(?i)sell|underweight|reduce") -> DataFrame:
    """Reports, institutions and shares of buy, neutral and sell ratings (each report counts once), ranges of numbers, latest report."""
    r = F.coalesce(F.col("rating"), F.lit(""))
    kinds = {"buy": r.rlike(buy), "sell": r.rlike(sell) & ~r.rlike(buy)}
    kinds["neutral"] = ~kinds["buy"] & ~r.rlike(sell)
    stats = [f(c).alias(f"{c}_{n}") for c in ("target_price", "eps") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))]
    out = reports.groupBy(key).agg(F.count("*").alias("reports"), F.countDistinct("org_name").alias("institutions"), *(F.count_if(v).alias(k) for k, v in kinds.items()), *stats, F.max("report_date").alias("latest_date"), F.max_by("report_title", F.struct("report_date", "report_title")).alias("latest_title"))
    return out.withColumns({f"{k}_ratio": F.col(k).cast("double") / F.col("reports") for k in kinds})


def top_institutions(reports: DataFrame, n: int = 10) -> DataFrame:
    return reports.groupBy("org_name").agg(F.count("*").alias("reports")).orderBy(F.desc("reports"), "org_name").limit(n)
