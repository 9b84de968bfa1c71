"""Quality classifier: Naive Bayes support vectors over hashed n-gram indicators.

Features of a whole text are the byte pairs and (hashed) byte triples that occur in it, and the runs of four word
relations (a word equals the one before it, the one before that, or neither), which show repetition. Each indicator
is scaled by the log ratio of its smoothed class frequencies, rows are brought to unit length, and a linear model with
hinge loss is fitted by dual coordinate descent. A logistic curve reads margins as scores.

The fit uses at most ``sample`` labelled rows of each class, chosen by a hash of the id. Scoring runs as an Arrow
function over one column; other columns stay in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE_BYTES, hasher, learnable
from .svm import balance, hinge_fit, logistic_fit, sigmoid

PAIRS, TRIPLES, RELATIONS = 1 << 16, 1 << 17, 81
SIZE = PAIRS + TRIPLES + RELATIONS
#: Labelled rows of each class that a fit reads at most.
SAMPLE = 2000
#: Scores from here on count as good.
THRESHOLD = 0.7


class Indicators:
    """The indices of the features that a text has."""

    def __init__(self) -> None:
        self.mark = np.zeros(SIZE, np.bool_)

    def __call__(self, raw: bytes) -> np.ndarray:
        mark = self.mark
        for at in range(0, len(raw), PIECE_BYTES):
            a = np.frombuffer(raw[at : at + PIECE_BYTES + 2], np.uint8).astype(np.uint32)
            if len(a) > 1:
                mark[a[:-1] << 8 | a[1:]] = True
            if len(a) > 2:
                mark[PAIRS + ((a[:-2] * 0x9E3779B1 ^ a[1:-1] * 0x85EBCA77 ^ a[2:] * 0xC2B2AE3D) >> 15)] = True
        words = hasher().words(raw)
        if len(words) > 5:
            s = np.where(words[2:] == words[1:-1], 1, np.where(words[2:] == words[:-2], 2, 0))
            mark[PAIRS + TRIPLES + s[:-3] * 27 + s[1:-2] * 9 + s[2:-1] * 3 + s[3:]] = True
        found = np.flatnonzero(mark)
        mark[found] = False
        return found.astype(np.int32)


@dataclass
class QualityModel:
    """u: weight times ratio of each feature; q: squared ratio; the rest turns sums into scores."""

    u: np.ndarray
    q: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        length = float(self.q[found].sum())
        return (float(self.u[found].sum()) / length**0.5 if length else 0.0) + self.bias

    def score(self, found: np.ndarray) -> float:
        return float(sigmoid(self.slope * self.margin(found) + self.shift))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel | None:
    """Learn from texts whose id may be learnt from and has a 0/1 label; None if there is nothing to learn from.

    Ids labelled more than once take their largest label. Rows with null text, id or label are not learnt from. Of
    texts with one id the one of least features is taken.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & learnable(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def features(text: pd.Series) -> pd.Series:
        of = Indicators()
        return pd.Series([of(t.encode("utf-8", "replace")) for t in text])

    # One row an id before anything reaches the driver: ids may repeat, and at most 2 * sample are chosen.
    rows = texts.join(F.broadcast(chosen), "id").select("id", "y", features("text").alias("f")).groupBy("id", "y").agg(F.min("f").alias("f")).toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values("id", kind="stable")
    y = np.where(rows["y"].to_numpy() > 0, 1.0, -1.0)
    found = [np.asarray(f, np.int64) for f in rows["f"]]
    count = {s: np.ones(SIZE) for s in (-1.0, 1.0)}
    for f, s in zip(found, y, strict=True):
        count[s][f] += 1
    ratio = np.log(count[1.0] / ((y > 0).sum() + 2)) - np.log(count[-1.0] / ((y < 0).sum() + 2))
    scaled = []
    for f in found:
        v = ratio[f]
        length = float(np.sqrt(v @ v))
        scaled.append((f, v / length if length else v))
    w, bias = hinge_fit(scaled, y, SIZE, cost=4.0, weights=balance(y))
    margins = np.array([w[k] @ v for k, v in scaled]) + bias
    slope, shift = logistic_fit(margins, y)
    return QualityModel(w * ratio, ratio * ratio, bias, slope, shift)


def scorer(spark, model: QualityModel | None):
    """A column function text -> score. Without a model every score is 1 (nothing is known against a text)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(text: pd.Series) -> pd.Series:
        m, of = shared.value, Indicators()
        return pd.Series([1.0 if m is None else m.score(of((t or "").encode("utf-8", "replace"))) for t in text], dtype=float)

    return score


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE, keep_columns: bool = False) -> DataFrame:
    """Score whole texts for quality: ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Null and empty texts are scored as texts without features. Repeated rows are scored alike; an empty table gives
    an empty table. Rows with a null id are scored too. Columns of other names than the two results are never read;
    with ``keep_columns`` all columns of docs are returned, and the two results replace any of the same names.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, sample=sample)
    out = docs.withColumn("score", scorer(docs.sparkSession, model)(F.col(text_col)))
    out = out.withColumn("predicted", verdict("score", threshold))
    return out if keep_columns else out.select(id_col, "score", "predicted")


def verdict(score: str, threshold: float) -> Column:
    return (F.col(score) >= threshold).cast("int")
