"""Language identification in two steps: a family of languages first, then one-versus-one machines within it.

A text is lower-cased, everything but letters becomes a space, and its byte triples are counted, damped by the
logarithm and brought to unit length. Linear support vector machines separate each family from the rest; within a
family, one machine for each pair of languages votes. Margins are read as probabilities by logistic curves, and a
text's score is the probability of its family times that of its language within the family.

The fit uses at most ``sample`` rows of each language, chosen by a hash of the id.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import PIECE_BYTES, learnable, unused
from .svm import balance, hinge_fit, logistic_fit, sigmoid

SIZE = 1 << 16
#: Rows of each language that a fit reads at most.
SAMPLE = 500
#: What texts get that have no letter.
UNDETERMINED = "und"
#: Families of languages by code. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn mr ur pa gu ne",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_OTHERS = re.compile(r"[\W\d_]+")


class Triples:
    """Damped counts of byte triples of the letters of a text: (indices, values), of unit length."""

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = None
        for at in range(0, len(text), PIECE_BYTES):
            raw = (" " + _OTHERS.sub(" ", text[at : at + PIECE_BYTES].lower()).strip() + " ").encode("utf-8", "replace")
            a = np.frombuffer(raw, np.uint8).astype(np.uint32)
            if len(a) < 3:
                continue
            got = np.bincount((a[:-2] * 0x9E3779B1 ^ a[1:-1] * 0x85EBCA77 ^ a[2:] * 0xC2B2AE3D) >> 16, minlength=SIZE)
            counts = got if counts is None else counts + got
        if counts is None:
            return np.zeros(0, np.int64), np.zeros(0)
        k = np.flatnonzero(counts)
        v = np.log1p(counts[k])
        return k, v / np.sqrt(v @ v)


@dataclass
class LanguageModel:
    """Machines as columns of one matrix, so that a text needs one product."""

    families: dict[str, list[str]]
    names: list[tuple] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: np.ndarray | None = None
    slope: np.ndarray | None = None
    shift: np.ndarray | None = None

    def predict(self, k: np.ndarray, v: np.ndarray) -> tuple[str, float]:
        p = {}
        if self.names:
            got = sigmoid(self.slope * (v @ self.weights[k] + self.bias) + self.shift)
            p = dict(zip(self.names, got, strict=True))
        names = sorted(self.families)
        if len(names) == 2:
            of = {names[0]: p[("family", names[0])], names[1]: 1 - p[("family", names[0])]}
        else:
            raw = {f: p.get(("family", f), 1.0) for f in names}
            of = {f: x / (sum(raw.values()) or 1) for f, x in raw.items()}
        family = max(names, key=lambda f: (of[f], f))
        codes = self.families[family]
        if len(codes) == 1:
            return codes[0], float(of[family])
        won = {c: 0.0 for c in codes}
        votes = dict.fromkeys(codes, 0)
        for i, a in enumerate(codes):
            for b in codes[i + 1 :]:
                x = p[("pair", a, b)]
                won[a] += x
                won[b] += 1 - x
                votes[a if x >= 0.5 else b] += 1
        best = max(codes, key=lambda c: (votes[c], won[c], c))
        return best, float(of[family] * won[best] / (len(codes) - 1))


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel | None:
    """Learn from rows that have a text, a language and an id that may be learnt from; None if there are none."""
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.filter(learnable("id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("id", 0.02).alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    # Thin each language by a hash before ranking, so that no task sorts a whole language.
    share = F.create_map(*(x for c, n in counts.items() for x in (F.lit(c), F.lit(min(1.0, 2.0 * sample / max(n, 1))))))
    unit = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    thin = known.filter(unit < share[F.col("lang")])
    from pyspark.sql import Window

    ranked = thin.select("id", "lang").distinct().withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(1)), "id"))).filter(F.col("r") <= sample)

    @F.pandas_udf(T.StructType([T.StructField("k", T.ArrayType(T.IntegerType())), T.StructField("v", T.ArrayType(T.FloatType()))]))
    def features(text: pd.Series) -> pd.DataFrame:
        of = Triples()
        got = [of(t) for t in text]
        return pd.DataFrame({"k": [k.astype(np.int32) for k, _ in got], "v": [v.astype(np.float32) for _, v in got]})

    # One row an id and language before anything reaches the driver: ids may repeat, and at most sample a language are chosen.
    chosen = thin.join(F.broadcast(ranked.select("id", "lang")), ["id", "lang"]).select("id", "lang", features("text").alias("f"))
    rows = chosen.groupBy("id", "lang").agg(F.min("f").alias("f")).toPandas().sort_values(["id", "lang"], kind="stable")
    data = [(np.asarray(f["k"], np.int64), np.asarray(f["v"], float)) for f in rows["f"]]
    langs = rows["lang"].to_numpy()
    families: dict[str, list[str]] = {}
    for code in sorted(set(langs)):
        families.setdefault(_FAMILY.get(code, code), []).append(code)
    of = np.array([_FAMILY.get(c, c) for c in langs])
    tasks = [(("family", f), np.ones(len(data), bool), of == f) for f in sorted(families)]
    tasks = tasks[: 1 if len(families) == 2 else len(families)] if len(families) > 1 else []
    tasks += [(("pair", a, b), (langs == a) | (langs == b), langs == a) for codes in families.values() for i, a in enumerate(codes) for b in codes[i + 1 :]]
    made = []
    for name, chosen, yes in tasks:
        some = [data[i] for i in np.flatnonzero(chosen)]
        y = np.where(yes[chosen], 1.0, -1.0)
        w, bias = hinge_fit(some, y, SIZE, cost=10.0, weights=balance(y))
        made.append((name, w, bias, *logistic_fit(np.array([w[k] @ v for k, v in some]) + bias, y)))
    if not made:
        return LanguageModel(families)
    names, w, bias, slope, shift = zip(*made, strict=True)
    return LanguageModel(families, list(names), np.stack(w, axis=1), np.array(bias), np.array(slope), np.array(shift))


def predictor(spark, model: LanguageModel | None):
    """A column function text -> struct(lang, score)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())]))
    def predict(text: pd.Series) -> pd.DataFrame:
        m, of = shared.value, Triples()
        out = [(UNDETERMINED, 0.0) if m is None or not t or not _LETTER.search(t) else m.predict(*of(t)) for t in text]
        return pd.DataFrame(out, columns=["lang", "score"])

    return predict


def language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, keep_columns: bool = False) -> DataFrame:
    """Predict the language of whole texts: ``lang_pred`` and ``score`` (0 to 1).

    Null texts and texts without a letter get ``und`` with score 0, as does everything if there is nothing to learn
    from. Repeated rows get equal results, also those with a null id; an empty table gives an empty table. With
    ``keep_columns`` all columns of docs are returned, and the two results replace any of the same names.
    """
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, sample=sample)
    at = unused(docs, "language")
    out = docs.withColumn(at, predictor(docs.sparkSession, model)(F.col(text_col)))
    out = out.withColumn("lang_pred", F.col(f"{at}.lang")).withColumn("score", F.col(f"{at}.score")).drop(at)
    return out if keep_columns else out.select(id_col, "lang_pred", "score")
