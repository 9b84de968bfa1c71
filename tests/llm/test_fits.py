"""The classifiers' fits against plain versions: log-count ratios, the optimum of the hinge loss, votes of pairs."""

import math

import numpy as np
import pytest

from tickweave.llm import langid, quality
from tickweave.llm.svm import balance, hinge_fit, logistic_fit, sigmoid


def problem(seed, n=60, size=40):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        k = np.sort(rng.choice(size, rng.integers(2, 9), replace=False))
        v = rng.normal(size=len(k))
        rows.append((k, v / np.sqrt(v @ v)))
    y = np.where(rng.random(n) < 0.3, 1.0, -1.0)
    return rows, y, size


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("cost", [0.5, 4.0])
def test_coordinate_descent_reaches_the_optimum(seed, cost):
    """Primal and dual meet: the gap, computed plainly from dense rows, closes; so no other weights are better."""
    rows, y, size = problem(seed)
    upper = cost * balance(y)
    w, bias = hinge_fit(rows, y, size, cost=cost, epochs=3000, weights=balance(y))
    x = np.zeros((len(rows), size + 1))
    for i, (k, v) in enumerate(rows):
        x[i, k], x[i, size] = v, 1
    full = np.append(w, bias)
    primal = full @ full / 2 + upper @ np.maximum(0, 1 - y * (x @ full))

    # A plain solver of the dual: projected gradient on all variables at once.
    q = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha + step * (1 - q @ alpha), 0, upper)
    dual = alpha.sum() - alpha @ q @ alpha / 2
    assert dual - 1e-6 <= primal <= dual * (1 + 2e-3) + 1e-6
    assert np.allclose(full, (alpha * y) @ x, atol=2e-2)


def test_margins_are_read_in_order():
    margins, y = np.array([-2.0, -1.0, -0.5, 0.4, 1.0, 2.0]), np.array([-1.0, -1.0, 1.0, -1.0, 1.0, 1.0])
    a, b = logistic_fit(margins, y)
    p = sigmoid(a * margins + b)
    assert a > 0 and (np.diff(p) > 0).all() and p[0] < 0.5 < p[-1]


def test_quality_model_equals_a_plain_fit(spark):
    """Ratios counted in dictionaries, rows scaled and fitted again: margins of seen and unseen texts are the same."""
    good = [f"the report of year {i} says that growth was slow in the north and steady in the south" for i in range(20)]
    bad = [f"buy buy now now {i} click click here here win win {i} {i} prize prize" for i in range(14)]
    docs = [(i, t) for i, t in enumerate(good + bad)]
    labels = {i: int(i < len(good)) for i, _ in docs}
    model = quality.fit(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(list(labels.items()), "doc_id bigint, quality int"))
    import zlib

    known = [(i, t) for i, t in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    of = quality.Indicators()
    sets = [set(of(t.encode()).tolist()) for _, t in known]
    y = np.array([1.0 if labels[i] else -1.0 for i, _ in known])
    n = {s: int((y == s).sum()) for s in (1.0, -1.0)}

    def ratio(f):
        seen = {s: sum(f in x for x, s2 in zip(sets, y, strict=True) if s2 == s) for s in (1.0, -1.0)}
        return math.log((seen[1.0] + 1) / (n[1.0] + 2)) - math.log((seen[-1.0] + 1) / (n[-1.0] + 2))

    ratios = {f: ratio(f) for f in set().union(*sets)}
    rows = []
    for x in sets:
        k = np.array(sorted(x))
        v = np.array([ratios[f] for f in k])
        rows.append((k, v / np.sqrt(v @ v)))
    w, bias = hinge_fit(rows, y, quality.SIZE, cost=4.0, weights=balance(y))
    for text in [*good, *bad, "the south was steady", "win a prize"]:
        k = of(text.encode())
        # Unseen features have the ratio of the two smoothed counts of nothing.
        none = math.log(1 / (n[1.0] + 2)) - math.log(1 / (n[-1.0] + 2))
        v = np.array([ratios.get(f, none) for f in k.tolist()])
        assert model.margin(k) == pytest.approx(float(w[k] @ v / np.sqrt(v @ v)) + bias, abs=1e-6)


def test_language_votes_equal_a_plain_count():
    """Family first, then the most pairs won; ties by probability, then code."""
    rng = np.random.default_rng(3)
    families = {"a": ["a1", "a2", "a3", "a4"], "b": ["b1", "b2"], "c": ["c"]}
    names = [("family", f) for f in families] + [("pair", x, y) for codes in families.values() for i, x in enumerate(codes) for y in codes[i + 1 :]]
    for _ in range(200):
        size = 6
        model = langid.LanguageModel(families, names, rng.normal(size=(size, len(names))), rng.normal(size=len(names)), np.ones(len(names)), np.zeros(len(names)))
        k, v = np.arange(size), rng.random(size)
        p = {name: 1 / (1 + math.exp(-(sum(v[j] * model.weights[j, i] for j in range(size)) + model.bias[i]))) for i, name in enumerate(names)}
        total = sum(p[("family", f)] for f in families)
        family = max(families, key=lambda f: p[("family", f)])
        codes, score = families[family], p[("family", family)] / total
        chance = lambda x, y: p[("pair", x, y)] if ("pair", x, y) in p else 1 - p[("pair", y, x)]
        if len(codes) > 1:
            rank = {x: (sum(chance(x, y) > 0.5 for y in codes if y != x), sum(chance(x, y) for y in codes if y != x)) for x in codes}
            best = max(codes, key=lambda x: rank[x])
            score *= rank[best][1] / (len(codes) - 1)
        else:
            best = codes[0]
        got = model.predict(k, v)
        assert got[0] == best and got[1] == pytest.approx(score)
