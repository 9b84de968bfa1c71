"""The similarity join against brute force, and the cases that its docstring states."""

import random
import re

import pytest

from tickweave.llm.ngram_join import TASK_ENTRIES, boundary, least_overlap, list_tasks, ngram_join, subset_keys

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [(k, shingle_set(t)) for k, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets))


def near_copies(rng, base, n, most):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(w))
            kind = rng.random()
            if kind < 0.5:
                w[at] = f"x{rng.randrange(9999)}"
            elif kind < 0.75:
                del w[at]
            else:
                w.insert(at, f"y{rng.randrange(9999)}")
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=50))
    texts = []
    for size, n, most in ((120, 60, 6), (14, 25, 2), (9, 20, 1), (6, 10, 1), (30, 20, 3)):
        texts += near_copies(rng, " ".join(rng.choices(words, k=size)), n, most)
    texts += [passage + " " + " ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(60)]
    texts += ["one two three", "ONE two  three", "one two four", "", "  \n", "a b c d e", "A B C D E", "a b c d e f"] + texts[:5]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, ngram_join(df).collect())) == brute(rows)


def test_nulls_empty_tables_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "x y z q r s", "c"), (3, "x y z q r s", "d"), (3, "x y z q r s", "d"), (5, "X y z q R s", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string").selectExpr("*", "component_id as sid", "1 as n", "2 as id", "3 as token")
    got = sorted(map(tuple, ngram_join(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 2, None), (3, 2, 3), (3, 2, 3), (5, 2, 3)], key=str)
    assert ngram_join(df.limit(0)).collect() == []


def test_subsets_meet_exactly_where_sets_are_linked():
    import numpy as np

    universe = np.arange(1, 40, dtype=np.uint64)
    keys = lambda x: subset_keys(x, 75, 100)
    for a in range(1, 12):
        for b in range(a, 12):
            for o in range(a + 1):
                (even, below), (_, above) = keys(universe[:a]), keys(np.concatenate([universe[a - o : a], universe[a : a + b - o]]))
                met = set(even) & (set(above) if b > a else set(keys(np.concatenate([universe[a - o : a], universe[a : a + b - o]]))[0]))
                assert bool(met) == (100 * o >= 75 * (a + b - o)), (a, b, o)
                assert not set(even) & set(below)


def test_hot_subsets_of_small_sets(spark, monkeypatch):
    """A third of the rows share all but two words: names that are salted, with and without a set of the smaller size."""
    monkeypatch.setattr("tickweave.llm.ngram_join.boundary", lambda *_: 12)
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(10**6)}"
    base, other = [word() for _ in range(10)], [word() for _ in range(11)]
    texts = [" ".join([*base, word(), word()]) for _ in range(200)] + [" ".join([*other, word(), word()]) for _ in range(150)]
    texts += [" ".join([*other, word()]) for _ in range(20)] + [" ".join(word() for _ in range(rng.randint(1, 18))) for _ in range(100)]
    rows = list(enumerate(texts, 100))
    for more in ([], [(1, " ".join(base))]):
        some = rows + more
        rng.shuffle(some)
        df = spark.createDataFrame(some, "doc_id bigint, text string").repartition(3)
        assert sorted(map(tuple, ngram_join(df).collect())) == brute(some)


def test_boundary_follows_costs():
    assert boundary({}, 1.0, 75, 100) == 0
    assert boundary({3: 1000}, 1e6, 75, 100) >= 3
    assert boundary({12: 1000}, 0.0, 75, 100) < 12


def test_small_sets_one_shingle_apart_meet_beside_long_lists(spark, monkeypatch):
    monkeypatch.setattr("tickweave.llm.ngram_join.boundary", lambda *_: 12)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = " ".join(word() for _ in range(40))
    texts = [passage + " " + " ".join(word() for _ in range(rng.randint(3, 50))) for _ in range(60)]
    for size in range(7, 14):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts += [" ".join(base), " ".join([*base, word()])]
    rows = list(enumerate(texts, 100))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert sorted(map(tuple, ngram_join(df).collect())) == brute(rows)


def test_list_entries_are_dealt_to_tasks_that_grow_with_the_table():
    one = list_tasks(40_000_000, {}, 0, 75, 100)
    assert one == 10_000_000 // TASK_ENTRIES and list_tasks(400_000_000, {}, 0, 75, 100) == 10 * one
    assert list_tasks(0, {12: 1_000_000}, 12, 75, 100) > list_tasks(0, {12: 1_000_000}, 11, 75, 100) == 0
