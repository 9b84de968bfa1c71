"""Source divergence, filter interaction and line dedup against brute force, and the cases that their docstrings state."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from tickweave.llm.divergence import source_divergence
from tickweave.llm.filter_audit import adjacent_swaps, audit_part, filter_audit
from tickweave.llm.line_dedup import line_dedup

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that no operator reads, named like their own.
SCHEMA = "doc_id long, text string, lang string, source string, part string, value long, mask int, digest string, term string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], SCHEMA).repartition(3)


# --- source divergence ----------------------------------------------------------------------------------------------
def brute_divergence(rows, least_docs, top):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
        groups.add((lang or "", source or ""))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        share = {}
        for s in [s for g, s in groups if g == lang]:
            n = sum(counts[lang, s][t] for t in kept)
            share[s] = {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (n + 5 * len(kept)) for t in kept}
        n = {t: sum(counts[lang, s][t] for s in share) for t in kept}
        q = {t: 1 + 10**9 * (n[t] + 5) // (sum(n.values()) + 5 * len(kept)) for t in kept}
        for s in share:
            pairs = [(sum(abs(share[s][t] - share[o][t]) for t in kept), o) for o in share if o != s]
            terms = [(share[s][t] - q[t], t) for t in kept if counts[lang, s][t] and share[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def some_sources(rng):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["été", "ÉTÉ", "naïve", "日本", "\U0001f600x"]
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de", "zz", None])
        source = rng.choice([f"s{j}" for j in range(9)] + ["hot"] * 6 + [None])
        text = rng.choice([" ", "\n", "1", "-", "\x00", " "]).join(rng.choices([w.title() if rng.random() < 0.3 else w for w in words], k=rng.randint(0, 40)))
        rows.append((i, rng.choice([text, text, text, "", None]), lang, source))
    return rows + [(999, "lonely word", "fr", "one"), (999, "lonely word", "fr", "two"), (1000, None, "it", "only")]


@pytest.mark.parametrize("blocks", [{}, {"group_block": 2, "term_block": 7}])
def test_divergence_equals_brute_force(spark, blocks):
    rows = some_sources(random.Random(3))
    got = source_divergence(table(spark, rows), least_docs=4, top=6, **blocks)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, 4, 6)


def test_divergence_of_long_text_and_empty_table(spark):
    rng = random.Random(4)
    long = " ".join(rng.choice(["aa", "Bb", "cc"]) + rng.choice("xyz") for _ in range(300_000))  # over a megabyte
    rows = [(1, long, "en", "a"), (2, "aax bby", "en", "b"), (2, "aax bby", "en", "b")]
    assert sorted(tuple(r) for r in source_divergence(table(spark, rows), least_docs=2).collect()) == brute_divergence(rows, 2, 50)
    empty = source_divergence(table(spark, rows).limit(0))
    assert empty.count() == 0 and empty.columns == ["lang", "source", "part", "item", "value", "rank"]


# --- filter interaction ---------------------------------------------------------------------------------------------
def brute_steps(counts):
    out, removed = [], Counter()
    for order in permutations(range(5)):
        alive = dict(counts)
        for step, i in enumerate(order, 1):
            gone = [c for m, c in alive.items() if m >> i & 1]
            alive = {m: c for m, c in alive.items() if not m >> i & 1}
            here, fails = sum(c[0] for c in gone), sum(c[0] for m, c in counts.items() if m >> i & 1)
            removed[i] += here
            out.append((i, "".join("ABCDE"[x] for x in order), step, sum(c[0] for c in alive.values()), here, fails - here, counts.get(1 << i, (0,))[0], sum(c[1] for c in gone), sum(c[2] for c in gone)))
    return sorted((*row, removed[i]) for i, *row in out)


def brute_audit(rows, labels):
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    parts = defaultdict(lambda: defaultdict(lambda: (0, 0, 0)))
    for doc, text, _, source in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search(r"[#$%&*|]", text)), doc is not None and doc > least[text]]
        mask = sum(f << i for i, f in enumerate(fails))
        marks = [any(x[k] == 1 for x in labels if doc is not None and x[0] == doc) for k in (1, 2)]
        parts[source or ""][mask] = tuple(a + b for a, b in zip(parts[source or ""][mask], (1, *marks), strict=True))
    return sorted((part, *row) for part, counts in parts.items() for row in brute_steps(counts))


def test_swaps_lead_through_all_orders():
    order, seen = list("ABCDE"), set()
    for k in [None, *adjacent_swaps(5)]:
        if k is not None:
            order[k], order[k + 1] = order[k + 1], order[k]
        seen.add("".join(order))
    assert len(seen) == 120 == len(list(adjacent_swaps(5))) + 1


@pytest.mark.parametrize("seed", range(12))
def test_diagram_equals_brute_force(seed):
    rng = random.Random(seed)
    counts = {m: (rng.randint(1, 3), rng.randint(0, 1), rng.randint(0, 1)) for m in rng.sample(range(32), rng.randint(1, 32))}
    assert sorted(audit_part(counts)) == brute_steps(counts)


def test_audit_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", "short", "\n", "A" * 5 + " b" * 240, " ".join(f"w{i}" for i in range(230)), " ".join(f"w{i % 99}" for i in range(230)), "100 % of " + " ".join(f"é{i}" for i in range(200)), "a b " * 200 + "#"]
    texts += [" ".join(rng.choices([f"v{i}" for i in range(400)] + ["Up", "|"], k=rng.randint(150, 260))) for _ in range(20)]
    rows = [(rng.choice([i, i, i, None]), rng.choice(texts), "en", rng.choice(["a", "a", "a", "b", None, ""])) for i in range(150)]
    rows += [rows[0], rows[1], (400, "w " * 700_000, "en", "long")]  # repeated rows, and a text over a megabyte
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(0, 1, 0), (2, 0, 1), (None, 1, 1)]
    marks = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = filter_audit(table(spark, rows), marks)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)
    assert filter_audit(table(spark, rows).limit(0), marks).count() == 0
    assert filter_audit(table(spark, rows), marks.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


# --- line dedup -----------------------------------------------------------------------------------------------------
def brute_lines(rows, least, keep_first=False):
    key = lambda line: line.strip("\x20\t\n\v\f\r").translate(LOWER)
    docs, first = Counter(), {}
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        docs.update({key(x) for x in lines})
        for i, x in enumerate(lines):
            place = (doc is None, doc or 0, i)
            first[key(x)] = min(place, first.get(key(x), place))
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        gone = {i for i, x in enumerate(lines) if key(x) and docs[key(x)] >= least and not (keep_first and first[key(x)] == (doc is None, doc or 0, i))}
        out.append((str(doc), hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in gone).encode()).hexdigest(), len(lines), len(gone)))
    return sorted(out)


def some_lines(rng):
    common = ["Terms of Use", " terms of use\t", "© Site", "\x0bTERMS OF USE", "...", "Menu", "日本", "a" * 3000, "x"]
    rows = []
    for i in range(150):
        lines = [rng.choice([*common, "", " ", f"own {i} {rng.random()}", f"shared {rng.randint(0, 60)}"]) for _ in range(rng.randint(1, 12))]
        rows.append((rng.choice([i, i, i, 7, None]), rng.choice(["\n".join(lines)] * 8 + [None, "", "\n"]), "en", "s"))
    return [*rows, rows[3], rows[3], (500, "\n".join(f"line {i}" for i in range(100_000)) + "\nMenu", "en", "s")]


@pytest.mark.parametrize("how", [{}, {"broadcast_lines": 0}, {"bits": 1 << 18}, {"keep_first": True}, {"keep_first": True, "broadcast_lines": 0, "bits": 1 << 18}])
def test_lines_equal_brute_force(spark, how):
    rows = some_lines(random.Random(6))
    got = line_dedup(table(spark, rows), min_docs=4, **how).collect()
    assert sorted((str(r["doc_id"]), hashlib.sha256(r["text"].encode()).hexdigest(), r["n_lines"], r["n_dropped"]) for r in got) == brute_lines(rows, 4, how.get("keep_first", False))


def test_lines_of_an_empty_table_and_threshold(spark):
    docs = table(spark, [(1, "a", "en", "s")])
    assert line_dedup(docs.limit(0)).count() == 0
    assert line_dedup(docs).first()["text"] == "a"
    with pytest.raises(ValueError):
        line_dedup(docs, min_docs=1)
