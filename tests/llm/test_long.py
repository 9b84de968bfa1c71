"""Texts many times as long as the pieces in which they are read, through every query of the corpus operators."""

import random
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import assert_same
from test_join import brute

from tickweave.llm import queries
from tickweave.llm.common import PIECE_BYTES

NOTICE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
HELD_OUT = [i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 4 == 2]


@pytest.fixture(scope="module")
def folder(sf_dir, tmp_path_factory):
    """The small tables, to which long rows are added: half a million to two million bytes each."""
    out = tmp_path_factory.mktemp("long")
    read = lambda name: pq.read_table(f"{sf_dir}/{name}.parquet")
    rng = random.Random(3)
    words = " ".join(f"w{rng.randrange(10**7)}" for _ in range(70_000))
    near = words.split()
    near[500:505] = ["changed"] * 5
    docs, item = read("documents"), read("benchmark").column("text")[3].as_py()
    whole: dict[str, str] = {}
    for r in docs.to_pylist():
        if r["text"] and r["lang"]:
            whole[r["lang"]] = whole.get(r["lang"], "") + r["text"] + "\n"
    known = {i: (lang, (whole[lang] * (1 + 3 * PIECE_BYTES // len(whole[lang])))) for i, lang in zip(HELD_OUT, sorted(whole), strict=False)}
    texts = {2_000_001: words, 2_000_002: " ".join(near), 2_000_003: words + "\n" + item, 2_000_004: "x" * (8 * PIECE_BYTES), 2_000_005: " " * (4 * PIECE_BYTES), 2_000_006: "same " * (PIECE_BYTES // 2), 2_000_007: words + "\n" + NOTICE, 2_000_008: "line\n" * PIECE_BYTES}
    rows = [(i, t, lang, "long", len(t)) for i, (lang, t) in known.items()] + [(i, t, "xx", "long", len(t)) for i, t in texts.items()]
    more = pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), docs.schema, strict=True)], schema=docs.schema)
    pq.write_table(pa.concat_tables([docs, more]), out / "documents.parquet")
    pages, page = read("pages"), f"<html><body><nav>Menu</nav><article><p>{words}</p><p>end</p></article></body></html>"
    pq.write_table(pa.concat_tables([pages, pa.table([[2_000_001], ["http://long.example/a"], [page]], schema=pages.schema)]), out / "pages.parquet")
    talk = read("conversations")
    turns = pa.table([pa.array([2_000_001] * 2), pa.array([0, 1]), ["user", "assistant"], ["</s>" * PIECE_BYTES, words]], names=talk.column_names).cast(talk.schema)
    pq.write_table(pa.concat_tables([talk, turns]), out / "conversations.parquet")
    for name in ("benchmark", "labels", "embeddings"):
        pq.write_table(read(name), out / f"{name}.parquet")
    return str(out), known, words, item


@pytest.mark.parametrize("name", sorted(queries.ORACLES.keys() - {"op2_ngram_join", "op6_top_k"}))
def test_equal_to_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{folder[0]}/{t}.parquet'")
    assert_same(queries.QUERIES[name](spark, folder[0]).toPandas(), con.execute(queries.ORACLES[name]).df())


def test_join_equals_brute_force(spark, folder):
    """SQL's join does not end on texts of this length in useful time."""
    rows = pq.read_table(f"{folder[0]}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = sorted(map(tuple, queries.op2_ngram_join(spark, folder[0]).collect()))
    assert got == brute([(r["doc_id"], r["text"]) for r in rows])
    assert dict((r[0], r[2]) for r in got)[2_000_007] == 2_000_001


def test_languages_and_scores(spark, folder):
    path, known, _, _ = folder
    found = {r["doc_id"]: r for r in queries.op10_language(spark, path).collect()}
    assert {i: found[i]["lang_pred"] for i in known} == {i: lang for i, (lang, _) in known.items()}
    assert found[2_000_005]["lang_pred"] == "und"
    scores = {r["doc_id"]: r["score"] for r in queries.op1_quality(spark, path).collect()}
    assert len(scores) == len(found) and all(0 <= s <= 1 for s in scores.values())


def test_passages_at_the_end_are_found(spark, folder):
    path, _, _, _ = folder
    leaks = {(r["doc_id"], r["item_id"]) for r in queries.op4_decontaminate(spark, path).collect()}
    assert (2_000_003, 3) in leaks and not {d for d, _ in leaks} & {2_000_001, 2_000_002, 2_000_004, 2_000_005, 2_000_006, 2_000_008}
    held = {r["doc_id"] for r in queries.op5_licenses(spark, path).collect()}
    assert 2_000_007 in held and not held & {2_000_001, 2_000_002, 2_000_003, 2_000_004, 2_000_005, 2_000_006, 2_000_008}


def test_page_and_mixing(spark, folder):
    path, _, words, _ = folder
    (page,) = queries.op3_html_text(spark, path).filter("page_id = 2000001").collect()
    assert page["text"] == words + "\nend" and page["n_chars"] == len(words) + 4
    assert queries.op7_mixing(spark, path).filter("source = 'long'").count() > 0
