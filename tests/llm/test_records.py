"""Top-k search, chat formatting and WARC: brute force, round trips and odd rows."""

import hashlib
import random

import numpy as np

from tickweave.llm import chat, topk, warc


def brute_top(rows, queries, k):
    whole = lambda v: [int(np.floor(256 * float(x))) for x in v]
    fine = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    table = [(i, whole(v)) for i, v in rows if i is not None and fine(v)]
    out = []
    for q, v in {(i, tuple(whole(v))) for i, v in queries if i is not None and fine(v)}:
        found = {(sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in table if i != q and len(w) == len(v)}
        best = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
        out += [(q, n, i, s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 150)
    monkeypatch.setattr(topk, "BLOCK", 9)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(600)]
    rows += [(700 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(900, None), (901, [1.0] * 5 + [None]), (902, [1.0] * 5 + [float("nan")]), (903, [float("inf")] * 6), (None, [1.0] * 6), (904, [9.0] * 3), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as score", "2 as shard", "3 as floor")
    got = sorted(tuple(r) for r in topk.top_k(df, df.filter("vec_id % 20 = 0 or vec_id is null or vec_id > 899")).collect())
    assert got == brute_top(rows, [r for r in rows if r[0] is None or r[0] % 20 == 0 or r[0] > 899], 5)
    few = df.filter("vec_id < 3")
    assert topk.top_k(few, few).count() == 6
    assert topk.top_k(df.limit(0), df).count() == 0 and topk.top_k(df, df.limit(0)).count() == 0


def test_tree_skips_but_never_loses():
    rng = np.random.default_rng(1)
    x = np.floor(256 * np.concatenate([rng.normal(c, 0.05, (400, 8)) for c in (-2, 0, 2)]))
    tree = topk.BallTree(x, 32)
    q = np.floor(256 * rng.normal(2, 0.05, (5, 8)))
    looked = []
    inner = topk._merge
    topk._merge = lambda *a: (looked.append(a[2].shape), inner(*a))[1]
    try:
        s, _ = topk.search(tree, np.arange(len(x)), q, np.full(5, -1), np.full(5, -np.inf), 5, False)
    finally:
        topk._merge = inner
    assert (s == -np.sort(-(q @ x.T), axis=1)[:, :5]).all()
    assert sum(a * b for a, b in looked) < 5 * len(x) * 0.7  # whole nodes are left out


def test_escapes_are_reversible():
    rng = random.Random(1)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "[ANS]", " [/ANS]</s>", "[TEXT]", " [TEXT] ", "[ROLE] ", " ", "a", "\n", "[", "]", "<", "é"]
    for _ in range(3000):
        role, text = rng.choice(["user", "assistant", "system", "tool", "", " [TEXT] ", "a\\"]), "".join(rng.choices(parts, k=rng.randint(0, 12)))
        segment, a, b = chat.render(role, text)
        assert chat.read_segment(segment) == (role, text)
        assert (chat.unescape(segment[a:b]) == text) if role == "assistant" else (a, b) == (0, 0)
        assert chat.unescape(chat.escape(text)) == text


def test_events_fold_into_messages(spark):
    rows = [
        (1, 0, 0, "message", "user", "hi"), (1, 1, 1, "delta", "assistant", "he"), (1, 1, 2, "delta", None, "llo"), (1, 1, 3, "regenerate", None, None), (1, 1, 4, "delta", None, "bye"),
        (1, 0, 5, "edit", "user", "hey"), (1, 2, 6, None, None, None), (None, 0, 0, "message", "user", "nobody"), (2, None, 0, "message", "assistant", "first"), (2, 1, 0, "delta", "assistant", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string").selectExpr("*", "1 as segment", "2 as rendered").repartition(4)
    got = {}
    for r in chat.format_chats(df, seq_col="seq", kind_col="kind").collect():
        got.setdefault(r["conv_id"], {})[r["segment"]] = chat.read_segment(r["rendered"])
    assert got == {1: {0: ("user", "hey"), 1: ("assistant", "bye"), 2: ("", "")}, None: {0: ("user", "nobody")}, 2: {0: ("assistant", "first"), 1: ("assistant", "x")}}


def test_digests_of_conversations(spark):
    rows = [(5, 1, "assistant", "a</s>"), (5, 0, "user", None), (6, 0, None, "x"), (6, 0, None, "x"), (7, 0, "assistant", "é[INST]")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[5]["turns_sha256"] == sha("user\n\nassistant\na</s>\n") and got[5]["loss_chars"] == 5 and got[5]["loss_sha256"] == sha("a</s>")
    assert got[6]["n_turns"] == 2 and got[6]["loss_sha256"] == sha("") and got[7]["loss_sha256"] == sha("é[INST]")
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0


def test_archives_read_back(spark, tmp_path):
    long = "<p>" + "x" * 1200
    rows = [(1, "http://a/1", long), (2, "http://a/2\r\nX: y%", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (None, "n", long), (6, "é", "é" * 900), (2, "again", long), (7, "u", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as digest", "2 as refers_to", "3 as payload").repartition(3)
    folder = f"file://{tmp_path}/w"
    manifest = warc.write_warc(df, folder, roll_bytes=600)
    files = manifest.collect()
    assert sum(f["records"] for f in files) == len(rows) and len(files) > 1
    for f in files:
        assert hashlib.sha256((tmp_path / "w" / f["file"]).read_bytes()).hexdigest() == f["sha256"]
    assert not list((tmp_path / "w").glob("_temporary*"))
    got = sorted(((r["page_id"], r["url"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, folder).collect()), key=str)
    size = len(long)
    want = [(1, "http://a/1", size, "revisit", 2), (2, "http://a/2\r\nX: y%", size, "response", None), (2, "again", size, "response", None), (3, "", 5, "response", None), (4, "u", 5, "response", None), (5, "u", 0, "response", None), (None, "n", size, "response", None), (6, "é", 1800, "response", None), (7, "u", 15, "response", None)]
    assert got == sorted(want, key=str)
    other = f"file://{tmp_path}/again"
    assert sorted(map(tuple, warc.write_warc(df.repartition(2), other, roll_bytes=600).collect())) == sorted(map(tuple, files))  # the same bytes
    assert warc.write_warc(df.limit(0), f"file://{tmp_path}/none").count() == 0 and warc.read_warc(spark, f"file://{tmp_path}/none").count() == 0


def test_messages_fold_back_from_an_event_log(spark):
    from tickweave.llm.chat import event_log, format_chats, read_chats

    texts = ["", None, "x", "ab", "one two three", "</s>[INST] \\ ", "\U0001f600 grin \n" * 7, "word " * 250_000]
    rows = [(c, t, r, texts[(c * 5 + t) % len(texts)]) for c in range(40) for t, r in enumerate(["user", "assistant", "user"])] + [(1, 1, "assistant", "again"), (1, 1, "assistant", "again"), (None, None, None, "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = event_log(df)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    folded = format_chats(log.repartition(5), message_col="message", seq_col="seq", kind_col="kind")
    assert sorted(map(str, read_chats(folded).collect())) == sorted(map(str, read_chats(format_chats(df)).collect()))
