"""Registered queries of the corpus operators, over whole tables with production parameters, and SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import chat as _chat
from . import decontaminate as _decontaminate
from . import divergence as _divergence
from . import filter_audit as _audit
from . import html_text as _html
from . import langid as _langid
from . import licenses as _licenses
from . import line_dedup as _lines
from . import mixing as _mixing
from . import ngram_join as _ngram
from . import quality as _quality
from . import topk as _topk
from . import warc as _warc
from .common import held_out, shared_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ngram.ngram_join(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html.extract(_table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licenses.licenses(_table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return _topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, whose texts hold control strings of a template, from a log of their events."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    log = _chat.event_log(rows.unionByName(extra))
    return _chat.read_chats(_chat.format_chats(log, message_col="message", seq_col="seq", kind_col="kind"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "epoch", F.round("place", 9).alias("place"), F.round("repeat_rate", 9).alias("repeat_rate"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "warc")
    _warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return _warc.read_warc(spark, folder).drop("url")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _langid.language(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divergence.source_divergence(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.line_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_ngram_join": op2_ngram_join,
    "op3_html_text": op3_html_text,
    "op4_decontaminate": op4_decontaminate,
    "op5_licenses": op5_licenses,
    "op6_top_k": op6_top_k,
    "op7_mixing": op7_mixing,
    "op8_chat": op8_chat,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_divergence": op11_divergence,
    "op12_filter_audit": op12_filter_audit,
    "op13_line_dedup": op13_line_dedup,
}
ORACLES: dict[str, str] = {
    "op2_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
        e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS o FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p WHERE 100 * o >= 75 * (an + bn - o)),
        links AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT links.b, r.root FROM r JOIN links ON links.a = r.doc_id)
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, (SELECT min(root) FROM r WHERE r.doc_id = s.doc_id) AS component_id FROM s
    """,
    "op6_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
              FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5
    """,
    "op8_chat": """
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(regexp_replace(text, '([\\\\]|</?s>|\\[/?(SYS|INST|ANS|ROLE|TEXT)\\])', '.\\1', 'g'))
                   + CASE role WHEN 'system' THEN 16 WHEN 'user' THEN 18 WHEN 'assistant' THEN 20 ELSE 26 + length(role) END) AS BIGINT) AS formatted_chars
        FROM c GROUP BY conv_id
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
        r AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS top FROM d)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM r
    """,
    "op11_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        w AS (SELECT r, lang, source, unnest(ts) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM w GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        e AS (SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
        s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, sum(lang_n) OVER (PARTITION BY lang, source) AS lang_total, count(*) OVER (PARTITION BY lang, source) AS v FROM e),
        p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS p,
                     1 + (1000000000::HUGEINT * (lang_n + 5)::HUGEINT) // (lang_total + 5 * v)::HUGEINT AS q FROM s),
        b AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
                  LEFT JOIN b AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM u QUALIFY part = 'pair' OR rank <= 50
    """,
    "op12_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
        m AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
        b AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels GROUP BY doc_id),
        f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                     [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
                      regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM m LEFT JOIN b USING (doc_id)),
        c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l AS p, l AS q, l AS r, l AS s, l AS t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
        x AS (SELECT part, filter_order, step, substring(filter_order, step, 1) AS letter, n, good, toxic, fails[ascii(substring(filter_order, step, 1)) - 64] AS here,
                     len(list_filter(range(1, step), lambda i: fails[ascii(substring(filter_order, i, 1)) - 64])) > 0 AS gone, len(list_filter(fails, lambda v: v)) = 1 AS one
              FROM c, o, (SELECT unnest(range(1, 6)) AS step)),
        y AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (WHERE NOT gone AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (WHERE NOT gone AND here), 0) AS removed,
                     coalesce(sum(n) FILTER (WHERE gone AND here), 0) AS redundant, coalesce(sum(n) FILTER (WHERE one AND here), 0) AS unique_fails,
                     coalesce(sum(good) FILTER (WHERE NOT gone AND here), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE NOT gone AND here), 0) AS toxic_lost FROM x GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM y
    """,
    "op13_line_dedup": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
        k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
        b AS (SELECT line_key, true AS bad FROM k WHERE line_key <> '' GROUP BY line_key HAVING count(DISTINCT r) >= 10)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(bad) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad IS NULL), '')) AS kept_sha256
        FROM k LEFT JOIN b USING (line_key) GROUP BY r
    """,
}
