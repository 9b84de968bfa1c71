"""Source divergence audit: how far the term shares of sources lie apart, by three-dimensional cube partitioning.

Two passes over the texts count terms: the documents of a language that hold each, which tells the kept ones, then their
occurrences in each source; between them stands a Bloom filter of the kept terms, so that rare terms, most of all, are
never shuffled with their source. The kept terms of a language are dealt into term blocks, its sources into group
blocks. A cell of the cube is a pair of group blocks and a term block: a task has the slices of these sources in this
term block, as dense integers, and gives the partial divergence of each pair. A slice is copied to as many cells as
there are group blocks. Partial divergences are summed along the term axis. All is counted in integers, so results do
not depend on how the cube is cut.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import Bits, filter_of
from .common import PIECE_BYTES, forget, keep, raw_texts, small

#: Fixed values of the shares: what each count is raised by, and the whole that they are parts of.
PRIOR, SCALE = 5, 1_000_000_000
#: Sources and kept terms of a block, on average: a cell compares so many by so many over so many.
GROUP_BLOCK, TERM_BLOCK = 16, 512
#: Terms of all sources that a task counts before it passes the counts on, and rows of a batch of them.
FLUSH, BATCH = 500_000, 20_000
#: Rows of the tables of sources, languages and blocks that may be broadcast.
BROADCAST_ROWS = 200_000

#: Every byte of a term as itself, A-Z in lower case; every other byte as a space. Bytes from 128 on are of terms.
_TERM_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE_BYTES)
        while end < len(raw) and _TERM_BYTES[raw[end]] != 32:
            end += 1
        yield raw[at:end].translate(_TERM_BYTES).split()
        at = end


def _rows(names: list[str], of: tuple[str, ...], found: list[bytes], *counts: Counter) -> Iterator[pa.RecordBatch]:
    for some in (found[i : i + BATCH] for i in range(0, len(found), BATCH)):
        fixed = [pa.array([x] * len(some), pa.string()) for x in of]
        numbers = [pa.array([c[t] for t in some], pa.int64()) for c in counts]
        yield pa.RecordBatch.from_arrays([*fixed, pa.array(some, pa.binary()).cast(pa.string()), *numbers], names)


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a language that hold each term."""
    docs: dict[str, Counter] = {}
    size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, n in docs.items():
            yield from _rows(["lang", "term", "docs"], (lang,), list(n), n)
        docs.clear()

    for batch in batches:
        for lang, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
            n = docs.setdefault(lang, Counter())
            before = len(n)
            n.update(set().union(*terms(raw)))
            size += len(n) - before
            if size >= FLUSH:
                yield from rows()
                size = 0
    yield from rows()


def _count_kept(kept) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences in each source of the terms that a filter knows; '' stands for the source itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits.of(kept.value)
        counts: dict[tuple[str, str], Counter] = {}
        size = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), n in counts.items():
                found, seed = list(n), xxhash.xxh64_intdigest(lang.encode(), 42)
                hashes = np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in found), np.uint64, len(found))
                found = [found[i] for i in np.flatnonzero(known.holds(hashes))]
                yield from _rows(["lang", "source", "term", "n"], (lang, source), [b"", *found], n)
            counts.clear()

        for batch in batches:
            for lang, source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                n = counts.setdefault((lang, source), Counter())
                before = len(n)
                for piece in terms(raw):
                    n.update(piece)
                size += len(n) - before
                if size >= FLUSH:
                    yield from rows()
                    size = 0
        yield from rows()

    return run


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), in exact decimals."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * kept)) + 1


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of one cell: of its two group blocks, or within one."""
    width = table.column("width")[0].as_py()
    own, names = np.array(table.column("own").to_pylist()), table.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (own[i], names[i]))
    rest, at, share = (table.column(c).to_pylist() for c in ("rest", "at", "share"))
    dense = np.empty((len(order), width), np.int64)
    for row, i in enumerate(order):
        dense[row] = rest[i]
        dense[row, np.array(at[i], np.int64)] = share[i]
    own, names = own[order], [names[i] for i in order]
    within = own[0] == own[-1] and table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
    middle = int(np.searchsorted(own, own[0], "right"))
    a, b, value = [], [], []
    for i in range(len(names) if within else middle if own[0] != own[-1] else 0):
        start = i + 1 if within else middle
        a += [names[i]] * (len(names) - start)
        b += names[start:]
        value.append(np.abs(dense[start:] - dense[i]).sum(axis=1))
    lang = table.column("lang")[0].as_py()
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def source_divergence(docs: DataFrame, *, least_docs: int = 30, top: int = 50, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """Distances of the sources of a language from each other, and the terms that each uses more than its language does.

    Columns: lang, source, part, item, value, rank (from 1 by value, descending, then by the item's UTF-8). Part
    ``pair``: item is another source, value the sum of differences of their shares over the language's kept terms,
    all ranks. Part ``term``: item is a kept term of the source, value how much larger its share is than in the
    language, up to rank ``top``. Kept are terms of at least ``least_docs`` documents of the language.

    Null text, lang and source are ''. Each row is a document, also where rows or ids repeat. Sources without a term,
    and languages without a kept one, have their pairs all the same (0 where nothing is kept). Texts of any length are
    taken whole; other columns are ignored. An empty table gives no rows.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    held = rows.select("lang", "text").mapInArrow(_count_documents, "lang string, term string, docs long")
    common = keep(held.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).select("lang", "term"), "divergence-terms")
    known = docs.sparkSession.sparkContext.broadcast(filter_of(common.select(F.xxhash64("lang", "term").alias("h"))))  # of fixed size
    counted = rows.mapInArrow(_count_kept(known), "lang string, source string, term string, n long")
    counts = keep(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "divergence-counts")
    words = counts.filter("term <> ''").join(common, ["lang", "term"], "left_semi")
    kept = keep(words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n")), "divergence-kept")
    forget(common)

    # Languages with their kept terms and blocks; kept terms with their block and place in it.
    sources = counts.filter("term = ''").select("lang", "source")
    size = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    langs = sources.groupBy("lang").agg(F.ceil(F.count("*") / group_block).cast("int").alias("group_blocks")).join(size, "lang", "left").na.fill(0, ["v", "lang_total"])
    langs = keep(langs.withColumn("term_blocks", F.greatest(F.lit(1), F.ceil(F.col("v") / term_block)).cast("int")), "divergence-langs")
    named = kept.join(small(langs.select("lang", "term_blocks"), BROADCAST_ROWS), "lang").withColumn("block", F.pmod(F.xxhash64("term"), F.col("term_blocks")).cast("int")).drop("term_blocks")
    named = named.withColumn("at", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    entries = keep(counts.join(named, ["lang", "term"]), "divergence-entries")

    total = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = sources.join(total, ["lang", "source"], "left").na.fill(0, ["total"]).join(small(langs, BROADCAST_ROWS), "lang")
    groups = groups.withColumn("own", F.pmod(F.xxhash64("source"), F.col("group_blocks")).cast("int"))
    groups = keep(groups.withColumn("rest", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total"), F.col("v"))).otherwise(0).cast("long")), "divergence-groups")
    forget(counts, kept)
    shares = entries.join(small(groups.select("lang", "source", "total", "v", "lang_total"), BROADCAST_ROWS), ["lang", "source"])
    shares = shares.withColumn("share", _share(F.col("n"), F.col("total"), F.col("v")))

    over = F.col("share") - _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    distinctive = _ranked(shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), over.alias("value")).filter("value > 0")).filter(F.col("rank") <= top)

    # Slices: every source in every term block, then a copy for each cell that needs it.
    slices = shares.groupBy("lang", "source", "block").agg(F.collect_list(F.struct("at", "share")).alias("has"))
    widths = entries.groupBy("lang", "block").agg((F.max("at") + 1).alias("width"))
    everywhere = groups.select("lang", "source", "own", "rest", "group_blocks", F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1)).alias("block"))
    everywhere = everywhere.join(small(keep(widths, "divergence-widths"), BROADCAST_ROWS), ["lang", "block"], "left").na.fill(0, ["width"])
    slices = everywhere.join(slices, ["lang", "source", "block"], "left")
    slices = slices.withColumns({c: F.coalesce(f"has.{c}", F.array().cast(f"array<{kind}>")) for c, kind in (("at", "int"), ("share", "bigint"))}).drop("has")
    copies = slices.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("group_blocks") - 1))).withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")})
    partial = copies.groupBy("lang", "bi", "bj", "block").applyInArrow(_cell, "lang string, a string, b string, value long")
    pairs = partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = _ranked(pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value"))
    columns = ["lang", "source", "part", "item", F.col("value").cast("long").alias("value"), "rank"]
    return pairs.select(columns).unionByName(distinctive.select(columns))
