"""Filter interaction audit: what each of some filters removes, alone and behind the others, in every order.

Every text becomes a mask of the filters that it fails, and masks are counted by part before anything is gathered: a
part is then at most 32 counted masks, whatever its size. Over these a count-weighted decision diagram is built: one
level a filter, an edge for passing and one for failing, equal sub-diagrams shared, empty ones left out, and each node
weighs what lies below it. Orders are visited by swaps of two adjacent levels, which change the nodes of these two
levels only; in each order the path that passes every filter gives the steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, keep, raw_texts

FILTERS = "ABCDE"
#: Fixed values of the filters: least words, least share of distinct words, largest share of capitals, in hundredths.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
SYMBOLS, CAPITALS = b"#$%&*|", bytes(range(65, 91))
#: Weights of a node: documents, good ones, toxic ones.
NOTHING = (0, 0, 0)


def text_mask(raw: bytes, code_points: int) -> int:
    """The filters A to D that a text fails, A as the lowest bit."""
    n, distinct, at = 0, set(), 0
    while at < len(raw):  # in pieces that end at white space, so that a long text never is a list of all its words
        end = min(len(raw), at + PIECE_BYTES)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        words = raw[at:end].split()
        n, at = n + len(words), end
        distinct.update(words)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (n < LEAST_WORDS) | (100 * len(distinct) < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * code_points) << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        points = pc.fill_null(pc.utf8_length(texts), 0).to_pylist()
        raws = raw_texts(texts)
        digests = pa.array([blake2b(x, digest_size=16).digest() for x in raws], pa.binary())
        masks = pa.array([text_mask(x, n) for x, n in zip(raws, points, strict=True)], pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), digests, batch.column(2), masks], ["doc_id", "digest", "part", "mask"])


class Diagram:
    """A decision diagram of counted masks. Nodes of a level are pairs of the nodes below: passed, failed."""

    def __init__(self, counts: dict[int, tuple[int, ...]], filters: int) -> None:
        self.order = list(range(filters))
        self.unique: list[dict[tuple, int]] = [{} for _ in range(filters + 1)]  # of a level, by children; leaves last
        self.children: dict[int | None, tuple] = {None: (None, None)}
        self.weight: dict[int | None, tuple[int, ...]] = {None: NOTHING}
        self._next = 0
        self.root = self._build(counts, 0)

    def _build(self, counts: dict[int, tuple[int, ...]], level: int) -> int | None:
        if not counts:
            return None
        if level == len(self.order):
            return self._leaf(next(iter(counts.values())))
        bit = 1 << level
        sides = ({m: c for m, c in counts.items() if bool(m & bit) == failed} for failed in (False, True))
        return self._node(level, *(self._build(x, level + 1) for x in sides))

    def _new(self, level: int, key: tuple, children: tuple, weight: tuple[int, ...]) -> int:
        self._next += 1
        self.unique[level][key], self.children[self._next], self.weight[self._next] = self._next, children, weight
        return self._next

    def _leaf(self, counts: tuple[int, ...]) -> int:
        return self.unique[-1].get(counts) or self._new(-1, counts, (None, None), counts)

    def _node(self, level: int, passed: int | None, failed: int | None) -> int | None:
        if passed is None and failed is None:
            return None
        key = (passed, failed)
        return self.unique[level].get(key) or self._new(level, key, key, tuple(a + b for a, b in zip(self.weight[passed], self.weight[failed], strict=True)))

    def swap(self, level: int) -> None:
        """Let two adjacent levels change places. Nodes of the upper one keep name and weight, so nothing above changes."""
        upper, lower = self.unique[level], self.unique[level + 1]
        self.unique[level], self.unique[level + 1] = {}, {}
        for (passed, failed), node in upper.items():
            (pp, pf), (fp, ff) = self.children[passed], self.children[failed]
            key = (self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
            self.children[node], self.unique[level][key] = key, node
        for gone in lower.values():
            del self.children[gone], self.weight[gone]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """Filter, weight of what is kept after it and of what it removes, along the path that passes all."""
        at = self.root
        for which in self.order:
            passed, failed = self.children[at]
            yield which, self.weight[passed], self.weight[failed]
            at = passed

    def only(self, which: int) -> tuple[int, ...]:
        """Weight of what fails one filter and passes all others."""
        at = self.root
        for level in self.order:
            at = self.children[at][level == which]
        return self.weight[at]


def adjacent_swaps(n: int) -> Iterator[int]:
    """Places of swaps of neighbours that lead through all orders of n items, each once: the last item sweeps through
    the others from end to end, and between two sweeps these make their own next swap."""
    if n < 2:
        return
    left = True
    yield from range(n - 2, -1, -1)
    for inner in adjacent_swaps(n - 1):
        yield inner + left  # the item that sweeps stands left of the others, or right
        left = not left
        yield from range(n - 2, -1, -1) if left else range(n - 1)


def audit_part(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> Iterator[tuple]:
    """The rows of one part: order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    diagram, names = Diagram(counts, len(filters)), range(len(filters))
    fails = [sum(c[0] for m, c in counts.items() if m >> i & 1) for i in names]
    alone = [diagram.only(i)[0] for i in names]
    rows, removed = [], [0] * len(filters)

    def note() -> None:
        order = "".join(filters[i] for i in diagram.order)
        for step, (i, kept, gone) in enumerate(diagram.steps(), 1):
            removed[i] += gone[0]
            rows.append((i, order, step, kept[0], gone[0], fails[i] - gone[0], alone[i], gone[1], gone[2]))

    note()
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        note()
    for i, *row in rows:
        yield (*row, removed[i])


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    for batch in batches:
        for part, counted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows = audit_part({c["mask"]: (c["n"], c["good"], c["toxic"]) for c in counted})
            columns = zip(*((part, *r) for r in rows), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def audit(counts: DataFrame) -> DataFrame:
    """The steps of all orders of five filters, for each part of a table of counted masks.

    counts: part, mask (bit i: fails filter i), n, good, toxic; one row for each part and mask. A part with one mask
    gets all rows too, zeros included; without rows there is no part.
    """
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic"))).mapInArrow(_audit, RESULT)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, good and toxic ones among them, by source and mask of failures: the input of ``audit``.

    A text is a copy (E) where a smaller id has the same text, by a 128-bit digest. The least id of each text is an
    aggregation, and rows look for it under digest and id together, so that the rows of a large group of copies never
    meet in one task.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = keep(rows.mapInArrow(_masks, f"doc_id {kind}, digest binary, part string, mask int"), "audit-masks")
    first = seen.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.filter("quality = 1 or toxic = 1").groupBy("doc_id").agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    marked = seen.join(marks, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(copy, 16).otherwise(0)
    some = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return marked.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), some("good"), some("toxic"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What the five filters do to each source in all 120 orders: a row for each source, order and step.

    Filters by failure: A under 200 words; B fewer than half of the words distinct; C more than 2 % of the code points
    A-Z; D one of ``#$%&*|``; E the same text under a smaller doc_id, anywhere in the table. Counts are of rows: kept
    after the step, removed by it, redundant (failing its filter, but removed before), unique_fails (failing no other),
    good_lost and toxic_lost (removed by it, with a label of 1), shapley (removed by its filter, summed over all orders).

    A null text is an empty one; a null source is the part ''. Rows with a null id are never copies, as no id is
    smaller than none, and have no labels; of rows that share id and text none is a copy of the other. An id with
    several labels counts as good, or toxic, if one says so; null labels say nothing. Texts of any length are taken
    whole, other columns ignored. An empty table gives no rows.
    """
    return audit(failure_counts(docs, labels))
