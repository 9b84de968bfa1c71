"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are folded: lower-cased, and every run of other characters than letters and digits becomes a space.
An item of m folded characters may be matched with k = m // chars_per_error edits. It is split into k + 1 pieces; k
edits cannot touch all of them, so any match holds one piece exactly. One Aho-Corasick automaton finds all pieces in a
text, and Myers' bit-parallel algorithm verifies each place, giving the exact edit distance.

Items go to the tasks in blocks of about BLOCK_CHARS characters at most. One block is one lazy pass; of more, each is a
pass of its own whose result is written before the next block is read, so that neither the driver nor a task ever holds
more than one block.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, keep

#: One edit is allowed for so many folded characters of an item (rounded down).
CHARS_PER_ERROR = 16
#: Characters of items that one pass carries, a bound on what is collected and broadcast.
BLOCK_CHARS = 2_000_000
_OTHERS = re.compile(r"[\W_]+")


def fold(text: str | None) -> str:
    return _OTHERS.sub(" ", (text or "").lower()).strip()


class Matcher:
    """Finds items in texts within their edit budgets."""

    def __init__(self, items: list[tuple[str, list]], chars_per_error: int = CHARS_PER_ERROR) -> None:
        """items: folded text and the ids that have it."""
        import ahocorasick

        self.items, self.budget, self.masks = items, [], []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (text, _) in enumerate(items):
            m = len(text)
            k = m // chars_per_error
            self.budget.append(k)
            masks: dict[str, int] = {}
            for j, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << j
            self.masks.append(masks)
            cuts = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces[text[a:b] if k else f" {text} "].append((i, b if k else m + 1))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, places)
        if pieces:
            self.automaton.make_automaton()

    def distance(self, i: int, text: str) -> tuple[int, int]:
        """Least edit distance between item i and any part of text, and where that part ends."""
        masks, m = self.masks[i], len(self.items[i][0])
        full, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = full, 0, m
        best, end = m, 0
        for at, c in enumerate(text):
            equal = masks.get(c, 0)
            vertical = equal | minus
            horizontal = (((equal & plus) + plus) ^ plus) | equal
            up = minus | (full & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
                if score < best:
                    best, end = score, at + 1
            up <<= 1
            plus = (down << 1 | ~(vertical | up)) & full
            minus = up & vertical & full
        return best, end

    def __call__(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item index, distance, end in the folded text) of the best match of each item that the text holds."""
        folded = f" {fold(text)} "
        if not len(self.automaton) or len(folded) < 3:
            return []
        found: dict[int, tuple[int, int]] = {}
        looked: dict[int, set[int]] = defaultdict(set)
        for last, places in self.automaton.iter(folded):
            for i, offset in places:
                k, m = self.budget[i], len(self.items[i][0])
                start = last + 1 - offset
                if not k:
                    found[i] = (0, start + m)
                    continue
                if i in found and not found[i][0]:
                    continue
                # Starts that fall in one window of 2k + 1 are looked at together.
                window = start // (2 * k + 1)
                if window in looked[i]:
                    continue
                looked[i].add(window)
                a = max(0, window * (2 * k + 1) - k)
                d, end = self.distance(i, folded[a : (window + 1) * (2 * k + 1) + m + k])
                if d <= k and (i not in found or (d, a + end) < found[i]):
                    found[i] = (d, a + end)
        return sorted((i, d, end) for i, (d, end) in found.items())


def _block_count(rows: DataFrame) -> int:
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total * 2 // BLOCK_CHARS))


def _passes(items: DataFrame, id_col: str, text_col: str, chars_per_error: int) -> Iterator[tuple[Callable, Broadcast, bool]]:
    """For each block of items a function text -> array of (item, distance, end), its broadcast, and whether there are more blocks."""
    kind = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())]))
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    n = _block_count(rows)

    def finder(shared: Broadcast) -> Callable:
        made: list[Matcher] = []

        @F.pandas_udf(kind)
        def find(text: pd.Series) -> pd.Series:
            if not made:
                made.append(Matcher(shared.value, chars_per_error))
            m = made[0]
            return pd.Series([[{"item": x, "distance": d, "end": e} for i, d, e in m(t) for x in m.items[i][1]] for t in text])

        return find

    for block in range(n):
        by: dict[str, list] = defaultdict(list)
        for r in rows.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == block).collect():
            if key := fold(r["text"]):
                by[key].append(r["id"])
        shared = items.sparkSession.sparkContext.broadcast([(key, sorted(set(by[key]), key=lambda x: (x is None, x))) for key in sorted(by)])
        yield finder(shared), shared, n > 1


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """Where texts hold test items: rows (id, item_id, distance, end), the best match of each text and item.

    ``end`` counts characters of the folded text. Items of fewer than ``chars_per_error`` folded characters must
    occur exactly, between spaces. Null, empty and unlettered texts match nothing and are matched by nothing. Repeated
    items are matched each; repeated texts give repeated rows; ties between places go to the first. Rows with a null
    id are matched and returned with it. Empty tables on either side give no rows. Other columns are not read.
    """
    out = None
    for find, shared, more in _passes(items, item_col, item_text_col, chars_per_error):
        found = docs.select(F.col(id_col), find(F.col(text_col)).alias("found")).filter(F.size("found") > 0)
        found = found.select(id_col, F.explode("found").alias("m")).select(id_col, F.col("m.item").alias("item_id"), F.col("m.distance").alias("distance"), F.col("m.end").alias("end"))
        if more:
            found = keep(found, "decontaminate-found")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """The rows of docs that hold no test item, with their columns. Of several blocks each sees what the last one kept."""
    rows, before = docs, None
    for find, shared, more in _passes(items, item_col, item_text_col, chars_per_error):
        rows = rows.filter(F.size(find(F.col(text_col))) == 0)
        if more:
            rows = keep(rows, "decontaminate-clean")
            shared.destroy()
            forget(before)
            before = rows
    return rows
