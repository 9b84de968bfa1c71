"""Similarity join of texts by the Jaccard index of their word shingles: a size-aware heavy-light join.

*Small* sets enumerate fixed-size subsets. Two sets of sizes a <= b reach the threshold exactly if they share a subset
of the size c(a, b), so every set names, for each size that a partner can have, the two sizes and all its subsets of
that size. Who meets a set of the smaller size on such a name is linked with it, as c grows with both sizes; so one
comparison with one of these settles a whole list, however long, and a list without one is of no use. *Large* sets meet on inverted lists: of each set only the lists of its rarest shingles are
scanned (prefix filter), as many as any partner must share one of. The boundary between the two is the size at which
enumerating becomes dearer than scanning, from the counted sizes and list lengths.

Lists can be long: groups of near copies, and passages that many texts share. Shingles found to be common are put last
in the order, so that passages rarely enter a prefix; what is common, shingles and subsets of small sets alike, is
salted, so that no task holds a hot key's whole list. A long list is not paired off. Its most central member is
compared with all others first; the comparison gives exact distances, and as the Jaccard distance is a metric, the rest
splits into *near* members (linked), a *shell* that may link with near ones, and far ones; all but the near go to a
further round. Pairs that share too few shingles of their prefixes to link, whatever stands behind them, are not
measured. Shell members that are already connected need no further comparison. What remains in short lists is compared pairwise.
No link between different sets is lost as far as connected groups are concerned.

Shingles are 64-bit hashes; equal sets are recognised by a 128-bit digest, of which half names the set (the other half
where two sets share the first). Rows meet in shuffles on (list, salt) or on set names; tables that are broadcast are
counted first or have a fixed bound. Tables between steps and shuffle files are deleted once the next step stands.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import forget, hasher, keep, mix64, raw_texts, shingles, small

#: A task counts common shingles over so many at a time, and names those that it meets in so many sets. Prefixes are
#: mostly made of the hashes below FRONT, so there fewer are enough.
CHUNK_SHINGLES, COMMON_IN_CHUNK, COMMON_IN_FRONT, FRONT = 1_000_000, 4, 2, np.uint64(2**64 * 2 // 5)
#: Rows of common keys that leave a task as one batch.
OUT_ROWS = 50_000
#: So many of the commonest shingles are known to every task (8 bytes each); others are ordered by hash alone.
MOST_COMMON = 1_000_000
#: So many of the commonest subsets of small sets are known likewise, to be salted.
MOST_COMMON_SUBSETS = 250_000
#: List entries that a task orders, about: what it fetches and sorts at once stays the same as tables grow.
TASK_ENTRIES = 200_000
#: Subsets are never considered for sets above this size.
LARGEST_SMALL = 12
#: Lists are split by a central member until this many times the rows would do as pairs, or until a round leaves more
#: than this share of the pairs. The rest is compared in blocks of so many list entries.
PAIRS_PER_ROW, STALLED, BLOCK_ENTRIES = 8, 0.9, 256
#: Sets on one side of a block of comparisons, their members in all, and the shingles that are counted at a time.
BLOCK_SETS, BLOCK_MEMBERS, BLOCK_SHINGLES = 256, 1 << 20, 4096
#: Rows of a table of pairs or ids that may be broadcast.
BROADCAST_ROWS = 500_000
#: A common key is dealt to so many lists; salts are multiples of a step, which leave a token's low bits as they are.
SALTS, SALT_STEP = 256, 0x9E3779B1 << 20


def least_overlap(a, b, num: int, den: int):
    """Fewest common members of sets of sizes a and b whose Jaccard index is at least num / den."""
    return -((-num * (a + b)) // (num + den))


def _digest(members: np.ndarray) -> tuple[int, int]:
    """The set's digest as two longs."""
    return struct.unpack("<qq", hashlib.blake2b(members.tobytes(), digest_size=16).digest())


def _name(digest: tuple[int, int], taken: frozenset[int]) -> int:
    """A set is named by the first half of its digest, or by the second where different sets share the first."""
    return digest[1] if digest[0] in taken else digest[0]


def _salted(keys: np.ndarray, d: int) -> np.ndarray:
    """The keys of the lists that a set goes to instead of those of common keys."""
    return keys ^ np.uint64(d % SALTS * SALT_STEP)


def _places(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the known ones (sorted), and where."""
    if not len(known):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return known[at] == keys, at


def _counted_rows(kind: int, held: list[np.ndarray]) -> tuple[pa.RecordBatch, int, int]:
    """Rows of the keys that are common among those held; the sum of all list lengths squared, and of all lengths."""
    keys, times = np.unique(np.concatenate(held), return_counts=True)
    often = times >= (COMMON_IN_CHUNK if kind == 3 else np.where(keys < FRONT, COMMON_IN_FRONT, COMMON_IN_CHUNK))
    k, times = int(often.sum()), times.astype(np.int64)
    return _rows(np.full(k, kind), keys[often].view(np.int64), times[often]), int((times**2).sum()), int(times.sum())


def _rows(kind: np.ndarray, ids, n, sid=None, rest=None) -> pa.RecordBatch:
    halves = [pa.nulls(len(kind), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (sid, rest)]
    ids = ids.cast(pa.int64()) if isinstance(ids, pa.Array) else pa.array(ids, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), ids, pa.array(n, pa.int64()), *halves], ["kind", "id", "n", "sid", "rest"])


def _set_rows(num: int, den: int):
    """Per text a row (kind 0) with its set's size and digest; list lengths (kind 2); a row for each shingle (kind 1) and
    each subset of a small set (kind 3) that is common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        held: list[np.ndarray] = []
        named: list[np.ndarray] = []
        count = 0

        def cut(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            return (rows.slice(at, OUT_ROWS) for at in range(0, len(rows), OUT_ROWS))

        def tally() -> Iterator[pa.RecordBatch]:
            rows, squares, total = _counted_rows(1, held)
            yield from cut(rows)
            yield _rows(np.array([2]), [squares], [total])
            if named:
                yield from cut(_counted_rows(3, named)[0])

        for batch in batches:
            sizes, digests = [], []
            for words in hasher().many(raw_texts(batch.column(1))):
                members = shingles(words)
                sizes.append(len(members))
                digests.append(d := _digest(members))
                if d not in seen:
                    seen.add(d)
                    held.append(members)
                    count += len(members)
                    if 0 < len(members) <= LARGEST_SMALL:
                        named.extend(subset_keys(members, num, den))
                        count += len(named[-1]) + len(named[-2])
                    if count >= CHUNK_SHINGLES:
                        yield from tally()
                        held, named, count = [], [], 0
            yield _rows(np.zeros(len(sizes)), batch.column(0), sizes, [d[0] for d in digests], [d[1] for d in digests])
        if held:
            yield from tally()

    return run


@lru_cache(maxsize=None)
def _picks(a: int, c: int) -> np.ndarray:
    return np.array(list(combinations(range(a), c)))


def _partners(a: int, num: int, den: int) -> range:
    """Sizes of the sets that one of size a can be linked with."""
    return range(-(-num * a // den), a * den // num + 1)


def subset_keys(members: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the subsets on which a small set meets the partners it is linked with: those of at least its size, and smaller ones."""
    a, spread = len(members), mix64(members)
    out: tuple[list[np.ndarray], list[np.ndarray]] = ([], [np.zeros(0, np.uint64)])
    for b in _partners(a, num, den):
        sums = spread[_picks(a, least_overlap(a, b, num, den))].sum(axis=1, dtype=np.uint64)
        out[b < a].append(mix64(sums ^ mix64(np.uint64([min(a, b) << 32 | max(a, b)]))))
    return np.unique(np.concatenate(out[0])), np.unique(np.concatenate(out[1]))


def subset_count(a: int, num: int, den: int) -> int:
    return sum(comb(a, least_overlap(a, b, num, den)) for b in _partners(a, num, den))


def boundary(sizes: dict[int, int], list_length: float, num: int, den: int) -> int:
    """The largest size of a small set, by cost: subsets named against list entries scanned."""

    def cost(b: int) -> float:
        named = sum(sizes.get(a, 0) * subset_count(a, num, den) for a in range(1, b + 1))
        return named + sum(n * (a - -(-num * a // den) + 1) * (1 + list_length) for a, n in sizes.items() if a * den > num * b)

    return min(range(LARGEST_SMALL + 1), key=cost)


def _entries(common, taken: frozenset[int], limit: int, num: int, den: int):
    """Rows of list entries: a set's subsets (kind 1) or its prefix in the order (kind 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank, subsets = common.value
        seen: set[int] = set()
        for batch in batches:
            rows: list[tuple] = []
            for words in hasher().many(raw_texts(batch.column(0))):
                members = shingles(words)
                n = len(members)
                if not n or (d := _name(_digest(members), taken)) in seen:
                    continue
                seen.add(d)
                if n <= limit:
                    for own, keys in zip((CENTRE, LAST), subset_keys(members, num, den), strict=True):
                        hit, _ = _places(keys, subsets)
                        rows.append((1, d, n, int((~hit).sum()), own, np.concatenate([keys[~hit], _salted(keys[hit], d)])))
                if n * den > num * limit:
                    hit, at = _places(members, known)
                    light = members[~hit]
                    heavy = members[hit]
                    if len(heavy):
                        heavy = heavy[np.argsort(rank[at[hit]], kind="stable")]
                    p = n - -(-num * n // den) + 1
                    own = min(p, len(light))
                    rows.append((0, d, n, own, own * LAST // n, np.concatenate([light, _salted(heavy, d)])[:p]))
            if rows:
                kinds, ds, ns, lights, owns, arrays = zip(*rows, strict=True)
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(kinds, pa.int32()), pa.array(ds, pa.int64()), pa.array(ns, pa.int32()), pa.array(lights, pa.int32()), pa.array(owns, pa.int32()), tokens],
                    ["kind", "sid", "n", "light", "own", "tokens"],
                )

    return run


#: Bounds of ``own``, of which the least in a list is its centre.
CENTRE, LAST = 0, 127
#: Places in a prefix are kept up to this one; later ones count as it, which only loosens the test that reads them.
LAST_PLACE = (1 << 22) - 1


def _packed() -> Column:
    """Size, place, own, heavy and kind, in one number. The least own is a list's centre.

    Own is the share of light shingles in the prefix (in 127ths of the size), or for subsets (kind 1) CENTRE if the set
    is one of the smaller size, and LAST if it is not.
    """
    heavy = (F.col("pos") >= F.col("light")).cast("long")
    place, own = F.least(F.col("pos"), F.lit(LAST_PLACE)).cast("long"), F.shiftleft(F.col("own").cast("long"), 2)
    return F.shiftleft(F.col("n").cast("long"), 31).bitwiseOR(F.shiftleft(place, 9)).bitwiseOR(own).bitwiseOR(F.shiftleft(heavy, 1)).bitwiseOR(F.col("kind").cast("long"))


def _heavy() -> Column:
    return F.col("about").bitwiseAND(F.lit(2)) > 0


def _unpacked() -> list[Column]:
    """kind, token, sid, n, pos, own of a packed entry; a salted token gets its own value back."""
    bits = lambda by, mask: F.shiftright("about", by).bitwiseAND(F.lit(mask)).cast("int")
    salt = F.pmod("sid", F.lit(SALTS)).cast("long") * F.lit(SALT_STEP)
    token = F.when(_heavy(), F.col("key").bitwiseXOR(salt)).otherwise(F.col("key"))
    n, own = F.shiftright("about", 31).alias("n"), bits(2, 127).alias("own")
    return [bits(0, 1).alias("kind"), token.alias("token"), F.col("sid"), n, bits(9, LAST_PLACE).alias("pos"), own, _heavy().alias("heavy")]


def _members(taken: frozenset[int]):
    """Rows (name, sorted members) of the sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ds, sets = [], []
            for words in hasher().many(raw_texts(batch.column(0))):
                members = shingles(words)
                if (d := _name(_digest(members), taken)) not in seen:
                    seen.add(d)
                    ds.append(d)
                    sets.append(members.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(sets, pa.binary())], ["sid", "members"])

    return run


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint64)


@F.pandas_udf(IntegerType())
def _common_count(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.zeros(len(a), np.int32)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        both = np.concatenate([_unpack(x), _unpack(y)])
        both.sort(kind="stable")
        out[i] = (both[1:] == both[:-1]).sum()
    return pd.Series(out)


def _size(members: str) -> Column:
    return (F.length(members) / 8).cast("long")


class _Sets:
    """The members of wanted sets, each computed again from one text that has it."""

    def __init__(self, texts: DataFrame, ids: DataFrame, taken: frozenset[int]) -> None:
        self.texts, self.ids, self.taken = texts, ids, taken

    def __call__(self, wanted: DataFrame) -> DataFrame:
        chosen = keep(self.ids.join(small(wanted, BROADCAST_ROWS), "sid", "left_semi").select("id"), "set-ids")
        sets = self.texts.join(small(chosen, BROADCAST_ROWS), "id", "left_semi").select("text")
        sets = keep(sets.mapInArrow(_members(self.taken), "sid long, members binary"), "sets")
        forget(chosen)
        n, k = sets.agg(F.count("*"), F.countDistinct("sid")).first()
        if n == k:
            return sets
        once = keep(sets.groupBy("sid").agg(F.min("members").alias("members")), "sets")
        forget(sets)
        return once


def _overlaps(pairs: DataFrame, sets_of: _Sets) -> DataFrame:
    """x, y, their sizes a and b and the count o of common members, for each of some kept pairs of sets."""
    sides = keep(pairs.select(F.col("x").alias("sid")).union(pairs.select("y")).distinct(), "pair-sides")
    centres = keep(pairs.select("y").distinct(), "pair-centres")
    sets = sets_of(sides)
    left = sets.toDF("x", "mx").join(small(pairs, BROADCAST_ROWS), "x")
    right = sets.toDF("y", "my").join(small(centres, BROADCAST_ROWS), "y", "left_semi")
    out = keep(left.join(right, "y").select("x", "y", _size("mx").alias("a"), _size("my").alias("b"), _common_count("mx", "my").alias("o")), "overlaps")
    forget(sides, centres, sets)
    return out


def _may_link(nx: Column, cx: Column, ny: Column, cy: Column, num: int, den: int) -> Column:
    """Whether two sets can link, from sizes n and the numbers c of their prefix shingles that any other set shares.

    Of the set whose prefix ends first in the order, whatever the two have in common is in both prefixes or behind that
    prefix; so the overlap is at most the smaller c and what stands behind the prefix of the one or the other.
    """
    behind = lambda n: F.ceil(n * num / F.lit(float(den)) - 1e-9).cast("int") - 1
    fits = F.least(nx, ny) * den >= F.greatest(nx, ny) * num
    return fits & (F.least(cx, cy) + F.greatest(behind(nx), behind(ny)) >= least_overlap_column(nx, ny, num, den))


def _links_between(num: int, den: int):
    """Per group, the links of members on one side with members on the other, by products of 0/1 matrices.

    Only shingles that both sides have are counted, BLOCK_SHINGLES at a time.
    """

    def run(ball: pd.DataFrame, shell: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ball) and len(shell):
            sides = [[_unpack(m) for m in side["members"]] for side in (shell, ball)]
            both = np.intersect1d(*(np.unique(np.concatenate(side)) for side in sides), assume_unique=True)
            o = np.zeros((len(shell), len(ball)), np.float32)
            for at in range(0, len(both), BLOCK_SHINGLES):
                some = both[at : at + BLOCK_SHINGLES]
                grid = [np.zeros((len(side), len(some)), np.float32) for side in sides]
                for side, g in zip(sides, grid, strict=True):
                    for i, m in enumerate(side):
                        m = m[np.searchsorted(m, some[0]) : np.searchsorted(m, some[-1], "right")]
                        place = np.minimum(np.searchsorted(some, m), len(some) - 1)
                        g[i, place[some[place] == m]] = 1
                o += grid[0] @ grid[1].T
            n = [np.array([len(m) for m in side], np.float64) for side in sides]
            hits = np.argwhere(o * den >= (n[0][:, None] + n[1][None, :] - o) * num)
            out = [(shell["sid"].iloc[i], ball["sid"].iloc[j]) for i, j in hits]
        return pd.DataFrame(out, columns=["x", "y"])

    return run


def _shell_links(shell: DataFrame, ball: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the shell (y, sid) and the ball (y, sid) of each centre y, in blocks bounded in sets and members."""
    sizes = sets.select("sid", _size("members").alias("n"))
    number = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_MEMBERS)).cast("int")
    blocks = lambda df, name: df.join(sizes, "sid").groupBy("y").agg(number.alias(name))
    split = keep(blocks(shell, "s").join(blocks(ball, "b"), "y"), "blocks")
    place = lambda n: F.pmod(F.xxhash64("sid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ball = ball.join(split, "y").select("y", "sid", place("b").alias("j"), every("s").alias("i"))
    shell = shell.join(split, "y").select("y", "sid", place("s").alias("i"), every("b").alias("j"))
    ball = ball.join(sets.toDF("sid", "members"), "sid").groupBy("y", "i", "j")
    shell = shell.join(sets.toDF("sid", "members"), "sid").groupBy("y", "i", "j")
    links = keep(ball.cogroup(shell).applyInPandas(_links_between(num, den), "x long, y long"), "shell-links")
    forget(split)
    return links


def _pairs_in_lists(alive: DataFrame, lengths: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (x, y) that stand in a common list and may link; a long list is compared in blocks of BLOCK_ENTRIES."""
    per = alive.join(lengths.select("kind", "token", F.ceil(F.col("c") / BLOCK_ENTRIES).cast("int").alias("blocks")), ["kind", "token"])
    per = per.withColumn("at", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    fields = ("sid", "n", "pos", "shared")
    a = per.select("kind", "token", *(F.col(c).alias(f"{c}_x") for c in fields), F.col("at").alias("i"), F.explode(F.sequence("at", F.col("blocks") - 1)).alias("j"))
    b = per.select("kind", "token", *(F.col(c).alias(f"{c}_y") for c in fields), F.explode(F.sequence(F.lit(0), "at")).alias("i"), F.col("at").alias("j"))
    one, two = F.struct("n_x", "sid_x"), F.struct("n_y", "sid_y")
    # A pair counts from the first shingle that both have, if enough can follow it.
    least = least_overlap_column(F.col("n_x"), F.col("n_y"), num, den)
    follow = 1 + F.least(F.col("n_x") - F.col("pos_x") - 1, F.col("n_y") - F.col("pos_y") - 1) >= least
    fits = _may_link(F.col("n_x"), F.col("shared_x"), F.col("n_y"), F.col("shared_y"), num, den) & ((F.col("kind") == 1) | follow)
    met = a.join(b, ["kind", "token", "i", "j"]).filter(((F.col("i") < F.col("j")) | (one < two)) & fits)
    return met.select(F.when(one < two, F.col("sid_x")).otherwise(F.col("sid_y")).alias("x"), F.when(one < two, F.col("sid_y")).otherwise(F.col("sid_x")).alias("y"))


def least_overlap_column(a: Column, b: Column, num: int, den: int) -> Column:
    return F.ceil(((a + b) * num) / F.lit(float(num + den)) - 1e-9).cast("int")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected groups of a table of edges (x, y): rows (node, root), root the least node of the group.

    Each round takes the least label around a node and then that label's label; tables are kept between rounds.
    """
    both = keep(edges.select("x", "y").union(edges.select("y", "x")).filter("x <> y").distinct(), f"{label}-edges")
    now = keep(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("root")), label)
    while True:
        around = both.join(now.select(F.col("node").alias("y"), "root"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("least"))
        met = now.select("node", "root").join(around, "node").select("node", "root", F.least("root", "least").alias("nearer"))
        jump = now.select(F.col("node").alias("nearer"), F.col("root").alias("further"))
        after = keep(met.join(jump, "nearer", "left").select("node", F.least("nearer", F.coalesce("further", "nearer")).alias("root"), "root").toDF("node", "root", "before"), label)
        forget(now)
        if after.filter("root <> before").isEmpty():
            forget(both)
            return after.select("node", "root")
        now = after


def _jaccard_distance() -> Column:
    return 1 - F.col("o") / (F.col("a") + F.col("b") - F.col("o"))


def _linked(num: int, den: int) -> Column:
    return F.col("o").cast("long") * den >= (F.col("a") + F.col("b") - F.col("o")) * num


def list_tasks(shingles: int, sizes: dict[int, int], limit: int, num: int, den: int) -> int:
    """Tasks that the list entries are dealt to, from the counted shingles and the sizes of small sets."""
    named = sum(n * subset_count(a, num, den) for a, n in sizes.items() if a <= limit)
    return ceil((shingles * (den - num) / den + named) / TASK_ENTRIES)


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", num: int = 75, den: int = 100) -> DataFrame:
    """Group texts whose shingle sets have a Jaccard index of at least num / den, directly or through others.

    Returns one row per input row: the id, ``n_shingles`` (size of its set of 5-word shingles) and ``component_id``,
    the least id that links reach, itself included.

    Null or wordless texts have an empty set and are linked with nothing. A text of fewer than five words has one
    shingle, the whole sequence. Rows with equal ids are rows of their own. A row with a null id is returned with a
    null ``component_id`` and groups nothing. An empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    first = keep(texts.mapInArrow(_set_rows(num, den), "kind int, id long, n long, sid long, rest long"), "shingle-sets")
    rows = first.filter("kind = 0").select("id", "n", "sid", "rest")
    halves = rows.filter("n > 0").groupBy("sid").agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    # Expected are n * n / 2 ** 65 of n sets: none below a billion, some hundred in a hundred billion.
    taken = frozenset(r.sid for r in halves.filter("low <> high").select("sid").collect())
    if taken:
        rows = rows.withColumn("sid", F.when(F.col("sid").isin(list(taken)), F.col("rest")).otherwise(F.col("sid")))
    sets = keep(rows.filter("n > 0 and id is not null").groupBy("sid").agg(F.min("id").alias("id"), F.first("n").cast("int").alias("n")), "distinct-sets")

    common = first.filter("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(MOST_COMMON).toPandas()
    # Sorted here once, as every worker holds it: the shingles and their ranks, rarest first.
    tokens = common["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens, kind="stable")
    subsets = first.filter("kind = 3").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(MOST_COMMON_SUBSETS).toPandas()
    subsets = np.sort(subsets["id"].to_numpy(np.int64).view(np.uint64))
    shared = spark.sparkContext.broadcast((tokens[order], common["n"].rank(method="first").to_numpy(np.uint32)[order], subsets))
    counted = first.filter("kind = 2").agg(F.sum(F.col("id").cast("double")), F.sum("n")).first()
    length = counted[0] / counted[1] if counted[1] else 1.0
    sizes = {r[0]: r[1] for r in sets.filter(F.col("n") <= 2 * LARGEST_SMALL).groupBy("n").count().collect()}
    limit = boundary(sizes, length, num, den)

    # Which lists hold more than one set? All that counts a list's entries runs where its key was dealt: one shuffle.
    # Lists of common keys are long, so they are salted and taken as shared; their parts are counted together below.
    known_texts = texts.filter("id is not null")
    lists = known_texts.select("text").mapInArrow(_entries(shared, taken, limit, num, den), "kind int, sid long, n int, light int, own int, tokens array<long>")
    lists = lists.select("sid", "kind", "n", "light", "own", F.posexplode("tokens").alias("pos", "key")).select("sid", "key", _packed().alias("about"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), list_tasks(counted[1] or 0, sizes, limit, num, den))
    lists = lists.repartition(tasks, "key")
    together = Window.partitionBy("key")
    lists = lists.withColumn("many", F.count("*").over(together)).filter(_heavy() | (F.col("many") > 1))
    lists = lists.groupBy("key", "sid").agg(F.min("about").alias("about")).select("key", *_unpacked())
    lists = lists.withColumn("c", F.count("*").over(together)).withColumn("centre", F.min(F.struct("own", "sid", "n")).over(together))
    useful = F.expr(f"c > 1 and (kind = 0 or centre.own = {CENTRE})")
    lists = keep(lists.filter(F.col("heavy") | useful).drop("key"), "lists")
    shared.destroy()

    # Per set, how many shingles of its prefix other sets share. Sets that name subsets are not told apart by it.
    shared_of = lists.groupBy("sid").agg(F.first("n").alias("n"), F.when(F.max("kind") == 1, F.first("n")).otherwise(F.count("*")).cast("int").alias("c"))
    shared_of = keep(shared_of, "shared-counts")
    side = lambda x, n, c: shared_of.select(F.col("sid").alias(x), F.col("n").alias(n), F.col("c").alias(c))
    sets_of = _Sets(known_texts, sets.select("sid", "id"), taken)

    def measured(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Overlaps of the pairs that may link, and the others with their sizes and counts."""
        both = pairs.distinct().join(side("x", "nx", "cx"), "x").join(side("y", "ny", "cy"), "y")
        both = keep(both.withColumn("may", _may_link(F.col("nx"), F.col("cx"), F.col("ny"), F.col("cy"), num, den)), "pairs")
        chosen = keep(both.filter("may").select("x", "y"), "pairs")
        found = _overlaps(chosen, sets_of)
        forget(chosen)
        return found, both.filter(~F.col("may")).drop("may")

    known, others, links = None, None, None
    slack, rows_at_first, before = 1 - num / den, 0, None
    heavy = keep(lists.filter("heavy").groupBy("kind", "token").agg(F.count("*").alias("c"), F.min(F.struct("own", "sid", "n")).alias("centre")).filter(useful), "lists-lengths")
    seats = small(heavy, MOST_COMMON)
    alive = lists.filter("not heavy").unionByName(lists.filter("heavy").drop("c", "centre").join(seats, ["kind", "token"])).drop("heavy")
    total, pairs = lists.filter("not heavy").select("c").union(heavy.selectExpr("c * c as c")).agg(F.coalesce(F.count("*"), F.lit(0)), F.sum("c")).first()
    while total:
        # Of sets whose sizes keep them apart from whatever the centre is linked with, nothing need be known.
        near_size = F.least("n", "n_y") * den * den >= F.greatest("n", "n_y") * num * num
        seated = alive.withColumn("y", F.col("centre.sid")).withColumn("n_y", F.col("centre.n")).filter("sid <> y")
        found, apart = measured(seated.filter(near_size).select(F.col("sid").alias("x"), "y"))
        known = found if known is None else known.unionByName(found)
        others = apart if others is None else others.unionByName(apart)
        near = small(keep(found.filter(_linked(num, den)).select(F.col("x").alias("sid"), "y"), "near"), BROADCAST_ROWS)
        rest = keep(seated.join(near, ["sid", "y"], "left_anti").select("kind", "token", "sid", "n", "pos", "own"), "alive")
        forget(lists, heavy, alive)
        lengths = rest.groupBy("kind", "token").agg(F.count("*").alias("c"), F.min(F.struct("own", "sid", "n")).alias("centre")).filter("c > 1")
        heavy = lengths = keep(lengths, "lists-lengths")
        total, pairs = lengths.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.expr("c * (c - 1) / 2")), F.lit(0))).first()
        rows_at_first = rows_at_first or total
        alive = keep(rest.join(lengths, ["kind", "token"]), "alive") if total else None
        forget(rest)
        if pairs <= PAIRS_PER_ROW * rows_at_first or before is not None and pairs > STALLED * before:
            break
        before = pairs
    if total:
        left = alive.drop("c", "centre").join(shared_of.select("sid", F.col("c").alias("shared")), "sid")
        links = measured(_pairs_in_lists(left, lengths, num, den))[0].filter(_linked(num, den)).select("x", "y")
    if known is not None:
        near = known.filter(_linked(num, den)).select("x", "y")
        links = near if links is None else links.union(near)
        group = components(links)
        # The shell: sets outside a centre's group that may yet link with near members of it. Those at a measured
        # distance of up to twice the slack, and those not measured that sizes and counts of near members allow.
        of = lambda side: group.withColumnRenamed("node", side).withColumnRenamed("root", f"of_{side}")
        ball = near.join(side("x", "nz", "cz"), "x").groupBy("y").agg(F.min("nz").alias("n0"), F.max("nz").alias("n1"), F.max("cz").alias("cz"))
        close = known.filter(~_linked(num, den) & (_jaccard_distance() <= 2 * slack + 1e-9)).select("x", "y")
        open_ = others.join(ball, "y")
        n0 = F.greatest("n0", F.ceil(F.col("nx") * num / F.lit(float(den)) - 1e-9)).cast("int")
        n1 = F.least("n1", F.floor(F.col("nx") * den / F.lit(float(num)) + 1e-9)).cast("int")
        behind = F.greatest(F.col("nx"), n1) * num / F.lit(float(den))
        may = (n0 <= n1) & (F.least("cx", "cz") + behind >= least_overlap_column(F.col("nx"), n0, num, den))
        shell = close.union(open_.filter(may).select("x", "y")).distinct()
        shell = shell.join(of("x"), "x", "left").join(of("y"), "y", "left")
        shell = keep(shell.filter(F.coalesce("of_x", "x") != F.coalesce("of_y", "y")).select("y", F.col("x").alias("sid")), "shell")
        if not shell.isEmpty():
            at_ball = keep(near.join(shell.select("y").distinct(), "y", "left_semi").select("y", F.col("x").alias("sid")), "ball")
            sides = keep(shell.select("sid").union(at_ball.select("sid")).distinct(), "shell-sides")
            members = sets_of(sides)
            more = _shell_links(shell, at_ball, members, num, den)
            forget(sides, members, at_ball)
            if not more.isEmpty():
                group = components(links.union(more))
        least = group.join(sets.select(F.col("sid").alias("node"), "id"), "node").groupBy("root").agg(F.min("id").alias("least"))
        group = group.join(least, "root").select(F.col("node").alias("sid"), "least")
        of_set = sets.join(group, "sid", "left").select("sid", F.coalesce("least", "id").alias("component"))
    else:
        of_set = sets.select("sid", F.col("id").alias("component"))
    # Copies of one set may be a third of all rows: the small side is broadcast when counted small, or AQE splits the hot key.
    out = rows.join(small(keep(of_set, "set-components"), BROADCAST_ROWS), "sid", "left")
    found = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"))
