"""Exact top-k search by inner product: ball trees with branch and bound, per shard of the vectors.

Queries are taken in blocks of a bounded size, which every task gets by broadcast; the vectors stay where they are, and
each task cuts its own into shards. Over a shard a ball tree is built. Its nodes are visited in order of the largest
inner product that their ball allows, ``q . centre + |q| * radius``, until that bound falls under the query's current
k-th score. Shards share that score: a task hands it from one shard to the next, and between tasks a first pass, which
looks only at each query's most promising leaf in every shard, gives the k-th best of all these candidates, where the
second, complete pass starts from. A block costs two passes over the vectors, none of which shuffles them; candidates
are at most k a query and task, and few in the second pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, keep

#: Vectors of a shard, queries of a block, vectors of a leaf: about so many at most.
SHARD, BLOCK, LEAF = 8192, 4096, 128


class BallTree:
    """Leaves of a binary tree split at the median of the widest direction, each with its ball; parents enclose them."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF) -> None:
        self.x = x
        self.nodes: list[tuple[np.ndarray, float, int, int, np.ndarray | None]] = []  # centre, radius, left, right, members
        self.root = self._grow(np.arange(len(x)), leaf)
        self.centres = np.stack([n[0] for n in self.nodes])
        self.radii = np.array([n[1] for n in self.nodes])

    def _grow(self, members: np.ndarray, leaf: int) -> int:
        part = self.x[members]
        centre = part.mean(axis=0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
        if len(members) <= leaf or radius == 0 and len(members) <= leaf * 64:
            self.nodes.append((centre, radius, -1, -1, members))
            return len(self.nodes) - 1
        far = part[((part - centre) ** 2).sum(axis=1).argmax()]
        side = (part - centre) @ (far - centre)
        half = len(members) // 2
        order = np.argpartition(side, half)
        left, right = self._grow(members[order[:half]], leaf), self._grow(members[order[half:]], leaf)
        self.nodes.append((centre, radius, left, right, None))
        return len(self.nodes) - 1

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Largest possible inner product of each query with each node's members, with room for rounding."""
        b = q @ self.centres.T + np.sqrt((q * q).sum(axis=1))[:, None] * self.radii[None, :]
        return np.floor(b + 1e-6 * (1 + np.abs(b)))

    def leaves(self) -> list[int]:
        return [i for i, n in enumerate(self.nodes) if n[4] is not None]


def _merge(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, more_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists per row: larger scores first, then smaller ids."""
    s, i = np.concatenate([scores, more], axis=1), np.concatenate([ids, more_ids], axis=1)
    if s.shape[1] > 4 * k:  # thin out what is under the k-th score; ties with it stay
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        width = max(k, int((s >= least[:, None]).sum(axis=1).max()))
        top = np.argpartition(-s, min(width, s.shape[1] - 1), axis=1)[:, :width] if width < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(s), 1))
        s, i = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


def search(tree: BallTree, ids: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, first_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k best (scores, ids) of every query; -inf where there are fewer or they are under the query's floor."""
    scores = np.full((len(q), k), -np.inf)
    found = np.full((len(q), k), np.iinfo(np.int64).max)
    bounds = tree.bounds(q)
    leaves = np.array(tree.leaves())

    def look(node: int, rows: np.ndarray) -> None:
        members = tree.nodes[node][4]
        s = q[rows] @ tree.x[members].T
        s[ids[members][None, :] == own[rows][:, None]] = -np.inf
        scores[rows], found[rows] = _merge(scores[rows], found[rows], s, np.broadcast_to(ids[members], s.shape), k)

    best = leaves[bounds[:, leaves].argmax(axis=1)]
    for node in np.unique(best):
        look(node, np.flatnonzero(best == node))
    if first_only:
        return scores, found

    def descend(node: int, rows: np.ndarray) -> None:
        rows = rows[bounds[rows, node] >= np.maximum(scores[rows, -1], floor[rows])]
        if not len(rows):
            return
        _, _, left, right, members = tree.nodes[node]
        if members is not None:
            rows = rows[best[rows] != node]
            if len(rows):
                look(node, rows)
            return
        # The child with the larger bound first, query by query.
        first = bounds[rows, left] >= bounds[rows, right]
        descend(left, rows[first])
        descend(right, rows)
        descend(left, rows[~first])

    descend(tree.root, np.arange(len(q)))
    return scores, found


def _matrices(ids: pa.Array, vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors as a matrix, for each length of vectors there is."""
    values, lengths = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    starts, ids = np.cumsum(lengths) - lengths, ids.to_numpy(zero_copy_only=False)
    for width in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == width)
        yield ids[at].astype(np.int64), values[starts[at][:, None] + np.arange(width)[None, :]]


def _pass(shared, k: int, first_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The k best vectors of a task's shards for each query of a block; the k-th score so far is handed from shard to shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value  # by length: ids, vectors and floors of queries
        best = {w: (np.full((len(i), k), -np.inf), np.full((len(i), k), np.iinfo(np.int64).max)) for w, (i, _, _) in block.items()}
        held: dict[int, list] = {w: [] for w in block}

        def look(width: int) -> None:
            ids, x = (np.concatenate(part) for part in zip(*held[width], strict=True))
            held[width] = []
            own, q, floor = block[width]
            for at in range(0, len(ids), SHARD):
                scores, found = best[width]
                s, i = search(BallTree(x[at : at + SHARD]), ids[at : at + SHARD], q, own, np.maximum(floor, scores[:, -1]), k, first_only)
                best[width] = _merge(scores, found, s, i, k)

        for batch in batches:
            for ids, x in _matrices(batch.column(0), batch.column(1)):
                if (width := x.shape[1]) in block:
                    held[width].append((ids, x))
                    if sum(len(i) for i, _ in held[width]) >= SHARD:
                        look(width)
        for width, (own, _, floor) in block.items():
            if held[width]:
                look(width)
            s, i = best[width]
            row, col = np.nonzero(np.isfinite(s) & (s >= floor[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(i[row, col]), pa.array(s[row, col].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's k vectors of largest inner product, its own id left out: query_id, rank, vec_id, score.

    Components become ``floor(scale * x)``, so scores are whole numbers and ties are exact; ties go to the smaller id,
    and fewer vectors than k are all returned. Vectors that are null or hold null or non-finite components, and rows
    with a null id, take no part on either side; a query only meets vectors of its own length. Of rows with equal ids
    each takes part; equal (query, vector, score) results count once. Empty tables give no rows. Other columns are not
    read.
    """

    def whole(df: DataFrame) -> DataFrame:
        x = F.col(vector_col)
        fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
        return df.filter(fine).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"))

    spark = vectors.sparkSession
    # Equal rows meet once, and only one of them is kept; after this no pass moves a vector.
    rows = keep(whole(vectors).dropDuplicates(["id", "v"]), "vectors")
    asked = keep(whole(queries).dropDuplicates(["id", "v"]).withColumn("hash", F.xxhash64("id", "v")), "queries")
    blocks = -(-asked.count() // BLOCK)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    parts: list[DataFrame] = []
    for n in range(blocks):
        table = asked.filter(F.pmod("hash", F.lit(blocks)) == n).select("id", "v").toArrow()  # about BLOCK queries
        column = table.column("v").combine_chunks()
        block = {x.shape[1]: (ids, x, np.full(len(ids), -np.inf)) for ids, x in _matrices(table.column("id").combine_chunks(), column)}

        def found(first_only: bool, block: dict = block) -> DataFrame:
            shared = spark.sparkContext.broadcast(block)
            got = rows.mapInArrow(_pass(shared, k, first_only), "query_id long, vec_id long, score long").distinct()
            return got.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

        kth = {r["query_id"]: r["score"] for r in found(True).filter(F.col("rank") == k).select("query_id", "score").collect()}  # one a query of the block
        for ids, _, floor in block.values():
            floor[:] = [kth.get(int(i), -np.inf) for i in ids]
        parts.append(keep(found(False), "top-k"))
    forget(rows, asked)
    result = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if parts:
        result = spark.read.schema(parts[0].schema).parquet(*(vars(p)["kept_at"] for p in parts))
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
