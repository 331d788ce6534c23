"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Rows of a partition are gathered into shards of `SHARD` rows; each shard gets a ball tree. A block of queries goes down
the tree together: nodes are taken in the order of their upper bound q.c + |q| r over the queries still interested, and a
query leaves a branch when the bound is below its kth score so far. That score is shared: it starts from the block's
scores against itself (those rows are candidates too), and goes on from shard to shard within a task. Bounds are raised by
more than their rounding error and ties are never cut, so results are exact. Vectors that a shard holds many times count
once, with their k + 1 smallest ids.

Queries come in blocks of at most `QUERY_BLOCK`, the only thing that is broadcast; beyond one block each makes its own
distributed pass over the candidates.

Defined results: a vector that is null or holds a null, NaN or infinite component takes no part; a null id takes no part;
vectors are compared with those of equal length only; a row is no candidate for queries of its own id, so repeated rows
don't find themselves, and repeated query rows are one query; an empty table gives an empty table; other columns are not
looked at. A component beyond a long after scaling is the nearest long; scores are exact, and those beyond 2^63 - 2 either
way are that number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256
SHARD = 8192
LEAF = 64
QUERY_BLOCK = 8192


def _floor(x: Column) -> Column:
    whole = F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), x)))
    return F.when(x >= 2.0**63, F.lit(2**63 - 1)).when(x <= -(2.0**63), F.lit(-(2**63))).when(F.abs(x) > 2.0**62, x.cast("long")).otherwise(whole)


def whole_numbers(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id long, v array<long> of floor(scale * x)) of the rows that take part."""
    bad = F.exists(vector_column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    kept = vectors.filter(F.col(vector_column).isNotNull() & F.col(id_column).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return kept.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector_column, lambda x: _floor(x.cast("double") * scale)).alias("v"))


class BallTree:
    """Points in tree order, with the centre, radius, range and children of each node."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.lo, self.hi, self.child, centers, radii = [], [], [], [], []
        stack = [(0, len(points), -1)]
        while stack:
            lo, hi, parent = stack.pop()
            at = len(self.lo)
            some = points[self.order[lo:hi]]
            center = some.mean(axis=0)
            self.lo.append(lo)
            self.hi.append(hi)
            self.child.append([])
            centers.append(center)
            radii.append(np.sqrt(((some - center) ** 2).sum(axis=1).max()) if hi > lo else 0.0)
            if parent >= 0:
                self.child[parent].append(at)
            if hi - lo > leaf and radii[-1] > 0:
                axis = int(np.argmax(some.var(axis=0)))
                mid = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argpartition(some[:, axis], mid)]
                stack += [(lo, lo + mid, at), (lo + mid, hi, at)]
        self.center, self.radius = np.array(centers), np.array(radii)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and b; one beyond `MOST` either way is `MOST`."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, -MOST, MOST).astype(np.int64)


#: No score, and the largest that is one; their negatives are numbers too.
NONE = -(2**63 - 1)
MOST = 2**63 - 2


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def merge(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        k = self.score.shape[1]
        score = np.concatenate([self.score[rows], score], axis=1)
        ids = np.concatenate([self.id[rows], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        self.score[rows], self.id[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def search(tree: BallTree, points: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, best: Best) -> int:
    """Put the shard's best into `best`; gives the number of leaves looked at. `floor`: kth scores known from elsewhere."""
    q = queries.astype(float)
    norm = np.sqrt((q * q).sum(axis=1))
    bound = q @ tree.center.T + norm[:, None] * tree.radius[None, :]
    bound += 1e-9 * norm[:, None] * (np.sqrt((tree.center**2).sum(axis=1)) + tree.radius)[None, :] + 1e-6
    np.maximum(bound, float(NONE), out=bound)  # as scores are
    kth = lambda rows: np.maximum(best.score[rows, -1], floor[rows]).astype(float)
    heap, looked = [(-np.inf, 0, np.arange(len(q)))], 0  # a node number is pushed once, so arrays are never compared
    while heap:
        _, node, rows = heapq.heappop(heap)
        rows = rows[bound[rows, node] >= kth(rows)]
        if not len(rows):
            continue
        if tree.child[node]:
            for c in tree.child[node]:
                margin = bound[rows, c] - kth(rows)
                if (on := margin >= 0).any():
                    heapq.heappush(heap, (-float(margin.max()), c, rows[on]))
            continue
        looked += 1
        at = tree.order[tree.lo[node] : tree.hi[node]]
        score = _exact(queries[rows], points[at])
        score[query_ids[rows][:, None] == ids[at][None, :]] = NONE
        use = (score >= np.maximum(best.score[rows, -1], floor[rows])[:, None]).any(axis=1)
        if use.any():
            best.merge(rows[use], score[use], ids[at])
    return looked


def distinct_points(ids: np.ndarray, points: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the k + 1 smallest ids, as one may be the query's own, with up to k rows each."""
    group = np.unique(points, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, group))
    at = np.arange(len(order))
    new_vector = np.concatenate(([True], group[order[1:]] != group[order[:-1]]))[: len(order)]
    new_id = new_vector | np.concatenate(([True], ids[order[1:]] != ids[order[:-1]]))[: len(order)]
    nth = np.cumsum(new_id)
    nth_id = nth - np.maximum.accumulate(np.where(new_vector, nth, 0))
    nth_row = at - np.maximum.accumulate(np.where(new_id, at, 0))
    keep = order[(nth_id <= k) & (nth_row < k)]
    return ids[keep], points[keep]


def _search_block(candidates: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """Best of each query in each task's rows. `queries`: ids and vectors by vector length."""
    blocks = {}
    for ids, q in queries:
        own = Best(len(q), k)
        for lo in range(0, len(q), 1024):
            rows = np.arange(lo, min(lo + 1024, len(q)))
            score = _exact(q[rows], q)
            score[ids[rows][:, None] == ids[None, :]] = NONE
            own.merge(rows, score, ids)
        blocks[q.shape[1]] = (ids, q, own.score[:, -1])
    sent = candidates.sparkSession.sparkContext.broadcast(blocks)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = sent.value
        best = {d: Best(len(ids), k) for d, (ids, _, _) in blocks.items()}
        held: dict[int, list] = {d: [] for d in blocks}

        def shard(d: int) -> None:
            if not held[d]:
                return
            ids, points = np.concatenate([i for i, _ in held[d]]), np.concatenate([p for _, p in held[d]])
            held[d] = []
            ids, points = distinct_points(ids, points, k)
            search(BallTree(points.astype(float)), points, ids, *blocks[d], best[d])

        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            ids, flat = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for d in set(lengths.tolist()) & blocks.keys():
                rows = np.flatnonzero(lengths == d)
                for lo in range(0, len(rows), SHARD):
                    some = rows[lo : lo + SHARD]
                    held[d].append((ids[some], flat[starts[some][:, None] + np.arange(d)] if d else np.zeros((len(some), 0), np.int64)))
                    if sum(len(i) for i, _ in held[d]) >= SHARD:
                        shard(d)
        for d, (ids, _, _) in blocks.items():
            shard(d)
            row, col = np.nonzero(best[d].score > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best[d].id[row, col]), pa.array(best[d].score[row, col])], names=["query_id", "vec_id", "score"])

    return candidates.mapInArrow(find, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank int, vec_id, score): the k best candidates of each query, ties to the smaller id.

    Both sides come from `whole_numbers`.
    """
    queries = queries.dropDuplicates(["vec_id"])
    n = queries.count()
    blocks = max(1, -(-n // (query_block * 3 // 4)))
    found = []
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        ids = rows.column("vec_id").to_numpy()
        lists = [np.array(v, np.int64) for v in rows.column("v").to_pylist()]
        lengths = np.array([len(v) for v in lists], np.int64)
        by_length = [(ids[lengths == d], np.array([v for v in lists if len(v) == d], np.int64).reshape(-1, d)) for d in sorted(set(lengths.tolist()))]
        found.append(_search_block(vectors, by_length, k))
    merged = reduce(DataFrame.union, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
