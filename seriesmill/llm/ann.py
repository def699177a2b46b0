"""Nearest neighbours by query-aware collision counting (operator 8).

Vectors are dealt into shards. In a shard every projection has one array of the vectors sorted by their projected
values. A query looks at a window around its own value in each array and widens all windows in rounds (virtual
rehashing: the wider windows are the buckets of a coarser hash, without a second index). Only what a round adds is
counted. A vector that has fallen into the windows of at least `threshold` of the projections is verified by its true
distance; the others never are. The first windows are so narrow that a common vector collides in a fifth of the
projections, and a shard's search ends when the windows are `reach` times as wide as the k-th best distance projects to.

The lines come from random orthonormal bases: the squares of a difference's projections on a basis add up to the square
of its length, so counts scatter less than on independent lines, and fewer vectors have to be verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CollisionIndex:
    """Sorted projections of one shard's vectors. verified: how many distances the searches so far have taken."""

    def __init__(self, vectors: np.ndarray, projections: int, seed: int):
        self.vectors = vectors
        n, dim = vectors.shape
        rng, bases = np.random.default_rng(seed), -(-projections // dim)
        self.lines = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(bases)])[:projections]
        values = self.lines @ vectors.T
        order = np.argsort(values, axis=1, kind="stable")
        values = np.take_along_axis(values, order, 1)
        # all projections in one ascending array, each shifted behind the one before
        self.low, self.high = values[:, 0], values[:, -1]
        gap = float((self.high - self.low).max()) * 2 + 1
        self.shift = np.arange(len(values)) * gap - self.low
        self.values, self.order = (values + self.shift[:, None]).ravel(), order.ravel()
        self.first = np.arange(len(values)) * n
        pairs = rng.integers(0, n, (2, min(4096, 4 * n)))
        apart = np.abs((vectors[pairs[0]] - vectors[pairs[1]]) @ self.lines[0])
        self.start = float(np.quantile(apart[apart > 0], 0.2)) if apart.any() else 1.0
        self.widest = float((self.high - self.low).max()) + 1e-12
        self.verified = 0

    def _windows(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and end of the window of each projection, as places in order."""
        low, high = np.clip(at - half, self.low - 1e-9, None), np.clip(at + half, None, self.high + 1e-9)
        low, high = np.minimum(low, self.high + 1e-9), np.maximum(high, self.low - 1e-9)
        return np.searchsorted(self.values, low + self.shift, "left"), np.searchsorted(self.values, high + self.shift, "right")

    def _count(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many of the stretches each vector lies in."""
        parts = [self.order[a:b] for a, b in zip(begin.tolist(), end.tolist()) if a < b]
        return np.bincount(np.concatenate(parts), minlength=len(self.vectors)) if parts else np.zeros(len(self.vectors), np.int64)

    def search(self, query: np.ndarray, own: np.ndarray | None, tie: np.ndarray, k: int, threshold: float, reach: float, growth: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of the k nearest found; own: places that don't count.

        The projection of a difference of length d is about d / sqrt(dim) times a standard normal, so windows of half
        width reach * d / sqrt(dim) hold a vector at distance d on most lines.
        """
        n, m = len(self.vectors), len(self.lines)
        at = self.lines @ query
        need = max(1, int(np.ceil(threshold * m)))
        seen = np.zeros(n, bool)
        if own is not None:
            seen[own] = True
        places, dists = np.zeros(0, np.int64), np.zeros(0)
        scale, half, open_ = reach / np.sqrt(self.vectors.shape[1]), self.start, n - int(seen.sum())
        begin, end = self._windows(at, half)
        if int((end - begin).sum()) * 2 > n * m:  # what lies outside is less
            count = m - self._count(np.concatenate([self.first, end]), np.concatenate([begin, self.first + n]))
        else:
            count = self._count(begin, end)
        while open_:
            fresh = np.flatnonzero((count >= need) & ~seen)
            if len(fresh):
                seen[fresh] = True
                open_ -= len(fresh)
                self.verified += len(fresh)
                d = np.sqrt(((self.vectors[fresh] - query) ** 2).sum(1))
                places, dists = np.concatenate([places, fresh]), np.concatenate([dists, d])
            if half > self.widest + np.abs(at).max():
                break
            wider = half * growth
            if len(dists) >= k:
                enough = scale * float(np.partition(dists, k - 1)[k - 1])
                if enough <= half:
                    break
                wider = enough
            a, b = self._windows(at, wider)
            count += self._count(np.concatenate([a, end]), np.concatenate([begin, b]))
            half, begin, end = wider, a, b
        keep = np.lexsort((tie[places], dists))[:k]
        return places[keep], dists[keep]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 32_768, block_rows: int = 16_384, projections: int = 128, threshold: float = 0.87, reach: float = 1.6, growth: float = 1.3, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest found for each query, ties to the smaller id.

    A vector that is null, empty, zero or has null or non-finite components takes no part, as query or candidate, nor
    does a row without an id or with another number of components than the query's. A query's own row, one that equals it
    in id and vector, doesn't count; rows that repeat are candidates each, and another copy of the query is one at distance 0.
    Queries that repeat in id and vector are asked once; those of one id with different vectors have k answers each. If there
    are fewer candidates than k, all come.
    The queries meet every shard, in blocks of block_rows: a vector is copied once for each block, and up to block_rows
    queries not at all. Each shard returns its k best, and a second step keeps the k best of all. No cap on collisions
    or on what is verified: the windows widen until the k-th best distance is covered or all is seen.
    """
    good = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    clean = lambda df: df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))
    base, asked = clean(vectors), clean(queries).distinct().withColumn("mark", F.xxhash64("v"))
    shards = max(1, -(-base.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))
    one = base.withColumn("shard", F.pmod(F.xxhash64("id", F.hash("v")), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    two = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def arrays(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, ids and vectors by number of components."""
        v = t.column("v").combine_chunks()
        ids, size = np.array(t.column("id").to_pylist(), np.int64), v.value_lengths().to_numpy(zero_copy_only=False)
        values, first = v.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)])
        out = {}
        for d in np.unique(size):
            rows = np.flatnonzero(size == d)
            out[int(d)] = rows, ids[rows], values[first[rows][:, None] + np.arange(d)]
        return out

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            mine, marks = arrays(a), b.column("mark").to_numpy()
            for dim, (asked_at, qid, qv) in arrays(b).items():
                if dim not in mine:
                    continue
                _, ids, v = mine[dim]
                order = np.lexsort((*v.T[:1], ids))
                ids, v = ids[order], v[order]
                index = CollisionIndex(v, projections, seed)
                for q, x, mark in zip(qid, qv, marks[asked_at]):
                    same = np.arange(np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right"))
                    own = same[(v[same] == x).all(1)][:1]  # equal rows are in one shard, and one of them is the query
                    places, dists = index.search(x, own, ids, k, threshold, reach, growth)
                    found += [(int(q), int(mark), int(ids[p]), float(d)) for p, d in zip(places, dists)]
        cols = list(zip(*found)) or [(), (), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "mark": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    near = one.groupBy("shard", "block").cogroup(two.groupBy("shard", "block")).applyInArrow(search, "query_id long, mark long, vec_id long, score double")
    best = F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k)
    ranked = near.groupBy("query_id", "mark").agg(best.alias("b")).select("query_id", F.posexplode("b").alias("p", "x"))
    return ranked.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
