"""Exact top-k by inner product with bounds from segment statistics, coarse to fine.

A vector is cut into segments; per segment it keeps the mean and the deviation. For two vectors the
sum over segments of length * (mean * mean + deviation * deviation) is never below their inner
product, which is the same as a lower bound of their distance: |a - b|^2 = |a|^2 + |b|^2 - 2ab.
Pairs of a block of queries and a block of candidates are bounded at ``LEVELS`` resolutions; those
that could still be among a query's best get their exact score.

Queries are compared with all rows in blocks: ``meeting`` deals both tables over the tasks, each task
keeps the best k so far of its queries, and the tasks' best meet in a ranking per query.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id; a query never meets rows of its own id; of repeated query ids the smallest
vector asks; repeated candidate rows all count; vectors are compared with those of their length.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sluicework.llm.meeting import by_length, held, matrix, meet, sides, sizes

LEVELS = (4, 16)
BLOCK = 1024
#: Pairs whose vectors are held at once for exact scores.
PAIRS = 16_384
#: One product scores all pairs of two blocks where more than one in so many is left.
DENSE = 32
#: Doubles hold whole numbers up to here; beyond it scores are taken in 64-bit integers.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the components times ``scale`` rounded down, of the vectors that take part."""
    parts = F.col("embedding").cast("array<double>")
    usable = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall(
        parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return vectors.where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def statistics(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, both times the root of the segment's length."""
    n = vectors.shape[1]
    cuts = np.unique(np.linspace(0, n, min(segments, n) + 1).astype(int))
    lengths = np.diff(cuts)
    x = vectors.astype(float)
    means = np.add.reduceat(x, cuts[:-1], axis=1) / lengths
    squares = np.add.reduceat((x - np.repeat(means, lengths, axis=1)) ** 2, cuts[:-1], axis=1) / lengths
    return means * np.sqrt(lengths), np.sqrt(squares) * np.sqrt(lengths)


class Block:
    """Rows with vectors of one length, and the statistics of their segments."""

    def __init__(self, rows: pa.RecordBatch, dim: int):
        self.ids, self.vectors = rows.column("vec_id").to_numpy(), matrix(rows, dim)
        self.levels = [np.hstack(statistics(self.vectors, s)) for s in LEVELS] if dim else []
        self.most = float(np.abs(self.vectors).max(initial=0))


class Best:
    """The best k candidates so far of a block of queries."""

    def __init__(self, block: Block, k: int):
        self.block, self.ids, self.k = block, block.ids, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in block.ids]
        self.floor = np.full(len(block.ids), -np.inf)
        #: The id of the k-th, where that one's score is the floor.
        self.last = np.full(len(block.ids), np.iinfo(np.int64).max)

    def scores(self, q: np.ndarray, c: np.ndarray, block: Block, exact: bool) -> np.ndarray:
        out = np.zeros(len(q), np.int64)
        for i in range(0, len(q), PAIRS):
            a, b = self.block.vectors[q[i : i + PAIRS]], block.vectors[c[i : i + PAIRS]]
            if exact:
                a, b = a.astype(float), b.astype(float)
            out[i : i + PAIRS] = np.einsum("ij,ij->i", a, b)
        return out

    def offer(self, block: Block):
        ids, dim = block.ids, block.vectors.shape[1]
        if not len(ids) or not dim:
            q, c = np.nonzero(self.ids[:, None] != ids[None, :])
            self._take(q, c, np.zeros(len(q), np.int64), ids)
            return
        exact = self.block.most * block.most * dim < EXACT
        coarse = self.block.levels[0] @ block.levels[0].T
        other = self.ids[:, None] != ids[None, :]
        # Rounding of the bounds themselves.
        slack = 1e-9 * (1 + np.abs(coarse).max())
        if np.isinf(self.floor).any() and len(ids) > self.k:
            # The most promising candidates first, for a floor to prune by.
            first = np.argpartition(np.where(other, -coarse, np.inf), self.k, axis=1)[:, : self.k + 1]
            q, c = np.repeat(np.arange(len(self.ids)), self.k + 1), first.ravel()
            s = np.where(other[q, c], self.scores(q, c, block, exact).astype(float), -np.inf).reshape(-1, self.k + 1)
            kth = np.sort(s, axis=1)[:, -self.k]
            self.last[kth > self.floor] = np.iinfo(np.int64).max
            self.floor = np.maximum(self.floor, kth)
        alive = other & (coarse + slack >= self.floor[:, None])
        # Queries and candidates without any pair left need no finer bounds.
        rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        fine = self.block.levels[1][rows] @ block.levels[1][columns].T
        slack = 1e-9 * (1 + np.abs(fine).max(initial=0))
        left = alive[np.ix_(rows, columns)] & (fine + slack >= self.floor[rows, None])
        if exact and DENSE * np.count_nonzero(left) > left.size:
            # Many pairs are left: one product of whole numbers in doubles, exact like the sums of pairs.
            product = self.block.vectors[rows].astype(float) @ block.vectors[columns].astype(float).T
            q, c = np.nonzero(left & (product >= self.floor[rows, None]))
            s = product[q, c].astype(np.int64)
            q, c = rows[q], columns[c]
        else:
            q, c = np.nonzero(left)
            q, c = rows[q], columns[c]
            s = self.scores(q, c, block, exact)
        reached = s >= self.floor[q]
        if exact:
            # Of equal scores smaller ids only; floors of larger scores are rounded, so that they may seem equal.
            reached &= (s > self.floor[q]) | (ids[c] < self.last[q])
        self._take(q[reached], c[reached], s[reached], ids)

    def _take(self, q: np.ndarray, c: np.ndarray, s: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids[c], -s, q))
        q, c, s = q[order], c[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        for i, j, v in zip(q[rank < self.k].tolist(), ids[c[rank < self.k]].tolist(), s[rank < self.k].tolist(), strict=True):
            self.found[i].append((-v, j))
        for i in np.unique(q):
            self.found[i] = sorted(self.found[i])[: self.k]
            if len(self.found[i]) == self.k:
                score, last = self.found[i][-1]
                if -score >= self.floor[i]:
                    self.floor[i], self.last[i] = -score, last

    def rows(self) -> pa.RecordBatch:
        flat = [(int(i), j, -s) for i, best in zip(self.ids, self.found, strict=True) for s, j in best]
        return pa.RecordBatch.from_arrays([pa.array([f[x] for f in flat], pa.int64()) for x in range(3)], names=["query_id", "vec_id", "score"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Per query its k highest scores: query_id, rank, vec_id, score; ties to the smaller vec_id.

    Both tables are of the form that ``quantised`` returns.
    """
    both = queries.select("v", F.lit(0).alias("side")).unionByName(candidates.select("v", F.lit(1).alias("side")))
    of = sizes(both, F.col("side") == 0, F.col("side") == 1)
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))

    def compare(batches):
        waiting, best = [], None
        for side, part in sides(batches):
            if side == 0:
                waiting.append(part)
                continue
            if best is None:
                best = {}
                for dim, rows in held(waiting, BLOCK):
                    best.setdefault(dim, []).append(Best(Block(rows, dim), k))
                waiting = None
            for dim, rows in by_length(part, BLOCK):
                block = Block(rows, dim)
                for b in best.get(dim, ()):
                    b.offer(block)
        for b in chain.from_iterable((best or {}).values()):
            yield b.rows()

    found = meet(queries, candidates.select("vec_id", "v"), of).mapInArrow(compare, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
