"""Hard-negative mining with exact integer scores from a residue-number-system GEMM.

Scores are inner products of integer vectors. A block of anchors is multiplied with a block of
candidates once per small prime: both matrices are reduced modulo the prime and multiplied in
float32, a slice of ``SLICE`` dimensions at a time, so that every partial sum is a whole number
below 2^24 and therefore exact. The residues of all primes give the exact signed score by Chinese
remaindering (Garner's mixed radix). As many primes are used as the block's largest components
need; beyond what int64 can reconstruct, that block is scored with Python integers.

Selection is two passes over the same pairs of blocks: first every anchor's best ``positives``
rows of its label, then, with those scores known, per anchor and positive the best ``negatives``
rows of other labels whose score lies in the positive's window. ``meeting`` deals the blocks over the
tasks. Each pass keeps partial bests per task, and a ranking per anchor (and positive) merges them; no
task holds an anchor's full row.

Defined cases: rows without an id or label, with a null vector or a null or non-finite component
take no part; rows are compared with rows of their vector's length only; an anchor never meets
rows of its own id; of repeated anchor ids the row with the smallest (label, vector) asks; repeated
candidate rows all count; ties go to the smaller id; empty tables give no rows; a positive score
below zero has an empty window (50 * s <= 95 * s fails), zero a window of exactly zero; other
columns of the input, whatever their names, are not carried.
"""

from __future__ import annotations

from itertools import chain
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sluicework.llm.meeting import Sizes, by_length, held, matrix, meet, sides, sizes

#: Primes below 512: residues below 512, so 64 products of two of them sum to less than 2^24.
PRIMES = (509, 503, 499, 491, 487, 479, 467)
SLICE = 64
BLOCK = 1024
#: Times the scores wanted of a row up to which all allowed ones are sorted without a first cut.
MANY = 4


def labelled(embeddings: DataFrame, scale: int = 256, flip_every: int = 7, labels: int = 10) -> DataFrame:
    """vec_id, label and v (components times ``scale`` rounded down) of the rows that take part.

    Where vec_id is divisible by ``flip_every`` the label becomes (label + 1) % ``labels``.
    """
    parts = F.col("embedding").cast("array<double>")
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    label = F.col("label").cast("long")
    flipped = F.when(F.col("vec_id") % flip_every == 0, F.pmod(label + 1, F.lit(labels))).otherwise(label)
    return embeddings.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), flipped.alias("label"),
        F.transform(parts, lambda x: F.floor(x * scale).cast("long")).alias("v"),
    )


def residue_scores(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact ``a @ c.T`` of two int64 matrices, by float32 products modulo primes."""
    if not a.size or not c.size:
        return np.zeros((len(a), len(c)), np.int64)
    bound = a.shape[1] * int(np.abs(a).max()) * int(np.abs(c).max())
    if bound == 0:
        return np.zeros((len(a), len(c)), np.int64)
    primes = []
    for p in PRIMES:
        if prod(primes) > 2 * bound:
            break
        primes.append(p)
    if prod(primes) <= 2 * bound:
        return (a.astype(object) @ c.astype(object).T).astype(object)
    # Sums of slices and the products below stay below 2^31 or else 2^63.
    kind = np.int32 if max(prod(primes), a.shape[1] << 18) < 1 << 31 else np.int64
    residues = []
    for p in primes:
        ap, cp = np.mod(a, p).astype(np.float32), np.mod(c, p).astype(np.float32)
        total = np.zeros((len(a), len(c)), kind)
        for k in range(0, a.shape[1], SLICE):
            total += (ap[:, k : k + SLICE] @ cp[:, k : k + SLICE].T).astype(kind)
        residues.append(total % kind(p))
    x, m = residues[0], primes[0]
    for r, p in zip(residues[1:], primes[1:], strict=True):
        x = x + kind(m) * ((r - x) * kind(pow(m % p, -1, p)) % kind(p))
        m *= p
    return np.where(x > m // 2, x - kind(m), x).astype(np.int64)


def _order(lines: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Positions sorted by line, higher score, smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(lines)), key=lambda i: (lines[i], -scores[i], ids[i])), int)
    return np.lexsort((ids, -scores, lines))


def _keep(lines: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Of (line, id, score) triples the best k of each line."""
    order = _order(lines, ids, scores)
    lines, ids, scores = lines[order], ids[order], scores[order]
    rank = np.arange(len(lines)) - np.searchsorted(lines, lines)
    return lines[rank < k], ids[rank < k], scores[rank < k]


def _unpack(rows: pa.RecordBatch, dim: int):
    return rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), matrix(rows, dim)


def _reach(scores: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """Which scores are not below their line's floor; Python integers are all let through."""
    return np.ones(scores.shape, bool) if scores.dtype == object else scores >= floor


def _top(scores: np.ndarray, allowed: np.ndarray, k: int):
    """(row, column) of the allowed entries that can be among a row's k best: the k-th score or above."""
    if scores.dtype != object and scores.shape[1] > k and np.count_nonzero(allowed) > MANY * k * len(scores):
        s = np.where(allowed, scores, np.iinfo(np.int64).min)
        kth = np.partition(s, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        allowed = allowed & (s >= kth[:, None])
    return np.nonzero(allowed)


class _Anchors:
    """A block of anchors and the best k so far of each of its lines."""

    def __init__(self, rows: pa.RecordBatch, dim: int, extra: tuple[str, ...], lines_of, k: int):
        self.rows, self.lines_of, self.k = _unpack(rows, dim), lines_of, k
        self.extras = [rows.column(e).flatten().to_numpy() for e in extra]
        self.keys, self.best, self.floor = (), None, None

    def offer(self, block):
        self.keys, new = self.lines_of(self.extras, self.rows, block, residue_scores(self.rows[2], block[2]), self.k, self.floor)
        if self.best is not None:
            lines, ids, scores = self.best
            wide = object if object in (scores.dtype, new[2].dtype) else np.int64
            new = np.concatenate([lines, new[0]]), np.concatenate([ids, new[1]]), np.concatenate([scores.astype(wide), new[2].astype(wide)])
        self.best = _keep(*new, self.k)
        lines, _, scores = self.best
        self.floor = np.full(len(self.keys[0]), np.iinfo(np.int64).min)
        if scores.dtype != object and len(lines):
            # Lines with k scores need none below their last; those of Python integers are not pruned.
            full = np.flatnonzero(np.arange(len(lines)) - np.searchsorted(lines, lines) == self.k - 1)
            self.floor[lines[full]] = scores[full]

    def found(self, names: list[str]):
        if self.best is not None:
            lines, ids, scores = self.best
            columns = [pa.array(key[lines].tolist(), pa.int64()) for key in self.keys]
            columns += [pa.array(ids.tolist(), pa.int64()), pa.array([int(x) for x in scores], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _scan(anchors: DataFrame, candidates: DataFrame, of: Sizes, extra: tuple[str, ...], lines_of, schema: str, k: int) -> DataFrame:
    """Every block of anchors against every block of candidates of the same vector length.

    ``meeting`` deals both tables over the tasks; a task holds its anchors and keeps per line (anchor,
    or anchor and positive) the best k so far of the candidates that pass. ``lines_of(extras, anchors,
    candidates, scores, k, floor)`` gives the key columns of the lines and (line, candidate id, score)
    of one pair of blocks; scores below the floor of their line, its k-th so far, may be left out.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        waiting, blocks = [], None
        for side, part in sides(batches):
            if side == 0:
                waiting.append(part)
                continue
            if blocks is None:
                blocks = {}
                for dim, rows in held(waiting, BLOCK):
                    blocks.setdefault(dim, []).append(_Anchors(rows, dim, extra, lines_of, k))
                waiting = None
            for dim, rows in by_length(part, BLOCK):
                block = _unpack(rows, dim)
                for a in blocks.get(dim, ()):
                    a.offer(block)
        for a in chain.from_iterable((blocks or {}).values()):
            yield from a.found(names)

    return meet(anchors, candidates, of).mapInArrow(run, schema)


def _positive_lines(extras, a, c, scores, k, floor):
    a_ids, a_labels, _ = a
    c_ids, c_labels, _ = c
    allowed = (a_labels[:, None] == c_labels[None, :]) & (a_ids[:, None] != c_ids[None, :])
    if floor is not None:
        allowed &= _reach(scores, floor[:, None])
    r, col = _top(scores, allowed, k)
    return (a_ids,), (r, c_ids[col], scores[r, col])


def _negative_lines(low: int, high: int):
    def lines_of(extras, a, c, scores, k, floor):
        a_ids, a_labels, _ = a
        c_ids, c_labels, _ = c
        counts, p_ids, p_scores = extras
        owner = np.repeat(np.arange(len(a_ids)), counts)
        if scores.dtype != object and max(int(np.abs(x).max(initial=0)) for x in (scores, p_scores)) >= 1 << 55:
            scores = scores.astype(object)
        ps = p_scores.astype(object) if scores.dtype == object else p_scores
        # Whole scores of the window of each line: 100 * s from low * ps to high * ps.
        least, most = -(-low * ps // 100), high * ps // 100
        if floor is not None and scores.dtype != object:
            least = np.maximum(least, floor)
        begins = np.cumsum(counts) - counts
        # What no line of an anchor can take goes before the anchor's scores are copied for its lines.
        near = (a_labels[:, None] != c_labels[None, :]) & (a_ids[:, None] != c_ids[None, :])
        near &= (scores >= np.minimum.reduceat(least, begins)[:, None]) & (scores <= np.maximum.reduceat(most, begins)[:, None])
        rows = np.flatnonzero(near.any(axis=1)[owner])
        s = scores[owner[rows]]
        r, col = _top(s, near[owner[rows]] & (s >= least[rows, None]) & (s <= most[rows, None]), k)
        return (a_ids[owner], p_ids, p_scores), (rows[r], c_ids[col], s[r, col])

    return lines_of


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` is of the form ``labelled`` returns. Per anchor its ``positives`` best other rows of its
    label; per anchor and positive the ``negatives`` best rows of other labels with
    ``low * positive_score <= 100 * score <= high * positive_score``; best is the higher score, then
    the smaller id.
    """
    rows = rows.select("vec_id", "label", "v")
    of = sizes(rows, is_anchor)
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("m")).select("vec_id", "m.label", "m.v")
    found = _scan(anchors, rows, of, (), _positive_lines, "anchor_id long, positive_id long, positive_score long", positives)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), F.asc("positive_id"))
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    lists = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score"))).alias("p"))
    with_positives = anchors.join(lists, anchors.vec_id == lists.anchor_id).select(
        "vec_id", "label", "v", F.array(F.size("p").cast("long")).alias("n_positives"),
        F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"),
    )
    mined = _scan(
        with_positives, rows, of, ("n_positives", "positive_ids", "positive_scores"), _negative_lines(low, high),
        "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long", negatives,
    )
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), F.asc("negative_id"))
    ranked = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
