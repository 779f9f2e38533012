"""Centroid clustering (Lloyd's rounds) with assignments through a vector-approximation file.

Every vector is stored once more as a VA-file: per dimension the range of values over all vectors is
cut into ``2^bits`` cells of whole numbers, and a vector keeps one cell number per dimension (one
byte). For a set of centroids a lookup table gives, per centroid, dimension and cell, the least and
the most that dimension can add to the squared distance. Summing the table over a vector's cells
bounds its distance to every centroid from below and above; only centroids whose lower bound does
not exceed the smallest upper bound can be nearest, and only where more than one is left is the
full vector compared with those centroids. Bounds are exact integers, so the assignment (ties to
the smaller centroid number) equals the one by exact distances. Full vectors are still read for the
sums of a round and the reported distances; the VA-file saves the k x dim comparisons.

A round is one scan of the staged VA-file: tasks assign their vectors and add them up per cluster,
and only the sums per (cluster, dimension) are shuffled; the new centroids, k x dim numbers, are
taken on the driver as exact floor(sum / count). Centroids and tables are small and bounded by k,
dim and cells, not by the data.

Defined cases: vectors that are null, of another length than ``dim``, with a null or non-finite
component, or with a component of magnitude 2^24 or more after scaling take no part, nor do rows
without an id; repeated rows are separate vectors; of equal start hashes the smaller vector comes
first; fewer vectors than k give that many centroids; an empty table gives no rows; an empty
cluster keeps its centroid; sums are exact while they fit a long (Spark raises otherwise); other
columns of the input, whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sluicework.llm.frames import staged

LIMIT = 1 << 24
#: Vectors whose bounds are summed at once.
CHUNK = 2048


def kept(embeddings: DataFrame, dim: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and v, the components times ``scale`` rounded down, of the vectors that take part."""
    parts = F.col("embedding").cast("array<double>")
    usable = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == dim)
        & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < F.lit(float(LIMIT))))
    )
    return embeddings.where(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * scale).cast("long")).alias("v")
    )


def _matrix(part: pa.RecordBatch, dim: int, rows: np.ndarray | None = None) -> np.ndarray:
    lists = part.column("v")
    if rows is not None:
        lists = lists.take(pa.array(rows))
    return lists.flatten().to_numpy().astype(np.int64).reshape(-1, dim)


def _edges(vectors: DataFrame, dim: int, bits: int) -> np.ndarray:
    """Per dimension the first whole number of each cell, and one past the last: (dim, cells + 1)."""

    def bounds(batches):
        for part in batches:
            if part.num_rows:
                m = _matrix(part, dim)
                yield pa.RecordBatch.from_arrays([pa.array([m.min(0).tolist()]), pa.array([m.max(0).tolist()])], names=["lo", "hi"])

    seen = vectors.mapInArrow(bounds, "lo array<long>, hi array<long>")
    seen = seen.select(F.posexplode(F.arrays_zip("lo", "hi")).alias("d", "p")).groupBy("d").agg(F.min("p.lo").alias("lo"), F.max("p.hi").alias("hi"))
    got = {r.d: (r.lo, r.hi) for r in seen.collect()}
    lo = np.array([got[d][0] for d in range(dim)], np.int64)
    width = np.array([got[d][1] for d in range(dim)], np.int64) - lo + 1
    steps = np.arange((1 << bits) + 1)
    return lo[:, None] + (width[:, None] * steps[None, :]) // (1 << bits)


def _codes(m: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Cell number of every component: (rows, dim) of uint8."""
    out = np.empty(m.shape, np.uint8)
    for d in range(m.shape[1]):
        out[:, d] = np.searchsorted(edges[d], m[:, d], side="right") - 1
    return out


def _tables(centroids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and most squared difference per (centroid, dimension, cell)."""
    first, last = edges[None, :, :-1], edges[None, :, 1:] - 1
    c = centroids[:, :, None]
    ends = np.maximum((first - c) ** 2, (last - c) ** 2)
    inside = (first <= c) & (c <= last)
    return np.where(inside, 0, np.minimum((first - c) ** 2, (last - c) ** 2)), ends


def assign(part: pa.RecordBatch, centroids: np.ndarray, least: np.ndarray, most: np.ndarray, distances: bool = True):
    """Nearest centroid of every vector of a staged batch, and its squared distance if asked."""
    n, dim = part.num_rows, centroids.shape[1]
    codes = np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(n, dim).astype(np.intp)
    cluster, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.arange(dim)
    for i in range(0, n, CHUNK):
        rows = np.arange(i, min(n, i + CHUNK))
        low = least[:, at, codes[rows]].sum(axis=2).T
        high = most[:, at, codes[rows]].sum(axis=2).T
        open_ = low <= high.min(axis=1)[:, None]
        cluster[rows] = np.argmax(open_, axis=1)
        unsure = np.flatnonzero(open_.sum(axis=1) > 1)
        # Only here are full vectors compared with centroids.
        if len(unsure):
            full = _matrix(part, dim, rows[unsure])
            exact = ((full[:, None, :] - centroids[None, :, :]) ** 2).sum(axis=2)
            exact = np.where(open_[unsure], exact, np.iinfo(np.int64).max)
            cluster[rows[unsure]] = np.argmin(exact, axis=1)
    if distances and n:
        distance = ((_matrix(part, dim) - centroids[cluster]) ** 2).sum(axis=1)
    return cluster, distance


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, bits: int = 3, dim: int = 64, seed: str = "1:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``vectors`` is of the form ``kept`` returns. Centroids start as the k vectors of smallest
    sha256 of ``seed`` and vec_id; each round assigns all vectors and replaces every non-empty
    centroid by floor(sum / count); then all vectors are assigned once more.
    """
    spark = vectors.sparkSession
    first = vectors.select("v", F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h")).orderBy("h", "v").limit(k)
    centroids = np.array([r.v for r in first.collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], schema)
    edges = _edges(vectors, dim, bits)

    def encode(batches):
        for part in batches:
            codes = _codes(_matrix(part, dim), edges)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array([c.tobytes() for c in codes], pa.binary())],
                                             names=["vec_id", "v", "codes"])

    approximated = staged(vectors.mapInArrow(encode, "vec_id long, v array<long>, codes binary"), "va-file")
    for _ in range(rounds):
        least, most = _tables(centroids, edges)

        def sums(batches, centroids=centroids, least=least, most=most):
            totals, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for part in batches:
                if part.num_rows:
                    c, _ = assign(part, centroids, least, most, distances=False)
                    np.add.at(totals, c, _matrix(part, dim))
                    counts += np.bincount(c, minlength=len(centroids))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(totals[used].tolist(), pa.list_(pa.int64()))],
                                             names=["cluster", "n", "s"])

        partial = approximated.mapInArrow(sums, "cluster int, n long, s array<long>")
        per_dim = partial.select("cluster", "n", F.posexplode("s").alias("d", "s")).groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        moved = centroids.copy()
        for r in per_dim.collect():
            moved[r.cluster, r.d] = r.s // r.n
        centroids = moved

    least, most = _tables(centroids, edges)

    def final(batches):
        for part in batches:
            c, d = assign(part, centroids, least, most)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int64))], names=["vec_id", "cluster", "distance"])

    assigned = approximated.mapInArrow(final, "vec_id long, cluster int, distance long")
    digests = [(i, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for i, c in enumerate(centroids)]
    per_cluster = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    per_cluster = per_cluster.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    per_cluster = per_cluster.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
