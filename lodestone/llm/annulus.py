"""Clusters of integer vectors by rounds of nearest centroids, found by annulus search.

Centroids are sorted by norm. The exact distance to the one whose norm is nearest bounds a vector's distance to its nearest from above, and by
the triangle inequality that one's norm differs from the vector's by no more than this bound. Binary search gives the range of such norms,
widened by what rounding of square roots could cost so that ties at its boundary stay in; the centroids in it are compared exactly, in integers.

Vectors stay where they are: a round is one scan that sums each task's vectors by centroid and component. Only those sums, centroids times
components, reach the driver, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Bound of an integer component's size: squared distances of 64 of them stay within a long.
LARGEST = 1 << 27
#: Vectors compared at a time.
_CHUNK = 8192


def integers(rows: DataFrame, vec: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Written ``vec_id, v`` (``array<long>``: floor(scale * x), x as double) of the vectors with ``components`` components, none null or not finite.

    Components beyond ``LARGEST`` either way, whose squares no long holds, count as that.
    """
    each = F.col(f"`{embedding}`").cast("array<double>")
    fit = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(each, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))))
    rows = rows.where((F.size(each) == components) & fit)
    return written(rows.select(F.col(f"`{vec}`").cast("long").alias("vec_id"), whole.alias("v")), "vectors")


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``k`` vectors whose sha256 of ``seed:vec_id`` is smallest, in that order (ties, of repeated ids, by components; a null id is the empty string)."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(name.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    gap = x - y
    return np.einsum("ij,ij->i", gap, gap)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid, of equally near ones that of the smallest number, and the squared distance."""
    norms = np.sqrt(np.einsum("ij,ij->i", centroids, centroids).astype(float))
    order = np.argsort(norms, kind="stable")
    norms, sorted_ = norms[order], centroids[order]
    own = np.sqrt(np.einsum("ij,ij->i", x, x).astype(float))
    right = np.searchsorted(norms, own)
    left, right = np.maximum(right - 1, 0), np.minimum(right, len(norms) - 1)
    start = np.where(np.abs(norms[left] - own) <= np.abs(norms[right] - own), left, right)
    best, label = _squared(x, sorted_[start]), order[start]
    bound = np.sqrt(best.astype(float))
    slack = 1e-9 * (own + bound + 1)
    low = np.searchsorted(norms, own - bound - slack, "left")
    high = np.searchsorted(norms, own + bound + slack, "right")
    for j, number in enumerate(order.tolist()):
        rows = np.nonzero((low <= j) & (j < high) & (start != j))[0]
        found = _squared(x[rows], sorted_[j])
        better = (found < best[rows]) | ((found == best[rows]) & (number < label[rows]))
        best[rows[better]], label[rows[better]] = found[better], number
    return label, best


def _chunks(batch: pa.RecordBatch, at: int, components: int) -> Iterator[tuple[int, np.ndarray]]:
    values = batch.column(at).flatten().to_numpy().reshape(-1, components)
    for i in range(0, len(values), _CHUNK):
        yield i, values[i : i + _CHUNK]


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids of the next round: floors of the means of their vectors; one without vectors stays."""
    k, components = centroids.shape

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, components), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in _chunks(batch, 0, components):
                label = nearest(x, centroids)[0]
                counts += np.bincount(label, minlength=k)
                for j in np.unique(label).tolist():
                    sums[j] += x[label == j].sum(axis=0)
        held = np.nonzero(counts)[0]
        columns = [np.repeat(held, components + 1), np.tile(np.arange(-1, components), len(held)), np.column_stack([counts[held], sums[held]]).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "component", "total"])

    parts = vectors.select("v").mapInArrow(summed, "cluster long, component long, total long")
    out = centroids.copy()
    found = {(r["cluster"], r["component"]): r["total"] for r in parts.groupBy("cluster", "component").agg(F.sum("total").alias("total")).collect()}
    for j in range(k):
        if (j, -1) in found:
            out[j] = [found[j, i] // found[j, -1] for i in range(components)]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` (squared) of each vector."""
    components = centroids.shape[1]

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in _chunks(batch, 1, components):
                label, best = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(x)), pa.array(label, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(each, "vec_id long, cluster int, distance long")


def digest(centroid: Iterable[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clustered(
    rows: DataFrame, vec: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance, cluster_inertia, inertia`` of every vector kept (see ``integers``), and the last centroids.

    Fewer vectors than ``k`` make as many centroids; none gives an empty table. Repeated rows count and are returned as often as they occur.
    """
    vectors = integers(rows, vec, embedding, components, scale)
    centroids = first_centroids(vectors, k, seed)
    if not len(centroids):
        none = F.lit(0).cast("long")
        return vectors.select("vec_id", F.lit(0).alias("cluster"), none.alias("distance"), none.alias("cluster_inertia"), none.alias("inertia")), centroids.reshape(0, components)
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    found = written(assigned(vectors, centroids), "clusters")
    by_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most k rows
    both = by_cluster.crossJoin(F.broadcast(by_cluster.agg(F.sum("cluster_inertia").alias("inertia"))))
    return found.join(F.broadcast(both), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def named(centroids: np.ndarray, cluster: Column) -> Column:
    """The digest of a cluster's centroid, out of the few that there are."""
    names = F.array(*[F.lit(digest(c)) for c in centroids.tolist()]) if len(centroids) else F.array(F.lit(""))
    return F.get(names, cluster)
