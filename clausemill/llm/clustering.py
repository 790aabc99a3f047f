"""Centroid clustering of integer vectors, filtered by rotated coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausemill.llm.common import materialise, small

#: Components of a size from here on have squared distances that a long cannot hold.
LARGEST = 1 << 27


def whole_vectors(embeddings: DataFrame, width: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: vectors of exactly `width` finite components, each as the integer floor(scale * component).

    Vectors with a null or non-finite component, of another width, or with an integer of 2^27 or more in size (a squared
    distance would not fit a long) are left out.
    """
    ok = (F.size("embedding") == width) & F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double") * scale) < LARGEST, F.lit(False)))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int"))
    return embeddings.where(F.coalesce(ok, F.lit(False))).select("vec_id", whole.alias("v"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(-1, width).astype(kind, copy=False)


def principal_axes(vectors: DataFrame, width: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the fewest axes that hold `share` of the variance of all vectors, from exact sums of components and products.

    Each task sums up its own rows; width * (width + 1) sums are all that is shuffled or fetched.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((width + 1, width), object), 0
        for batch in small(batches):
            v = _matrix(batch.column("v"), width, np.int64)
            step = max(1, (1 << 62) // max(1, int(np.abs(v).max(initial=0)) ** 2))  # so many products fit a long
            for at in range(0, len(v), step):
                part = v[at : at + step]
                total[:width] += (part.T @ part).astype(object)
                total[width] += part.sum(0).astype(object)
            n += len(v)
        if n:
            i, j = np.indices(total.shape)
            cells = [*(str(x) for x in total.ravel()), str(n)]
            yield pa.RecordBatch.from_arrays([pa.array([*i.ravel().tolist(), -1], pa.int32()), pa.array([*j.ravel().tolist(), -1], pa.int32()), pa.array(cells)], ["i", "j", "x"])

    sums = vectors.select("v").mapInArrow(moments, "i int, j int, x string").groupBy("i", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    at = {(r["i"], r["j"]): int(r["x"]) for r in sums}
    n = at[-1, -1]
    mean = np.array([at[width, j] / n for j in range(width)])
    products = np.array([[at[i, j] / n for j in range(width)] for i in range(width)])
    variance, axes = np.linalg.eigh(products - np.outer(mean, mean))
    held = np.cumsum(variance[::-1])
    leading = int(np.searchsorted(held, share * held[-1])) + 1
    return mean, axes[:, ::-1][:, :leading]


def rotate(v: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading rotated coordinates of vectors and the norms of what these leave."""
    off = v - mean
    p = off @ axes
    return p, np.sqrt(np.maximum(0, (off * off).sum(1) - (p * p).sum(1)))


def nearest(v: np.ndarray, p: np.ndarray, r: np.ndarray, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid, ties to the smaller number; and how many were verified.

    |p - p'|^2 + (r - r')^2 never exceeds the squared distance. The centroid with the least bound is measured first, in
    integers; those whose bound (less what rounding of coordinates to single precision can add) is not above that distance
    survive and are measured too.
    """
    cp, cr = rotate(centroids.astype(float), mean, axes)
    size, csize = (p * p).sum(1) + r * r, (cp * cp).sum(1) + cr * cr
    bound = size[:, None] + csize[None, :] - 2 * (p @ cp.T) - 2 * np.outer(r, cr)
    bound -= 1e-6 * (size[:, None] + csize[None, :] + 1)
    rows = np.arange(len(v))
    cluster = bound.argmin(1)
    gap = v - centroids[cluster]
    least = (gap * gap).sum(1)
    survives = bound <= least[:, None]
    survives[rows, cluster] = False
    verified = 1 + survives.sum(1)
    for c in range(len(centroids)):
        at = np.flatnonzero(survives[:, c])
        gap = v[at] - centroids[c]
        d = (gap * gap).sum(1)
        better = (d < least[at]) | ((d == least[at]) & (c < cluster[at]))
        cluster[at[better]], least[at[better]] = c, d[better]
    return cluster, least, verified


def _rotated(vectors: DataFrame, width: int, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """vectors with p, the leading coordinates, and r, the norm of the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            p, r = rotate(_matrix(batch.column("v"), width, float), mean, axes)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists, pa.array(r)], ["vec_id", "v", "p", "r"])

    return vectors.mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, v array<int>, p array<float>, r double")


def _assigned(table: DataFrame, width: int, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, n_verified of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            v, p = _matrix(batch.column("v"), width, np.int64), _matrix(batch.column("p"), axes.shape[1], float)
            cluster, distance, verified = nearest(v, p, batch.column("r").to_numpy(), centroids, mean, axes)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(verified, pa.int32())], ["vec_id", "cluster", "distance", "n_verified"])

    return table.mapInArrow(run, f"vec_id {dict(table.dtypes)['vec_id']}, cluster int, distance long, n_verified int")


def _moved(table: DataFrame, width: int, centroids: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of their vectors, summed exactly; empty ones stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centroids), width + 1), object)
        for batch in small(batches):
            v, p = _matrix(batch.column("v"), width, np.int64), _matrix(batch.column("p"), axes.shape[1], float)
            cluster, _, _ = nearest(v, p, batch.column("r").to_numpy(), centroids, mean, axes)
            for c in np.unique(cluster):
                own = v[cluster == c]
                total[c, :width] += own.sum(0).astype(object)
                total[c, width] += len(own)
        c, j = np.indices(total.shape)
        held = np.flatnonzero(np.repeat(total[:, width] != 0, width + 1))
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()[held], pa.int32()), pa.array(j.ravel()[held], pa.int32()), pa.array([str(x) for x in total.ravel()[held]], pa.string())], ["c", "j", "x"])

    sums = table.mapInArrow(run, "c int, j int, x string").groupBy("c", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    at = {(r["c"], r["j"]): int(r["x"]) for r in sums}
    out = centroids.copy()
    for c in {c for c, _ in at}:
        out[c] = [at[c, j] // at[c, width] for j in range(width)]
    return out


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, width: int = 64, scale: int = 64, share: float = 0.9) -> DataFrame:
    """One row a kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, n_verified.

    Vectors are those of whole_vectors. The k with the smallest SHA-256 of `<seed>:<vec_id>` are the first centroids (of
    fewer vectors all; a null id reads null; equal ids by components). Each of `rounds` assigns all vectors and moves the
    centroids, then vectors are assigned once more. Axes come from all vectors, as many as hold `share` of their variance,
    and only filter: distances are integers, so the result does not depend on them. Rotated vectors are written once and every round reads them; what comes to the
    driver is k * (width + 1) sums a round and the moments, both bounded by parameters, and the k centroids go out.
    n_verified: centroids that the bounds left to be measured in the last assignment.

    Repeated rows and ids are vectors of their own. Other columns are left out. No kept vectors give no rows.
    """
    vectors = whole_vectors(embeddings, width, scale)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    first = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    empty = f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_verified int"
    if not first:
        return embeddings.sparkSession.createDataFrame([], empty)
    centroids = np.array([r["v"] for r in first], np.int64)
    mean, axes = principal_axes(vectors, width, share)
    table = materialise(_rotated(vectors, width, mean, axes))
    for _ in range(rounds):
        centroids = _moved(table, width, centroids, mean, axes)
    assigned = materialise(_assigned(table, width, centroids, mean, axes))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = embeddings.sparkSession.createDataFrame([(c, sums.get(c, 0), total, d) for c, d in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_verified")
