"""Centroid clustering with PCA-rotated filtering.

The vectors' principal axes give a rotation. Stored beside each vector are its leading rotated
coordinates and the norm of the rest. The squared distance of two vectors is at least that of
their leading coordinates plus the squared difference of their residual norms, so most
centroids are ruled out by a few coordinates; what is left is verified in integers. A round is
one pass over the stored table: tasks hand on one sum a cluster, and the driver holds nothing
but the centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import Scratch, cut
from cairn.llm.vectors import integer_vectors, lists, matrix

#: Leading coordinates are so many that they hold this share of the variance.
SHARE = 0.6
#: Vectors whose bounds are computed at a time.
ROWS = 4096


class Rotation:
    """Orthonormal axes by descending variance around a mean; `lead` of them are kept."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, lead: int):
        self.mean, self.axes, self.lead = mean, axes, lead

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leading coordinates, residual norms) of rows."""
        y = (x - self.mean) @ self.axes
        return y[:, : self.lead], np.sqrt((y[:, self.lead :] ** 2).sum(1))


def fit_rotation(vectors: DataFrame, dim: int, share: float = SHARE) -> Rotation:
    """The principal axes of all vectors(x): tasks hand on sums of products, of which the driver gets dim * (dim + 1) in all."""

    def run(batches):
        sums = np.zeros((dim + 1, dim))
        n = 0
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            sums[:dim] += x.T @ x
            sums[dim] += x.sum(0)
            n += len(x)
        if n:
            i, j = np.divmod(np.arange((dim + 1) * dim), dim)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums.ravel()), pa.array(np.full(len(i), n))], ["i", "j", "s", "n"])

    parts = vectors.select("x").mapInArrow(run, "i int, j int, s double, n long").groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    found = parts.toArrow().to_pydict()  # dim * (dim + 1) numbers
    sums, n = np.zeros((dim + 1, dim)), max(found["n"], default=1)
    sums[found["i"], found["j"]] = found["s"]
    mean = sums[dim] / n
    variance, axes = np.linalg.eigh(sums[:dim] / n - np.outer(mean, mean))
    variance, axes = np.maximum(variance[::-1], 0), axes[:, ::-1]
    held = np.cumsum(variance) / max(variance.sum(), 1e-30)
    return Rotation(mean, np.ascontiguousarray(axes), min(dim, int(np.searchsorted(held, share)) + 1))


class Centroids:
    """Centroids as integers with their rotated form."""

    def __init__(self, rotation: Rotation, rows: np.ndarray):
        self.x = rows.astype(np.float64)
        self.lead, self.rest = rotation.apply(self.x)
        self.most = float((self.x**2).sum(1).max(initial=0.0))

    def assign(self, x: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(number of the nearest centroid, its squared distance, distances verified) of every row; ties go to the smaller number.

        All integers and their sums are below 2**53, so the doubles that hold them are exact. The
        bounds are rotated and rounded; a slack above their rounding error keeps every centroid
        that could be the nearest.
        """
        bound = (lead * lead).sum(1)[:, None] + (self.lead * self.lead).sum(1)[None, :] - 2 * lead @ self.lead.T + (rest[:, None] - self.rest[None, :]) ** 2
        slack = 1e-9 * (1.0 + self.most + float((x * x).sum(1).max(initial=0.0)))
        exact = lambda rows, cols: ((x[rows] - self.x[cols]) ** 2).sum(1)
        everyone = np.arange(len(x))
        first = bound.argmin(1)
        near = exact(everyone, first)
        distance = np.full(bound.shape, np.inf)
        distance[everyone, first] = near
        left = bound <= near[:, None] + slack
        left[everyone, first] = False
        rows, cols = np.nonzero(left)
        for a in range(0, len(rows), 16 * ROWS):
            r, c = rows[a : a + 16 * ROWS], cols[a : a + 16 * ROWS]
            distance[r, c] = exact(r, c)
        number = distance.argmin(1)
        return number, distance[everyone, number].astype(np.int64), len(x) + len(rows)


def _slices(batches, dim: int):
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            lead = part.column("lead").flatten().to_numpy(zero_copy_only=False)
            yield part, matrix(part.column("x"), dim), lead.reshape(part.num_rows, -1), part.column("rest").to_numpy()


def _sums(stored: DataFrame, centroids: Centroids, dim: int) -> list[tuple[int, int, list[int]]]:
    """(cluster, rows, componentwise sums) of one assignment: one row a cluster."""
    k = len(centroids.x)

    def run(batches):
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for _, x, lead, rest in _slices(batches, dim):
            number, _, _ = centroids.assign(x, lead, rest)
            np.add.at(total, number, x.astype(np.int64))
            n += np.bincount(number, minlength=k)
        used = np.flatnonzero(n)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used]), lists(total[used])], ["cluster", "n", "s"])

    parts = stored.select("x", "lead", "rest").mapInArrow(run, "cluster int, n long, s array<long>")
    parts = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[j]) for j in range(dim))).alias("s"))
    return [(r.cluster, r.n, list(r.s)) for r in parts.collect()]  # k rows


def cluster(rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, salt: str = "2:", share: float = SHARE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of rows(vec_id, embedding).

    The centroids start as the k vectors with the least sha256 of salt and vec_id; each round
    assigns all vectors and moves every centroid that has some to the floor of their mean. Left
    out are vectors of other dimensions, null or with null or non-finite components. Every row of
    a repeated vec_id is a vector; ties at the start go to the least vector. Rows with a null
    vec_id are vectors too, and the last that a centroid would start from. Fewer than k vectors
    are as many centroids; no vectors, no rows. Other columns are not read.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    vectors = integer_vectors(rows).where(F.col("dim") == dim).select("vec_id", "x")
    rotation = fit_rotation(vectors, dim, share)

    def rotate(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                lead, rest = rotation.apply(matrix(part.column("x"), dim))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("x"), lists(lead), pa.array(rest)], ["vec_id", "x", "lead", "rest"])

    stored = scratch.table(vectors.mapInArrow(rotate, "vec_id long, x array<int>, lead array<double>, rest double"))
    order = [F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x"]
    start = [r.x for r in stored.select("vec_id", "x").orderBy(*order).limit(k).collect()]  # k vectors
    schema = "vec_id long, cluster int, distance long"
    if not start:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    places = [list(map(int, x)) for x in start]
    for _ in range(rounds):
        for number, n, sums in _sums(stored, Centroids(rotation, np.array(places)), dim):
            places[number] = [s // n for s in sums]
    last = Centroids(rotation, np.array(places))

    def assign(batches):
        for part, x, lead, rest in _slices(batches, dim):
            number, distance, _ = last.assign(x, lead, rest)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    found = cut(stored.mapInArrow(assign, schema))
    scratch.drop(stored)
    totals = {r["cluster"]: r.d for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    told = [(c, totals.get(c, 0), sum(totals.values()), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(places)]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
