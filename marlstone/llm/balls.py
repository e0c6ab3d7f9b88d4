"""Clusters of vectors by exact integer k-means, with balls to spare comparisons.

A vector is kept if it has DIM components, all finite numbers; its components are scaled to
integers, floor(SCALE * x). A round assigns each vector to the nearest centroid (squared
Euclidean distance, ties to the smaller number) and moves each centroid to the floor of its
members' mean. All of this is exact: integers of 64 bits in tasks, of any size beyond.

Balls. A cluster is a ball: its centroid c_i and a radius r_i that holds all members. Only
centroids with |c_i - c_j| <= 2 r_i can be nearer to a member, or as near: the neighbours of
i. Of these, c_j is compared with a member x only if |c_i - c_j| <= 2 |x - c_i|. So members with
none of those, the stable core, stay without a comparison, and the rest of the ball falls into
annuli, each of which is compared with its first neighbours only. The first assignment starts
from one ball around centroid 0.

A round is one pass over the vectors, in which each task sends a row for each of its clusters:
count, sums, and the largest distance to the old centroid. That and the centroid's move bound
the radius around the new one, so that radii need no pass of their own. The driver sees one
number for each cluster and component. Vectors and their clusters are written after each
round, and the round before is deleted.

Edge cases: null arrays, other lengths, null and non-finite components are left out; repeated
rows and rows that share a vec_id are each a vector (as first centroids, ties of the id go by
the components); a null vec_id comes last among them; fewer vectors than clusters make
fewer clusters; components beyond LIMIT after scaling raise an error, since their squared
distances may pass 64 bits; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialised, materialise
from . import common as C

DIM = 64
CLUSTERS = 8
ROUNDS = 10
SCALE = 1024
SEED = "3:"
LIMIT = 1 << 27
POINT = "vec_id long, point binary, cluster int, distance long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def scaled(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """vec_id and point (dim integers of 32 bits) of the vectors that are kept."""
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter((F.size("embedding") == dim) & finite)

    def scale_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.floor(batch.column(1).flatten().to_numpy().astype(np.float64) * scale)
            if len(rows) and np.abs(rows).max() > LIMIT:
                raise ValueError(f"a vector has a component beyond {LIMIT / scale}")
            rows = rows.astype("<i4").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["vec_id", "point"])

    return kept.mapInArrow(scale_all, "vec_id long, point binary")


class Balls:
    """Centroids with the neighbours that members of each must be compared with, nearest first."""

    def __init__(self, centroids: list[list[int]], radii: list[int | None]):
        self.centroids = np.array(centroids, np.int64)
        apart = ((self.centroids[:, None, :] - self.centroids[None, :, :]) ** 2).sum(2)
        self.near: list[list[tuple[int, int]]] = []
        for i, radius in enumerate(radii):
            others = sorted((int(d), j) for j, d in enumerate(apart[i]) if j != i)
            self.near.append([(d, j) for d, j in others if radius is None or d <= 4 * radius * radius])

    def assign(self, points: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each point its nearest centroid and the squared distance, from the cluster it was in; and how many distances that took."""
        own = ((points - self.centroids[cluster]) ** 2).sum(1)
        best, least, taken = cluster.copy(), own.copy(), len(points)
        for i in np.unique(cluster).tolist():
            inside = np.flatnonzero(cluster == i)
            for apart, j in self.near[i]:
                inside = inside[4 * own[inside] >= apart]  # the annulus from here on outwards
                if not len(inside):
                    break
                far = ((points[inside] - self.centroids[j]) ** 2).sum(1)
                taken += len(inside)
                nearer = (far < least[inside]) | ((far == least[inside]) & (j < best[inside]))
                best[inside[nearer]], least[inside[nearer]] = j, far[nearer]
        return best, least, taken


def assigned(points: DataFrame, balls: Balls, dim: int) -> DataFrame:
    """points with cluster and distance by the nearest centroid."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)
                cluster, distance, _ = balls.assign(rows, batch.column(2).to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "point", "cluster", "distance"])

    return points.select("vec_id", "point", "cluster").mapInArrow(nearest, POINT)


def moved(points: DataFrame, centroids: list[list[int]], dim: int) -> tuple[list[list[int]], list[int | None]]:
    """The centroids of assigned points, and a radius around each that holds its points."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, far = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dim), np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                rows, cluster = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4").reshape(-1, dim), batch.column(1).to_numpy()
                np.add.at(count, cluster, 1)
                np.add.at(total, cluster, rows)
                np.maximum.at(far, cluster, batch.column(2).to_numpy())
        held = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(count[held]), pa.array(far[held]), pa.array(list(total[held]), pa.list_(pa.int64()))], names=["cluster", "n", "far", "total"])

    parts = points.select("point", "cluster", "distance").mapInArrow(summed, "cluster int, n long, far long, total array<long>")
    each = parts.select("cluster", "n", "far", F.posexplode("total").alias("k", "x"))
    rows = each.groupBy("cluster", "k").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # clusters x components
    after, radii = [list(c) for c in centroids], [0] * len(centroids)
    for r in rows:
        after[r.cluster][r.k] = int(r.x) // r.n
    for r in rows:
        if r.k == 0:
            step = sum((x - y) ** 2 for x, y in zip(after[r.cluster], centroids[r.cluster], strict=True))
            radii[r.cluster] = isqrt(r.far) + isqrt(step) + 2
    return after, radii  # type: ignore[return-value]


def cluster(vectors: DataFrame, dim: int = DIM, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """Each vector of vectors(vec_id, embedding) that is kept: see RESULT."""
    spark = vectors.sparkSession
    C.ship(spark)
    now = materialise(scaled(vectors, dim, scale).withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long")), "points")
    draw = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = now.select(draw.alias("draw"), "point").orderBy(F.asc_nulls_last("draw"), "point").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], RESULT)
    centroids = [np.frombuffer(r.point, "<i4").astype(int).tolist() for r in first]
    radii: list[int | None] = [None] * len(centroids)
    for k in range(rounds + 1):
        then, now = now, materialise(assigned(now, Balls(centroids, radii), dim), "points")
        drop_materialised(then)
        if k < rounds:
            centroids, radii = moved(now, centroids, dim)
    held = {r.cluster: r.inertia for r in now.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    names = [(k, held.get(k, 0), sum(held.values()), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids)]
    table = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
