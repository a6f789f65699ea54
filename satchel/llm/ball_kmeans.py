"""Ball k-means on integer vectors: exact Lloyd rounds that compare a member only with centroids that can take it.

A cluster is a ball: its centroid and the greatest distance of a member. Another centroid is a neighbour if half the
distance between the two centroids is no more than that radius; others are nearer to no member. Neighbours in ascending
distance cut the ball into a stable core, whose members keep their cluster without a comparison, and annuli: members of the
n-th annulus are compared with the n nearest neighbours. Squared distances are integers, so nothing is rounded; a member on
a border is compared, and of equal distances the smaller number wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satchel.llm.store import drop, materialize, new_path

#: Components reach at most this far from zero, so that squared distances of up to 64 of them fit 64 bits.
REACH = 1 << 26


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64) -> DataFrame:
    """``key`` and ``v``, floor(scale * x) of each component, of the vectors with ``dimensions`` finite components.

    Other vectors are left out, and so are those with a scaled component of more than REACH, whose squared distances
    would not fit 64 bits. Null keys and repeated rows stay."""
    v = F.col(vector)
    fits = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < REACH))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.where(v.isNotNull() & F.coalesce(fits, F.lit(False))).select(F.col(key).alias("key"), whole.alias("v"))


def first_centroids(vectors: DataFrame, order: Column, k: int) -> np.ndarray:
    """The vectors of the ``k`` least rows by ``order``, null last, equal ones by their components."""
    found = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid, by comparing all of them."""
    at, least = np.zeros(len(x), np.int64), squared(x, centroids[0])
    for j in range(1, len(centroids)):
        d = squared(x, centroids[j])
        closer = d < least
        at[closer], least[closer] = j, d[closer]
    return at, least


class Balls:
    """Centroids with the squared radii of their clusters, and each one's neighbours in ascending distance."""

    def __init__(self, centroids: np.ndarray, radii: np.ndarray):
        self.centroids, self.neighbours = centroids, []
        for i in range(len(centroids)):
            apart = squared(centroids, centroids[i])
            apart[i] = np.iinfo(np.int64).max
            near = np.flatnonzero((apart <= 4 * radii[i]) & (np.arange(len(centroids)) != i))
            near = near[np.argsort(apart[near], kind="stable")]
            self.neighbours.append((near, apart[near]))

    def nearest(self, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """As nearest(), for members of the clusters ``at``; and how many distances to other centroids were taken."""
        at, compared = at.copy(), 0
        least = squared(x, self.centroids[at])
        own = at.copy()
        for i in np.unique(own):
            near, apart = self.neighbours[i]
            members = np.flatnonzero(own == i)
            annulus = np.searchsorted(apart, 4 * least[members], "right")  # 0: the stable core
            for n, j in enumerate(near):
                members, annulus = members[annulus > n], annulus[annulus > n]
                if not len(members):
                    break
                d = squared(x[members], self.centroids[j])
                compared += len(members)
                closer = (d < least[members]) | (d == least[members]) & (j < at[members])
                at[members[closer]], least[members[closer]] = j, d[closer]
        return at, least, compared


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def assigned(vectors: DataFrame, balls: Balls | np.ndarray) -> DataFrame:
    """``vectors`` (key, v, and cluster if ``balls`` has radii) with ``cluster`` and ``distance``, squared."""
    kind = vectors.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(1))
            at, least = balls.nearest(x, batch.column(2).to_numpy())[:2] if isinstance(balls, Balls) else nearest(x, balls)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(at), pa.array(least)], names=["key", "v", "cluster", "distance"])

    columns = ["key", "v", "cluster"] if isinstance(balls, Balls) else ["key", "v"]
    return vectors.select(*columns).mapInArrow(run, f"key {kind}, v array<long>, cluster long, distance long")


def moved(members: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floor of each cluster's mean; empty clusters stay. A task sends one row a cluster and component at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, at = _vectors(batch.column(0)), batch.column(1).to_numpy()
                for i in np.unique(at):
                    total[i] += x[at == i].sum(0)
                n += np.bincount(at, minlength=len(n))
        for i in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1] + 1, i)), pa.array(np.arange(-1, total.shape[1])), pa.array(np.concatenate(([n[i]], total[i])))], names=["cluster", "part", "sum"])

    out, n = centroids.copy(), {}
    found = members.select("v", "cluster").mapInArrow(run, "cluster long, part long, sum long").groupBy("cluster", "part").agg(F.sum("sum").alias("sum")).collect()
    for r in found:
        if r.part < 0:
            n[r.cluster] = r.sum
    for r in found:
        if r.part >= 0:
            out[r.cluster, r.part] = r.sum // n[r.cluster]
    return out


def radii(members: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The greatest squared distance of a member to its cluster's centroid; 0 for empty clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                at = batch.column(1).to_numpy()
                np.maximum.at(most, at, squared(_vectors(batch.column(0)), centroids[at]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most))), pa.array(most)], names=["cluster", "most"])

    out = np.zeros(len(centroids), np.int64)
    for r in members.select("v", "cluster").mapInArrow(run, "cluster long, most long").groupBy("cluster").agg(F.max("most").alias("most")).collect():
        out[r.cluster] = r.most
    return out


def cluster(vectors: DataFrame, start: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` (key, v) with ``cluster`` and ``distance`` after ``rounds`` of assigning and moving, and a last assigning;
    and the centroids. The driver and each task hold the centroids, their radii and sums: a fixed number of rows. A round's
    members are a table in the shared folder, which the next one replaces."""
    spark = vectors.sparkSession
    path = new_path(spark, "balls")
    members, centroids = materialize(assigned(vectors, start), "balls", path), start
    for _ in range(rounds):
        centroids = moved(members, centroids)
        after = new_path(spark, "balls")
        members = materialize(assigned(members, Balls(centroids, radii(members, centroids))), "balls", after)
        drop(spark, path)
        path = after
    return members, centroids


def clusters(rows: DataFrame, k: int, rounds: int, order: Column, key: str = "vec_id", vector: str = "embedding", dimensions: int = 64, scale: int = 64) -> DataFrame:
    """``key``, ``cluster``, squared ``distance``, ``cluster_inertia`` and ``inertia`` (sums of distances), and
    ``centroid_sha256`` (of the final centroid's components joined by commas) of every vector that whole_vectors() keeps.

    The clusters start as the ``k`` least rows by ``order``, an expression over ``key``; with fewer vectors there are as
    many clusters. Null keys start only if there are no others. Repeated rows are vectors each. Other columns are not read.
    No rows give no rows."""
    spark = rows.sparkSession
    vectors = whole_vectors(rows, key, vector, dimensions, scale)
    start = first_centroids(vectors, order, k)
    columns = [F.col("key").alias(key), F.col("cluster").cast("int").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not len(start):
        empty = vectors.select("key", *(F.lit(0).cast("long").alias(c) for c in ("cluster", "distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
        return empty.where("false").select(*columns)
    members, centroids = cluster(vectors, start, rounds)
    sums = {r.cluster: r.sum for r in members.groupBy("cluster").agg(F.sum("distance").alias("sum")).collect()}
    told = spark.createDataFrame([(i, sums.get(i, 0), sum(sums.values()), ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster long, cluster_inertia long, inertia long, components string")
    told = told.select("cluster", "cluster_inertia", "inertia", F.sha2("components", 256).alias("centroid_sha256"))
    return members.join(F.broadcast(told), "cluster").select(*columns)
