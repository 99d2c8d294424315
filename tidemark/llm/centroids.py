"""Centroid clustering (exact k-means in whole numbers) by Shallot search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.staging import made_since, mark, release

from .common import lean, written
from .vectors import finite, matrix, whole

#: What bounds are widened by, so that no rounding of doubles can make them wrong.
SLACK = 1e-12
#: Entries below this in size keep squared distances of 64 dimensions within long.
MOST = 1 << 19


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


class Search:
    """Nearest centroids of vectors that remember their nearest and second-nearest one and bounds on the distances.

    A vector is left alone where its upper bound shows that no other centroid can be as near. Otherwise it is compared with its
    two remembered centroids. The scan starts from the closer one and goes through that one's neighbours, the nearest first,
    as far as one could be among the two best; each better second-best shrinks this ball. Bounds are doubles with some slack,
    what survives them is compared in whole numbers, and of equal distances the smaller number wins."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray):
        self.at = centroids
        k = len(centroids)
        between = np.sqrt(np.array([squared(centroids, c[None, :]) for c in centroids], np.float64).reshape(k, k))
        moved = np.sqrt(squared(centroids, before).astype(np.float64)) * (1 + SLACK)
        np.fill_diagonal(between, np.inf)
        self.half = between.min(axis=1) / 2 * (1 - SLACK)
        self.order = np.argsort(between, axis=1, kind="stable")[:, : k - 1]
        self.between = np.take_along_axis(between, self.order, axis=1) * (1 - SLACK)
        self.moved = moved
        # the largest move of any other centroid
        self.others = np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])

    def nearest(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
        """(nearest, second-nearest, upper, lower, squared distance): the bounds are of the nearest centroid and of all others. The
        distance is -1 for vectors that needed no comparison, unless exact."""
        far = np.full(len(x), -1, np.int64)
        if len(self.at) == 1:
            return np.zeros_like(a), b, np.full(len(x), np.inf), lower, squared(x, self.at[a])
        upper = (upper + self.moved[a]) * (1 + SLACK)
        lower = np.maximum(lower * (1 - SLACK) - self.others[a], 0)
        safe = np.maximum(lower, self.half[a])
        i = np.flatnonzero(~(upper < safe))
        far[i] = squared(x[i], self.at[a[i]])
        upper[i] = np.sqrt(far[i].astype(np.float64)) * (1 + SLACK)
        i = i[~(upper[i] < safe[i])]
        if len(i):
            self.scan(x, i, a, b, upper, lower, far)
        if exact:
            rest = np.flatnonzero(far < 0)
            far[rest] = squared(x[rest], self.at[a[rest]])
        return a, b, upper, lower, far

    def scan(self, x: np.ndarray, i: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray, far: np.ndarray) -> None:
        first, second, d1 = a[i], b[i], far[i]
        d2 = squared(x[i], self.at[second])
        swap = (d2 < d1) | ((d2 == d1) & (second < first))
        first, second = np.where(swap, second, first), np.where(swap, first, second)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, partner, radius = first.copy(), second.copy(), np.sqrt(d1.astype(np.float64))
        live = np.arange(len(i))
        for r in range(self.order.shape[1]):
            ball = (radius[live] + np.sqrt(d2[live].astype(np.float64))) * (1 + SLACK)
            live = live[self.between[start[live], r] <= ball]
            if not len(live):
                break
            j = self.order[start[live], r]
            new = j != partner[live]
            m, j = live[new], j[new]
            d = squared(x[i[m]], self.at[j])
            best = (d < d1[m]) | ((d == d1[m]) & (j < first[m]))
            next_best = ~best & ((d < d2[m]) | ((d == d2[m]) & (j < second[m])))
            t = m[best]
            second[t], d2[t], first[t], d1[t] = first[t], d1[t], j[best], d[best]
            t = m[next_best]
            second[t], d2[t] = j[next_best], d[next_best]
        a[i], b[i], far[i] = first, second, d1
        upper[i] = np.sqrt(d1.astype(np.float64)) * (1 + SLACK)
        lower[i] = np.sqrt(d2.astype(np.float64)) * (1 - SLACK)


STATE = "vec_id long, v array<int>, was int, cluster int, second int, upper double, lower double, distance long"


def centroid_clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:", vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid), a row for each vector that counts.

    Vectors with exactly `dims` entries count, none null or non-finite; an entry x is floor(scale * x). Centroids start as the k vectors
    with the smallest SHA-256 of prefix and vec_id; each round assigns all vectors to their nearest centroid (squared
    Euclidean distance, of equal ones the smaller number) and moves centroids to the floor of their vectors' mean; at the end
    vectors are assigned once more. distance is squared, inertia its sum over the cluster and over all.

    Search: see above. Each round's state is a written table; only vectors that change their cluster change its sums, and
    what reaches the driver is a row a cluster. k * k distances between centroids go to each task.

    With fewer than k vectors, each is a centroid. Repeated rows are vectors of their own; ids that stand more than once, and
    null ids (hashed as if empty), are ordered by their vectors. Centroids without vectors stay where they are. An entry
    of 2**19 or more in size ends the query with an error, as distances wouldn't be longs. No vectors give an empty result;
    other columns are ignored."""
    spark = vectors.sparkSession
    kept = vectors.where(finite(vector) & (F.size(vector) == dims))
    kept = kept.select(F.col(vec_id).cast("long").alias("vec_id"), whole(vector, scale, MOST, kind="int").alias("v"))
    key = F.sha2(F.concat(F.lit(prefix), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    at = np.array([r["v"] for r in kept.orderBy(key, "v").limit(k).collect()], np.int64).reshape(-1, dims)
    sums, counts = np.zeros(at.shape, object), np.zeros(len(at), object)

    def assigned(state: DataFrame, now: np.ndarray, before: np.ndarray, last: bool) -> DataFrame:
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Search(now, before)
            for rows in lean(batches):
                own = [rows.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster", "second", "upper", "lower")]
                was = own[0].copy()
                a, b, upper, lower, far = search.nearest(matrix(rows.column("v"), dims), *own, exact=last)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), rows.column("v"), *map(pa.array, (was, a, b, upper, lower, far))], names=[c.split()[0] for c in STATE.split(", ")])

        return state.mapInArrow(step, STATE)

    first, inf = F.lit(0), float("inf")
    state = kept.select("*", first.alias("cluster"), F.lit(min(1, len(at) - 1)).alias("second"), F.lit(inf).alias("upper"), F.lit(0.0).alias("lower"))
    if not len(at):
        return kept.select("vec_id", first.alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"), F.col("v").cast("array<long>").alias("centroid"))
    begun, before = mark(), at
    for r in range(rounds):
        state = written(assigned(state, at, before, False), "centroids")
        release(spark, made_since(begun, but_last=True))
        change = [F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign"))] + ([F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign"))] if r else [])
        moved = (state.where("was <> cluster") if r else state).select("v", F.explode(F.array(*change)).alias("x")).groupBy("x.c")
        for row in moved.agg(F.sum("x.sign"), *[F.sum(F.col("x.sign") * F.col("v")[i].cast("long")) for i in range(dims)]).collect():
            counts[row[0]] += row[1]
            sums[row[0]] += np.array(row[2:], object)
        before, at = at, at.copy()
        for j in range(len(at)):
            if counts[j]:
                at[j] = [s // counts[j] for s in sums[j]]
    state = written(assigned(state, at, before, True).select("vec_id", "cluster", "distance"), "centroids")
    release(spark, made_since(begun, but_last=True))
    inertia = state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r["cluster_inertia"] for r in inertia)
    told = [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(",".join(map(str, at[r["cluster"]].tolist())).encode()).hexdigest(), at[r["cluster"]].tolist()) for r in inertia]
    # a row a cluster
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string, centroid array<long>")
    return state.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", *told.columns[1:])
