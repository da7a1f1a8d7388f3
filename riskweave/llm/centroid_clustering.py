"""Centroid clustering with Orchard's search for the nearest centroid, in whole numbers.

A component x counts as floor(scale * x).  Every centroid has a list of the others, nearest first.  A vector walks down the list
of its current centroid; when a centroid on it is closer, that one becomes current and its list is walked from the top.
Centroids already measured are marked and not measured again.  The walk ends at the first centroid that lies strictly more
than twice the current distance away: by the triangle inequality it and all after it are strictly farther, so no tie is lost.
A whole batch walks at once: each step moves every vector that has not ended.

Between passes only the centroids and their lists are with the driver, a size that the number of centroids sets and no row
changes.  Each task adds up the vectors of its clusters and hands on one sum for each cluster and component, cut into parts of
32 bits, so that sums of any size stay exact.

Edge rules: vectors that are null, have another number of components, or hold null or non-finite components take no part;
rows without id do, but start as a centroid last; repeated rows count each, and equal hashes start in the order of their
components; equal distances go to the smaller number; with fewer vectors than centroids there are as many centroids as
vectors; a distance or sum that a long cannot hold is null, while assignment stays exact; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskweave.llm.vectors import usable
from riskweave.sources.scratch import staged

SMALL = 1 << 26  # components below this keep 4 * distance within 64 bits for up to 64 components
MOST = (1 << 63) - 1
PART = 32  # bits of the parts of a sum


def fits(values: np.ndarray) -> bool:
    """Whether squared distances between such rows, four times over, stay within 64 bits."""
    return not values.size or int(np.abs(values).max()) < SMALL // max(1, -(-values.shape[1] // 64))


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit numbers where they are small enough, else as Python's."""
    if np.abs(vectors).max(initial=0.0) < 2.0**60 / scale:
        return np.floor(vectors * scale).astype(np.int64)
    one = lambda x: int(x) * scale if abs(x) >= 2.0**53 else floor(x * scale)
    return np.array([[one(x) for x in row] for row in vectors.tolist()], dtype=object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to the rows of ``b``, pair by pair or to a single row."""
    gap = a - b
    return (gap * gap).sum(axis=1)


@dataclass
class Centroids:
    """Centroids with, for each, the others by distance (ties: smaller number) and those squared distances."""

    at: np.ndarray
    order: np.ndarray
    apart: np.ndarray

    @staticmethod
    def of(at: np.ndarray) -> Centroids:
        if at.dtype == object and fits(at):
            at = at.astype(np.int64)
        elif at.dtype != object and not fits(at):
            at = at.astype(object)
        k = len(at)
        order, apart = np.empty((k, k - 1), np.int64), np.empty((k, k - 1), at.dtype)
        for i in range(k):
            d = squared(at, at[i])
            others = sorted((j for j in range(k) if j != i), key=lambda j: (d[j], j))
            order[i], apart[i] = others, d[others]
        return Centroids(at, order, apart)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row and its squared distance."""
        if rows.dtype != self.at.dtype or (rows.dtype != object and not fits(rows)):
            return Centroids(self.at.astype(object), self.order, self.apart.astype(object)).nearest_of(rows.astype(object))
        return self.nearest_of(rows)

    def nearest_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(rows), len(self.at)
        current, place = np.zeros(n, np.int64), np.zeros(n, np.int64)
        best = squared(rows, self.at[0])
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        walking = np.arange(n) if k > 1 else np.empty(0, np.int64)
        while len(walking):
            c, p = current[walking], place[walking]
            within = ~(self.apart[c, p] > 4 * best[walking]).astype(bool)
            walking, c, p = walking[within], c[within], p[within]
            other = self.order[c, p]
            place[walking] = p + 1
            new = ~seen[walking, other]
            at, j = walking[new], other[new]
            d = squared(rows[at], self.at[j])
            seen[at, j] = True
            closer = ((d < best[at]) | ((d == best[at]) & (j < current[at]))).astype(bool)
            at, j, d = at[closer], j[closer], d[closer]
            current[at], best[at], place[at] = j, d, 0
            walking = walking[place[walking] < k - 1]
        return current, best

    def digest(self) -> list[str]:
        """Of each centroid: sha256 of its components as decimal numbers joined by commas."""
        return [hashlib.sha256(",".join(str(int(x)) for x in row).encode()).hexdigest() for row in self.at]


def kept(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the lists that take part and their components as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    fine = np.isfinite(values).all(axis=1)  # a null component reads as NaN
    return rows[fine], values[fine]


def first_centroids(vectors: DataFrame, k: int, dim: int, scale: int, seed: int, key: str, vector: str) -> np.ndarray:
    """The ``k`` vectors whose ``seed:id`` has the smallest sha256."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") == dim) & usable("v", zero_too=True))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.select(hashed.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return whole(np.array([r["v"] for r in found], dtype=np.float64).reshape(len(found), dim), scale)


def moved(vectors: DataFrame, centroids: Centroids, dim: int, scale: int, vector: str) -> Centroids:
    """Each centroid at floor(sum / count) of its vectors; one without vectors stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, k = shared.value, len(shared.value.at)
        total, count = np.zeros((k, dim), dtype=object), np.zeros(k, np.int64)
        for batch in batches:
            _, values = kept(batch.column(0), dim)
            rows = whole(values, scale)
            cluster, _ = near.nearest(rows)
            count += np.bincount(cluster, minlength=k)
            for c in np.unique(cluster):
                total[c] += rows[cluster == c].sum(axis=0)
        out = []
        for c in np.flatnonzero(count).tolist():
            out.append((c, -1, 0, int(count[c])))
            for i, x in enumerate(map(int, total[c])):
                part = 0
                while x not in (0, -1) or part == 0:
                    out.append((c, i, part, x & ((1 << PART) - 1)))
                    x, part = x >> PART, part + 1
                out.append((c, i, part, x))  # 0 or -1: the sign
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        names = ["cluster", "component", "part", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

    parts = vectors.select(vector).mapInArrow(sums, "cluster int, component int, part int, value long")
    found = parts.groupBy("cluster", "component", "part").agg(F.sum("value").alias("value")).collect()
    count = {r["cluster"]: r["value"] for r in found if r["component"] < 0}
    total: dict[tuple[int, int], int] = {}
    for r in found:
        if r["component"] >= 0:
            at = (r["cluster"], r["component"])
            total[at] = total.get(at, 0) + (r["value"] << PART * r["part"])
    at = centroids.at.astype(object)
    for (c, i), x in total.items():
        at[c, i] = x // count[c]
    return Centroids.of(at)


def assigned(vectors: DataFrame, centroids: Centroids, dim: int, scale: int, key: str, vector: str) -> DataFrame:
    """key, cluster, distance of every vector that takes part."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = kept(batch.column(1), dim)
            cluster, distance = shared.value.nearest(whole(values, scale))
            held = [int(d) if d <= MOST else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(cluster, pa.int32()), pa.array(held, pa.int64())],
                names=[key, "cluster", "distance"],
            )

    schema = T.StructType([T.StructField(key, vectors.schema[key].dataType), T.StructField("cluster", T.IntegerType())])
    return vectors.select(key, vector).mapInArrow(run, schema.add("distance", T.LongType()))


def held_sum(rows: int | None, known: int, total) -> int | None:
    """A sum of distances, or none if one of them is missing or a long cannot hold it."""
    return int(total) if rows == known and total is not None and int(total) <= MOST else None


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dim: int = 64,
    scale: int = 64,
    seed: int = 1,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 after ``rounds`` rounds and a last assignment."""
    spark, kind = vectors.sparkSession, vectors.schema[key].dataType
    start = first_centroids(vectors, k, dim, scale, seed, key, vector)
    out = T.StructType([T.StructField(key, kind)]).add("cluster", "integer").add("distance", "long")
    if not len(start):
        out = out.add("cluster_inertia", "long").add("inertia", "long").add("centroid_sha256", "string")
        return spark.createDataFrame([], out)
    centroids = Centroids.of(start)
    for _ in range(rounds):
        centroids = moved(vectors, centroids, dim, scale, vector)
    placed = staged(assigned(vectors, centroids, dim, scale, key, vector), "assigned")
    total = F.sum(F.col("distance").cast("decimal(19,0)"))
    found = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count("distance").alias("known"), total.alias("total")).collect()
    every = held_sum(sum(r["n"] for r in found), sum(r["known"] for r in found), sum(int(r["total"] or 0) for r in found))
    digests = centroids.digest()
    facts = [(r["cluster"], held_sum(r["n"], r["known"], r["total"]), every, digests[r["cluster"]]) for r in found]
    small = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(small), "cluster").select(  # at most k rows
        key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
