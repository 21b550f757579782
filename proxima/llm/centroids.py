"""Exact integer k-means whose assignment is Orchard's search.

Vectors become integers, so sums, means and squared distances are exact and any order of
tasks gives the same centroids.  For every centroid the others are listed by distance.  A
vector starts at centroid 0 and walks that list; a closer centroid (or an equally close one
with a smaller number) is jumped to at once and its list is walked from the start; centroids
met before are marked and not measured again.  The walk ends where the next listed centroid
lies strictly beyond twice the vector's distance: by the triangle inequality none of the rest
can be closer, and one exactly at twice the distance may still tie.

A round is one pass over the vectors: each task sends one row of sums for each centroid and
component, Spark adds them up, and at most centroids x components numbers reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import arrow_column, write_table
from proxima.session import ship_package

DIM, SCALE, CENTROIDS, ROUNDS, SEED = 64, 1024, 8, 10, 3
LIMIT = 1 << 30  # components of vectors that are kept lie below it in size
FAST = 1 << 26   # below it four squared distances of 64 components fit 64 bits; above, Python's integers are used
LONGEST = (1 << 63) - 1
ROWS_AT_ONCE = 4096


def _exact(x: np.ndarray) -> np.ndarray:
    return x.astype(object) if len(x) and np.abs(x).max() >= FAST else x


@dataclass
class Lists:
    """Centroids with, for each, the others by distance (ties: smaller number)."""

    centroids: np.ndarray  # (k, components) int64
    order: np.ndarray      # (k, k) numbers, itself first
    apart: np.ndarray      # (k, k) squared distances in that order

    @classmethod
    def of(cls, centroids: np.ndarray) -> "Lists":
        k = len(centroids)
        wide = _exact(centroids)
        d = np.stack([((wide - c) ** 2).sum(axis=1) for c in wide])
        d[np.arange(k), np.arange(k)] = -1  # itself before its exact copies
        order = np.argsort(d, axis=1, kind="stable")
        return cls(centroids, order, np.maximum(np.take_along_axis(d, order, axis=1), 0))

    def nearest(self, x: np.ndarray):
        """(number, squared distance, centroids measured) for each row: Orchard's search, one
        step of all rows' walks at a time."""
        n, k = len(x), len(self.centroids)
        x, centroids = _exact(x), _exact(self.centroids)
        rows = np.arange(n)
        at, place = np.zeros(n, int), np.ones(n, int)
        best = ((x - centroids[0]) ** 2).sum(axis=1)
        met = np.zeros((n, k), bool)
        met[:, 0] = True
        live = rows if k > 1 else rows[:0]
        while len(live):
            # strictly beyond twice the distance: beyond four times its square
            live = live[(self.apart[at[live], place[live]] <= 4 * best[live]).astype(bool)]
            c = self.order[at[live], place[live]]
            new = ~met[live, c]
            r, c = live[new], c[new]
            met[r, c] = True
            d = ((x[r] - centroids[c]) ** 2).sum(axis=1)
            jump = ((d < best[r]) | ((d == best[r]) & (c < at[r]))).astype(bool)
            place[live] += 1
            r, c = r[jump], c[jump]
            at[r], best[r], place[r] = c, d[jump], 1
            live = live[place[live] < k]
        return at, best, met.sum(axis=1)


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, x): the kept vectors as integers ``floor(scale * component)``.  Kept are those with
    exactly ``dim`` components, none null, NaN or infinite, and none whose integer
    reaches 2^30 in size."""
    x = F.col(vector_col).cast("array<double>")
    fits = (F.size(x) == dim) & F.forall(x, lambda v: F.coalesce(F.abs(v * scale) < LIMIT, F.lit(False)))
    return vectors.where(F.coalesce(fits, F.lit(False))).select(F.col(id_col).alias("id"), F.transform(x, lambda v: F.floor(v * scale).cast("int")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``<seed>:<id>`` (a null id counts as the
    empty text; equal ids: by components), in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    top = rows.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in top], np.int64)


def _sums(rows: DataFrame, lists: Lists) -> DataFrame:
    """(cluster, pos, total, n): pos -1 counts the cluster's vectors."""
    shared = rows.sparkSession.sparkContext.broadcast(lists)
    k, dim = lists.centroids.shape

    def add(it):
        lists, total, n = shared.value, np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in it:
            x = _matrix(b.column(0), dim)
            for i in range(0, len(x), ROWS_AT_ONCE):
                part = x[i:i + ROWS_AT_ONCE]
                at, _, _ = lists.nearest(part)
                np.add.at(total, at, part)
                n += np.bincount(at, minlength=k)
        c, p = np.nonzero(n[:, None] * np.ones((1, dim + 1), np.int64))
        yield pa.record_batch([pa.array(c), pa.array(p - 1), pa.array(np.hstack([n[:, None], total])[c, p])], names=["cluster", "pos", "total"])

    return rows.select("x").mapInArrow(add, "cluster bigint, pos bigint, total bigint").groupBy("cluster", "pos").agg(F.sum("total").alias("total"))


def fit(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after ``rounds`` rounds over ``whole_numbers`` rows: every non-empty one
    becomes the floor of its vectors' exact mean, empty ones stay.  Fewer than ``k`` vectors
    give that many centroids."""
    ship_package(rows.sparkSession)
    centroids = starts(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        got = _sums(rows, Lists.of(centroids)).collect()  # centroids x (components + 1) numbers
        n = {r.cluster: r.total for r in got if r.pos < 0}
        for r in got:
            if r.pos >= 0:
                centroids[r.cluster, r.pos] = r.total // n[r.cluster]
    return centroids


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of ``whole_numbers`` rows."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(Lists.of(centroids))
    dim = centroids.shape[1]

    def near(it):
        for a in it:
            x = _matrix(a, dim)
            got = [shared.value.nearest(x[i:i + ROWS_AT_ONCE])[:2] for i in range(0, len(x), ROWS_AT_ONCE)] or [(np.zeros(0, int), np.zeros(0, int))]
            c, d = (np.concatenate(z) for z in zip(*got))
            d = np.minimum(d, LONGEST).astype(np.int64)
            yield pa.StructArray.from_arrays([pa.array(c, pa.int32()), pa.array(d, pa.int64())], names=["cluster", "distance"])

    r = arrow_column(spark, near, "struct<cluster: int, distance: bigint>")(F.col("x"))
    return rows.select("id", r.alias("r")).select("id", "r.cluster", "r.distance")


def _digest(c: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest()


def _per_cluster(values: dict, kind: str, cluster: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in values.items() for v in kv])[cluster].cast(kind)


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id",
            vector_col: str = "embedding", dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """Per kept vector (see ``whole_numbers``): ``id_col``, cluster, distance (squared, of the
    integers), cluster_inertia, inertia, centroid_sha256 (of its centroid's components, comma
    joined).  Ties go to the smaller number; repeated and null ids stay, each its own row; other
    columns are ignored; without kept vectors there are no rows.  A squared distance or a sum of
    them that a long cannot hold is given as the largest long."""
    rows = write_table(whole_numbers(vectors, id_col, vector_col, dim, scale), "whole-vectors")
    centroids = fit(rows, k, rounds, seed)
    if not len(centroids):
        return rows.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), *[F.lit(0).cast("bigint").alias(c) for c in ("distance", "cluster_inertia", "inertia")],
                           F.lit("").alias("centroid_sha256"))
    out = write_table(assign(rows, centroids), "clusters")
    total = F.sum(F.col("distance").cast("decimal(20,0)"))
    own = {r.cluster: int(r.n) for r in out.groupBy("cluster").agg(total.alias("n")).collect()}  # one row a centroid
    return out.select(F.col("id").alias(id_col), "cluster", "distance", _per_cluster({c: min(n, LONGEST) for c, n in own.items()}, "bigint", F.col("cluster")).alias("cluster_inertia"),
                      F.lit(min(sum(own.values()), LONGEST)).cast("bigint").alias("inertia"),
                      _per_cluster({i: _digest(c) for i, c in enumerate(centroids)}, "string", F.col("cluster")).alias("centroid_sha256"))
