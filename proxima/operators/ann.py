"""Approximate kNN (Q-6, UDF-3): the reference picks an engine by name (exact flat
search, or a graph / hashing index); here ``method=`` selects among

* ``exact``  — ``knn.knn`` (scan or cells; the default ``Flat``),
* ``ivf``    — inverted lists: a coarse k-means quantizer over one vector feature
  (MLlib ``KMeans``, fitted distributedly on the index), every item in the list of its
  nearest centroid, every query probing its ``nprobe`` nearest lists.  Unless given,
  ``nprobe`` is the smallest number of lists that reaches the asked recall against the
  exact search (``measured_probes``).  The candidate join is keyed on
  ``(partition filters, list_id)``, so it is the same equi-join as the exact search, only
  over fewer pairs,
* ``lsh``    — bucketed random projections: ids meet on (filters, table, bucket).

Both only choose candidates: their distances are exact under the caller's strategies, weights
and metric, the result has the exact search's columns, and queries that meet fewer than k
items are searched exactly.

Only the centroid matrix (``nlist x dim`` doubles) travels to the executors, as a broadcast
variable; items and queries never pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encoders as X
from ..schema import Schema
from .encode import CODES, ITEM_ID
from ..session import ship_package
from .knn import QUERY_ID, STRATEGY_ID, _score, _topk, candidate_pairs, knn, rep_x

LIST_ID = "__blk"
RECALL = 0.9          # of the exact hits, that an approximate search finds at least
MEASURED_QUERIES = 200  # queries that nprobe is measured on


def vector_feature(schema: Schema, feature: str | None = None):
    if feature is not None:
        e = schema.encoder(feature)
        if not e.is_vector:
            raise ValueError(f"{feature} is not a vector feature")
        return e
    for e in schema.encoders:
        if e.is_vector:
            return e
    raise ValueError("approximate search needs a vector feature (embedding / json / feature_table)")


def fit_ivf(index: DataFrame, schema: Schema, nlist: int | None = None, feature: str | None = None,
            seed: int = 17, max_iter: int = 20) -> np.ndarray:
    """Coarse quantizer: ``nlist`` k-means centroids of the feature's item vectors.

    Default ``nlist`` ~ sqrt(items), so lists hold ~sqrt(items) items each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    e = vector_feature(schema, feature)
    if nlist is None:
        nlist = max(1, int(round(math.sqrt(index.count()))))
    vecs = index.select(array_to_vector(F.col(f"{CODES}.`{e.field}`").cast("array<double>")).alias("__v"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, featuresCol="__v", initMode="k-means||").fit(vecs)
    return np.array([c.tolist() for c in model.clusterCenters()], dtype=float)


def _nearest_lists(spark, vec, centroids: np.ndarray, n: int):
    """The ``n`` nearest centroids of a vector column, by numpy block products in an Arrow
    function; the centroid matrix is a broadcast variable."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(centroids, dtype=float))

    def near(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = shared.value
        norm = (c * c).sum(axis=1)
        for a in it:
            x = np.asarray(a.flatten(), dtype=float).reshape(len(a), c.shape[1])
            d = norm - 2.0 * (x @ c.T)  # plus |x|², the same for all centroids
            ids = np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, ids.shape[1]), pa.int32()), pa.array(ids.ravel()))

    return F.arrow_udf(near, "array<int>")(vec.cast("array<double>"))


def assign_lists(index: DataFrame, schema: Schema, centroids: np.ndarray, feature: str | None = None) -> DataFrame:
    """Index rows + ``__blk``: the id of the nearest centroid (0-based)."""
    e = vector_feature(schema, feature)
    near = _nearest_lists(index.sparkSession, F.col(f"{CODES}.`{e.field}`"), centroids, 1)
    return index.withColumn(LIST_ID, F.get(near, 0))


def probe_lists(queries: DataFrame, schema: Schema, centroids: np.ndarray, nprobe: int,
                feature: str | None = None) -> DataFrame:
    """Query rows, one per probed list (the ``nprobe`` nearest centroids)."""
    e = vector_feature(schema, feature)
    near = _nearest_lists(queries.sparkSession, F.col(rep_x(e.field)), centroids, min(int(nprobe), len(centroids)))
    return queries.withColumn(LIST_ID, F.explode(near))


def measured_probes(queries: DataFrame, listed: DataFrame, schema: Schema, centroids: np.ndarray, k: int, recall: float = RECALL,
                    sids=(None,), weights=None, metric: str = "l2", restrict_partition: bool = True, group=(QUERY_ID, STRATEGY_ID),
                    exclude_self: bool = False, tie_decimals: int | None = None, feature: str | None = None,
                    sample: int = MEASURED_QUERIES) -> int:
    """The smallest ``nprobe`` that finds ``recall`` of the exact search's hits.

    A hit of the exact search is found if its list is among those probed, so one exact search
    tells the recall of every ``nprobe``: by how far down the query's order of lists each hit
    stands.  It is measured on all queries if there are at most ``sample`` of them, else on
    that many (by id hash); there the recall less two standard errors has to reach
    ``recall``.  Every strategy must reach it.  ``listed`` are the items with their list."""
    e = vector_feature(schema, feature)
    picked = [r[0] for r in queries.select(QUERY_ID).distinct().orderBy(F.xxhash64(QUERY_ID), QUERY_ID).limit(sample + 1).collect()]
    nlist, whole = len(centroids), len(picked) <= sample
    q = queries.filter(F.col(QUERY_ID).isin(picked[:sample]))
    q = q.withColumn("__lists", _nearest_lists(q.sparkSession, F.col(rep_x(e.field)), centroids, nlist))
    pairs = candidate_pairs(q, listed, schema, restrict_partition).withColumn("__at", F.array_position("__lists", F.col(LIST_ID)))
    if exclude_self:
        pairs = pairs.filter(F.col(ITEM_ID) != F.col(QUERY_ID))
    top = _topk(_score(pairs, schema, sids, weights, metric, False, False, [*schema.filter_fields, "__at"]), k, group, tie_decimals)
    rows = top.groupBy(STRATEGY_ID, QUERY_ID, "__at").agg(F.count(F.lit(1)).alias("n")).collect()
    need = 1
    for sid in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == sid]
        row = {i: j for j, i in enumerate(dict.fromkeys(r[1] for r in mine))}
        found = np.zeros((len(row), nlist))
        for _, i, at, n in mine:
            found[row[i], at - 1] += n
        found = found.cumsum(axis=1)
        total = found[:, -1:]
        reached = found.sum(axis=0) / total.sum()
        if not whole:
            reached = reached - 2.0 * np.sqrt(((found - reached * total) ** 2).sum(axis=0)) / total.sum()
        need = max(need, int(np.argmax(reached >= recall - 1e-12)) + 1)  # all lists reach 1
    return need


def _lsh_keys(vec, length: int, tables: int, hashes: int, width: float, seed: int):
    """One (table, key) per hash table: the cells of ``hashes`` random projections."""
    rng = np.random.default_rng(seed)
    planes, shift = rng.normal(size=(tables, hashes, length)), rng.random((tables, hashes)) * width
    p, b = X.lit_json(planes.tolist(), "array<array<array<double>>>"), X.lit_json(shift.tolist(), "array<array<double>>")
    v = vec.cast("array<double>")

    def table(t):
        cells = F.zip_with(F.element_at(p, t + 1), F.element_at(b, t + 1), lambda r, s: F.floor((X.dot(r, v) + s) / F.lit(float(width))))
        return F.struct(t.alias("t"), F.xxhash64(cells).alias("h"))

    return F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), table)


BUCKET = ("__t", "__h")  # hash table, cell


def lsh_buckets(queries: DataFrame, index: DataFrame, schema: Schema, feature: str | None = None, metric: str = "l2",
                strategies=(None,), weights=None, bucket_length: float = 2.0, num_tables: int = 12, num_hashes: int = 2, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(queries, items), a row for each table, with the bucket of random projections of one
    vector feature (of its direction for cosine) that they fall into.

    They meet on (filters, bucket).  The feature must weigh something under every strategy; ip
    has no such buckets, as its nearest items need not lie near the query."""
    e = vector_feature(schema, feature)
    if metric == "ip":
        raise ValueError("lsh search ranks by l2 or cosine")
    if any(schema.weights(s, weights)[e.field] == 0 for s in strategies):
        raise ValueError(f"lsh search by {e.field}, which has no weight")

    def keyed(df, vec):
        if metric == "cosine":
            vec = vec.cast("array<double>")
            norm = F.sqrt(X.sqnorm(vec))
            vec = F.transform(vec, lambda x: F.when(norm > 0, x / norm).otherwise(x))
        keys = F.explode(_lsh_keys(vec, e.length, num_tables, num_hashes, bucket_length, seed))
        return df.select("*", keys.alias("__k")).select(*df.columns, F.col("__k.t").alias(BUCKET[0]), F.col("__k.h").alias(BUCKET[1]))

    return keyed(queries, F.col(rep_x(e.field))), keyed(index, F.col(f"{CODES}.`{e.field}`"))


def knn_lsh(queries: DataFrame, index: DataFrame, schema: Schema, k: int = 10, bucket_length: float = 2.0,
            num_tables: int = 12, num_hashes: int = 2, feature: str | None = None, seed: int = 17, **kw) -> DataFrame:
    """``knn.knn`` by the random projections of ``lsh_buckets``; takes its other arguments."""
    lsh = {"bucket_length": bucket_length, "num_tables": num_tables, "num_hashes": num_hashes, "seed": seed}
    return knn(queries, index, schema, k=k, method="lsh", ann_feature=feature, lsh=lsh, **kw)


def recall_at_k(approx: DataFrame, exact: DataFrame, keys=(QUERY_ID,)) -> DataFrame:
    """Share of the exact hits that the approximate search also returned (one row)."""
    k = list(keys)
    found = approx.select(*k, ITEM_ID).distinct().withColumn("__hit", F.lit(1))
    ex = exact.select(*k, ITEM_ID).join(found, k + [ITEM_ID], "left")
    out = ex.agg(F.count("__hit").alias("found"), F.count(F.lit(1)).alias("exact"))
    return out.withColumn("recall", F.col("found") / F.col("exact"))
