"""Approximate kNN: IVF probing every list is exact; LSH hits carry exact distances."""
import pytest
from pyspark.sql import functions as F

from proxima.operators import ann, knn
from proxima.plans import workloads as W

from conftest import SF_SMALL


def _rows(df):
    return sorted((r.query_id, r.rank, r.item_id, round(r.distance, 6)) for r in df.collect())


def test_ivf_full_probe_is_exact(spark):
    s, emb, idx = W._dense_setup(spark, SF_SMALL)
    q = knn.item_queries(emb, s)
    exact = knn.knn(q, idx, s, k=5, method="scan")
    cents = ann.fit_ivf(idx, s, nlist=6)
    full = knn.knn(q, idx, s, k=5, method="ivf", centroids=cents, nprobe=6)
    assert _rows(full) == _rows(exact)
    part = knn.knn(q, idx, s, k=5, method="ivf", centroids=cents, nprobe=1)
    r = ann.recall_at_k(part, exact).first()
    assert 0 < r.recall <= 1 and r.exact == exact.count()


def test_lsh_distances_are_exact_and_nobody_comes_back_short(spark):
    s, emb, idx = W._dense_setup(spark, SF_SMALL)
    q = knn.item_queries(emb, s)
    exact = knn.knn(q, idx, s, k=5, method="scan")
    for tables in (1, 12):
        lsh = ann.knn_lsh(q, idx, s, k=5, num_tables=tables, num_hashes=4)
        d0 = knn.knn(q, idx, s, k=500, method="scan").select("query_id", "item_id", F.col("distance").alias("d0"))
        j = lsh.join(d0, ["query_id", "item_id"])
        assert j.count() == lsh.count() == exact.count()
        assert j.agg(F.max(F.abs(F.col("distance") - F.col("d0")))).first()[0] == pytest.approx(0, abs=1e-6)
        assert lsh.groupBy("query_id").agg((F.max("rank") == F.count(F.lit(1))).alias("ok")).filter("not ok").count() == 0


def _short(hits, exact):
    n = lambda df: df.groupBy("query_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return n(exact).join(n(hits).withColumnRenamed("n", "m"), ["query_id", "label"], "left").filter("m is null or m < n").count()


def test_ivf_probes_as_many_lists_as_reach_the_recall(spark):
    s, emb, idx = W._dense_setup(spark, SF_SMALL)
    q = knn.item_queries(emb, s)
    exact = knn.knn(q, idx, s, k=5, method="scan")
    cents = ann.fit_ivf(idx, s)  # ~ sqrt(items) lists
    hits = knn.knn(q, idx, s, k=5, method="ivf", centroids=cents)
    assert ann.recall_at_k(hits, exact).first().recall >= 0.9
    few = knn.knn(q, idx, s, k=5, method="ivf", centroids=cents, nprobe=1)
    assert _short(hits, exact) == _short(few, exact) == 0
    assert all(v >= 0.9 for v in W.RECALL.values())
    assert all(r.recall_reached and r.all_have_k for r in W.ann_recall(spark, SF_SMALL).collect())


def test_measured_probes_stop_at_the_recall(spark):
    s, emb, idx = W._dense_setup(spark, SF_SMALL)
    q = knn.item_queries(emb, s)
    cents = ann.fit_ivf(idx, s, nlist=8)
    listed = ann.assign_lists(idx, s, cents)
    exact = knn.knn(q, idx, s, k=5, method="scan")
    n = ann.measured_probes(q, listed, s, cents, 5, recall=0.5, sample=10**6, group=["query_id", "strategy_id", "label"])
    part = lambda p: ann.recall_at_k(knn.knn(q, idx, s, k=5, method="ivf", centroids=cents, nprobe=p), exact).first().recall
    assert 1 < n < 8 and part(n) >= 0.5
    assert ann.measured_probes(q, listed, s, cents, 5, recall=1.0, group=["query_id", "strategy_id", "label"]) >= n


def test_lsh_honours_the_arguments_of_a_search(spark):
    """With all buckets one (a very wide cell) the answer is the exact search's."""
    from test_knn import _mixed, _same
    s, df, idx = _mixed(spark, "l2", n=200)
    q = knn.item_queries(df.limit(30), s)
    wide = {"bucket_length": 1e9, "num_tables": 1, "num_hashes": 1}
    for kw in ({"strategy_id": "x"}, {"strategies": ["0", "x"]}, {"exclude_self": True}, {"l2_root": True}, {"explain": True}, {"k_scope": "total"}, {"weights": {"n": 0.0}},
               {"metric": "cosine"}, {"restrict_partition": False}):
        a = knn.knn(q, idx, s, k=3, method="lsh", lsh=wide, tie_decimals=9, **kw)
        b = knn.knn(q, idx, s, k=3, method="scan", tie_decimals=9, **kw)
        assert a.columns == b.columns and _same(a, b, extra=["strategy_id"] if "strategies" in kw else ())
    for kw in ({"metric": "ip"}, {"strategy_id": "u"}):
        with pytest.raises(ValueError):
            knn.knn(q, idx, s, k=3, method="lsh", **kw)
