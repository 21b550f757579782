"""kNN join, explanation, metrics, multi-partition, blocked == scan."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxima.operators import cells, ingest, knn
from proxima.plans import recommend as R
from proxima.schema import Schema

from conftest import ENCODERS_2, FILTERS, SF_SMALL


def _rows(df, cols=("query_id", "rank", "item_id", "distance")):
    return [tuple(r[c] for c in cols) for r in df.orderBy("query_id", "rank").collect()]


def test_documented_item_query(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    idx = ingest.build_index(items, s).index
    q = spark.createDataFrame([("q", "low", "meat", "US")], "id string, price string, category string, country string")
    out = R.similar_items(q, idx, s, k=2, explain=True).orderBy("rank").collect()
    assert [r.item_id for r in out] == ["1", "2"]
    assert [r.distance for r in out] == pytest.approx([0.0, 2.0])
    assert [(r.x_price, r.x_category) for r in out] == [pytest.approx((0, 0)), pytest.approx((2, 0))]


def test_l2_root_is_sqrt(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    idx = ingest.build_index(items, s).index
    q = items.filter("id = '2'")
    sq = R.similar_items(q, idx, s, k=3).orderBy("rank").collect()
    rt = R.similar_items(q, idx, s, k=3, l2_root=True).orderBy("rank").collect()
    assert [r.item_id for r in sq] == [r.item_id for r in rt]
    assert [r.distance for r in rt] == pytest.approx([math.sqrt(r.distance) for r in sq])


def test_k_exceeds_partition_and_partition_pruning(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    idx = ingest.build_index(items, s).index
    q = items.filter("id = '4'")   # EU has one item
    out = R.similar_items(q, idx, s, k=10).collect()
    assert [r.item_id for r in out] == ["4"]


def test_multi_partition_query_keeps_k_per_partition(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    idx = ingest.build_index(items, s).index
    q = spark.createDataFrame([("q", "low", "meat", ["US", "EU"])],
                              "id string, price string, category string, country array<string>")
    out = R.similar_items(q, idx, s, k=1).collect()
    assert sorted((r.country, r.item_id) for r in out) == [("EU", "4"), ("US", "1")]
    tot = R.similar_items(q, idx, s, k=1, k_scope="total").collect()
    assert [r.item_id for r in tot] == ["1"]


def test_ip_ranks_by_similarity_descending(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "ip")
    idx = ingest.build_index(items, s).index
    q = items.filter("id = '1'")
    out = R.similar_items(q, idx, s, k=3).orderBy("rank").collect()
    assert out[0].item_id == "1"
    assert out[0].distance <= out[1].distance


def _part_setup(spark, metric="l2"):
    from proxima.plans import workloads as W
    s = W.part_schema(metric)
    parts = W.parts(spark, SF_SMALL)
    return s, parts, ingest.build_index(parts, s).index


def test_blocked_equals_scan(spark):
    s, parts, idx = _part_setup(spark)
    q = knn.item_queries(parts, s)
    a = knn.knn(q, idx, s, k=5, method="scan")
    b = knn.knn(q, idx, s, k=5, method="blocked")
    ra = [(r[0], r[1], r[2], round(r[3], 6)) for r in _rows(a)]
    rb = [(r[0], r[1], r[2], round(r[3], 6)) for r in _rows(b)]
    assert ra == rb and len(ra) > 0


def _same(a, b, places=6, extra=()):
    cols = ("query_id", "rank", "item_id", *extra)
    key = lambda r: tuple(str(r[c]) for c in cols) + (round(r.distance, places) + 0.0,)
    return sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


def _mixed(spark, metric, n=600, seed=1, filters=True):
    """Items of all kinds of features in clusters, so that cells can tell them apart."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 6, (12, 4))
    rows = []
    for i in range(n):
        c = int(rng.integers(12))
        rows.append((str(i), "ab"[i % 2], f"v{c % 5}", float(rng.integers(0, 40)) - 20, (centres[c] + rng.normal(0, 0.3, 4)).tolist(), f"w{i % 3}"))
    df = spark.createDataFrame(rows, "id string, p string, c string, n double, v array<double>, o string")
    s = Schema.build([{"field": "c", "type": "onehot", "values": [f"v{i}" for i in range(5)], "weight": 2}, {"field": "n", "type": "numeric", "weight": 0.3},
                      {"field": "v", "type": "embedding", "length": 4, "weight": 1}, {"field": "o", "type": "ordinal", "values": ["w0", "w1"], "window": [0.1, 1, 0.1], "weight": 1}],
                     [{"field": "p", "values": ["a", "b"]}] if filters else [], metric)
    s = s.with_variant("u", "without vectors", {"v": 0.0, "n": 1.0}).with_variant("x", "vectors only", {"c": 0.0, "n": 0.0, "o": 0.0})
    return s, df, ingest.build_index(df, s).index


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
@pytest.mark.parametrize("filters", [True, False])
def test_cells_equal_scan_for_every_metric_and_weight_set(spark, metric, filters):
    s, df, idx = _mixed(spark, metric, filters=filters)
    zero = spark.createDataFrame([("zero", "a", "v0", 0.0, [0.0] * 4, "w0")], df.schema)
    q = knn.item_queries(df.limit(80).unionByName(zero), s)
    for kw in ({"strategies": ["0", "u", "x"]}, {"exclude_self": True, "explain": True, "restrict_partition": False} if filters else {"strategy_id": "x", "k_scope": "total"}):
        a = knn.knn(q, idx, s, k=4, method="scan", tie_decimals=9, **kw)
        b = knn.knn(q, idx, s, k=4, method="blocked", tie_decimals=9, **kw)
        assert a.columns == b.columns and _same(a, b, extra=["strategy_id"] if "strategies" in kw else ())


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_cells_compare_few_pairs(spark, metric):
    """Dense vectors without any filter: the cells visited hold few of all query-item pairs."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 5, (30, 8))
    rows = [(str(i), (centres[i % 30] + rng.normal(0, 0.2, 8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    s = Schema.build([{"field": "v", "type": "embedding", "length": 8, "weight": 1}], [], metric)
    idx = ingest.build_index(df, s).index
    q = knn.one_per_id(knn.item_queries(df.limit(200), s), s)
    plan, _ = cells.plan(s, idx, 5, [None], metric=metric)
    items = cells.with_cells(idx, plan)
    seen = []

    def search(v):
        seen.append(v)
        pairs = knn.candidate_pairs(v.join(q, ["query_id"]), items, s, extra_keys=[cells.FINE])
        return knn._topk(knn._score(pairs, s, [None], None, metric, False, False, []), 5, ["query_id", "strategy_id"], None)

    table = cells.cell_table(items, plan)
    found = cells.visits(q, table, plan, 5, search, ["query_id"])
    pairs = sum(knn.candidate_pairs(v.join(q, ["query_id"]), items, s, extra_keys=[cells.FINE]).count() for v in (found, *seen))
    assert pairs < {"l2": 0.15, "ip": 0.5, "cosine": 0.15}[metric] * 200 * 3000
    assert _same(knn.knn(q, idx, s, k=5, method="blocked"), knn.knn(q, idx, s, k=5, method="scan"))


def test_searches_of_distinct_codes(spark):
    """2,000 items of 12 combinations: pairs are counted over combinations; ties at the end of
    the list and the query itself are resolved among the smallest ids."""
    s = Schema.build([{"field": "c", "type": "onehot", "values": ["x", "y", "z"], "weight": 1}, {"field": "n", "type": "numeric", "weight": 1}], [{"field": "p", "values": ["a", "b"]}], "l2")
    df = spark.range(2000).select(F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("p"),
                                  F.element_at(F.array(*map(F.lit, "xyz")), (F.col("id") % 3 + 1).cast("int")).alias("c"), (F.col("id") % 7 % 2).cast("double").alias("n"))
    idx = ingest.build_index(df, s).index
    assert cells.repeated_codes(s, idx, list(s.encoders)) and cells.distinct_codes(idx, s, 5).count() == 12
    rows = [(int(r.id), r.p, r.c, r.n) for r in df.collect()]
    for kw, skip in (({}, False), ({"exclude_self": True}, True)):
        for method in ("scan", "blocked"):
            got = knn.knn(knn.item_queries(df.filter("id < 30"), s), idx, s, k=7, method=method, **kw)
            want = []
            for q in rows[:30]:
                near = sorted((2.0 * (q[2] != i[2]) + (q[3] - i[3]) ** 2, str(i[0])) for i in rows if i[1] == q[1] and not (skip and i[0] == q[0]))[:7]
                want += [(str(q[0]), r + 1, i, d) for r, (d, i) in enumerate(near)]
            assert sorted(_rows(got)) == sorted(want)


def test_repeated_query_ids(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    idx = ingest.build_index(items, s).index
    one = items.filter("country = 'US'").limit(1)
    alone = _rows(R.similar_items(one, idx, s, k=4))
    assert _rows(R.similar_items(one.unionByName(one), idx, s, k=4)) == alone and len(alone) == 3
    other = items.filter("country = 'US'").withColumn("id", F.lit("same"))
    for kw in ({}, {"restrict_partition": False}):
        mixed = R.similar_items(one.withColumn("id", F.col("id").cast("string")).unionByName(other), idx, s, k=4, **kw)
        assert {r.query_id for r in mixed.collect()} == {alone[0][0]}
    bad = R.query_rejects(other, s).collect()
    assert [(r.query_id, r.reason) for r in bad] == [("same", knn.TORN_ID)] * other.count()
    none = R.similar_items(one.withColumn("id", F.lit(None).cast("string")), idx, s, k=4, method="blocked")
    assert [r[1:] for r in _rows(none)] == [r[1:] for r in alone] and none.first().query_id is None


def test_broadcast_and_split_key_paths_agree(spark):
    s, parts, idx = _part_setup(spark)
    q = knn.item_queries(parts.orderBy("p_partkey").limit(60), s)
    a = knn.knn(q, idx, s, k=4, method="scan", broadcast=True)
    b = knn.knn(q, idx, s, k=4, method="scan", broadcast=False, pairs_per_task=50)
    assert _rows(a) == _rows(b)


def test_a_hot_key_is_cut_by_its_pairs(spark):
    """90 % of the items in one partition with one code: no bucket gets more than its share
    of query-item pairs."""
    from proxima.operators.encode import ITEM_ID
    s = Schema.build([{"field": "c", "type": "onehot", "values": ["x", "y"], "weight": 1}, {"field": "n", "type": "numeric", "weight": 1}],
                     [{"field": "p", "values": ["hot", "cold"]}], "l2")
    df = spark.range(1000).select(F.col("id").cast("string"), F.when(F.col("id") % 10 < 9, "hot").otherwise("cold").alias("p"),
                                  F.lit("x").alias("c"), (F.col("id") * 37 % 1000).cast("double").alias("n"))
    idx, q = ingest.build_index(df, s).index, knn.item_queries(df, s)
    pairs = knn._balanced(idx.withColumn("part", F.spark_partition_id()), q, ["p"], 20_000)
    assert pairs.count() == 900 * 900 + 100 * 100
    ni, nq = 900, 900
    salted = pairs.filter("p = 'hot'").select(F.pmod(F.xxhash64(ITEM_ID), F.lit(-(-ni * nq // 20_000))).alias("b")).groupBy("b").count()
    assert salted.agg(F.max("count")).first()[0] <= 3 * 20_000
    a = knn.knn(q, idx, s, k=3, method="scan")
    b = knn.knn(q, idx, s, k=3, method="blocked", broadcast=False, pairs_per_task=5000)
    assert _rows(a) == _rows(b)


def test_many_declared_partitions_do_not_turn_off_blocking(spark):
    from proxima.plans import workloads as W
    s = W.part_schema(filters=[{"field": "p_type", "values": W.P_TYPES + [f"T{i}" for i in range(1000)]}])
    idx = ingest.build_index(W.parts(spark, SF_SMALL.replace("0.001", "0.01")), s).index
    plan, per_part = cells.plan(s, idx, 5)
    assert plan is not None and per_part > 100


def test_ranking_is_by_the_exact_distance(spark):
    s = Schema.build([{"field": "n", "type": "numeric", "weight": 1}], [], "l2")
    for items in ([("a", 900000.0), ("b", 500000.0), ("c", 110000.0)], [("a", 9e-6), ("b", 5e-6), ("c", 0.0)]):
        idx = ingest.build_index(spark.createDataFrame(items, "id string, n double"), s).index
        q = knn.item_queries(spark.createDataFrame([("q", 0.0)], "id string, n double"), s)
        for method in ("scan", "blocked"):
            out = knn.knn(q, idx, s, k=2, method=method).orderBy("rank").collect()
            assert [r.item_id for r in out] == ["c", "b"]


def test_values_that_are_not_finite_are_rejected(spark):
    s = Schema.build([{"field": "n", "type": "numeric", "weight": 1}, {"field": "v", "type": "embedding", "length": 2, "weight": 1}], [], "l2")
    rows = [("1", 1.0, [1.0, 2.0]), ("2", float("nan"), [1.0, 2.0]), ("3", float("inf"), [1.0, 2.0]), ("4", 1.0, [None, 2.0]), ("5", 1.0, [float("nan"), 2.0]),
            ("6", 1.0, [1.0]), ("7", None, [1.0, 2.0]), ("8", 1.0, None)]
    b = ingest.build_index(spark.createDataFrame(rows, "id string, n double, v array<double>"), s)
    assert [r.item_id for r in b.index.collect()] == ["1"] and b.rejects.count() == 7


def test_query_rejects_and_listed_filters(spark):
    s = Schema.build([{"field": "n", "type": "numeric", "weight": 1}], [{"field": "p", "values": ["a", "b"]}], "l2")
    idx = ingest.build_index(spark.createDataFrame([("1", "a", 1.0), ("2", "b", 2.0)], "id string, p string, n double"), s).index
    q = spark.createDataFrame([("good", ["a", "b"], "1"), ("text", ["a"], "x"), ("far", ["z"], "1"), ("half", ["a", "z"], "1")], "id string, p array<string>, n string")
    hits = R.similar_items(q, idx, s, k=5)
    assert sorted((r.query_id, r.item_id) for r in hits.collect()) == [("good", "1"), ("good", "2"), ("half", "1")]
    bad = R.query_rejects(q, s).collect()
    assert sorted((r.query_id, r.reason) for r in bad) == [("far", "undeclared partition value for p"), ("half", "undeclared partition value for p"),
                                                           ("text", "non-numeric value for n")]
    once = R.similar_items(q.filter("id = 'good'"), idx, s, k=5, restrict_partition=False)
    assert sorted(r.item_id for r in once.collect()) == ["1", "2"]


def test_engine_choice(spark):
    s, parts, idx = _part_setup(spark)
    q = knn.item_queries(parts, s)
    with pytest.raises(ValueError):
        knn.knn(q, idx, s, method="no_such")
    assert knn.engine(Schema.build([], [], index_factory="IVF64,Flat")) == ("ivf", 64)
    assert knn.engine(Schema.build([], [])) == ("auto", None) and knn.engine(Schema.build([], [], index_factory="LSH"))[0] == "lsh"
    with pytest.raises(ValueError):
        knn.engine(Schema.build([], [], index_factory="Tree"))


def test_large_vocabularies_plan_fast(spark):
    import time
    values = [f"v{i}" for i in range(10_000)]
    s = Schema.build([{"field": "c", "type": "onehot", "values": values, "weight": 1}], [], "l2")
    df = spark.createDataFrame([(str(i), f"v{i}") for i in range(5)], "id string, c string")
    idx = ingest.build_index(df, s).index
    t = time.time()
    out = knn.knn(knn.item_queries(df, s), idx, s, k=2, method="scan")
    out._jdf.queryExecution().executedPlan()
    assert time.time() - t < 20  # was beyond a minute with a few hundred values
    assert sorted(r.distance for r in out.collect()) == [0.0] * 5 + [2.0] * 5


def test_explanation_sums_to_distance_and_self_is_zero(spark):
    s, parts, idx = _part_setup(spark)
    q = knn.item_queries(parts, s)
    out = knn.explanation_check(knn.knn(q, idx, s, k=3, explain=True), s)
    assert out.agg(F.max("explain_gap")).first()[0] < 1e-6
    first = out.filter("rank = 1").agg(F.max("distance")).first()[0]
    assert first == pytest.approx(0.0, abs=1e-9)
    ranks = out.groupBy("query_id").agg(F.max("rank").alias("m"), F.count(F.lit(1)).alias("n"))
    assert ranks.filter("m != n").count() == 0


def test_factored_distance_matches_vectors(spark):
    """Σ per-feature components equals the squared distance of the concatenated vectors."""
    from proxima.operators import encode as E
    s, parts, idx = _part_setup(spark)
    q = knn.item_queries(parts.limit(20), s)
    out = knn.knn(q, idx, s, k=3, method="scan").collect()
    vecs = {r.item_id: np.array(r.vec) for r in E.decode(idx, s).collect()}
    for r in out:
        assert r.distance == pytest.approx(float(np.sum((vecs[r.query_id] - vecs[r.item_id]) ** 2)), abs=1e-6)


def test_variants_side_by_side_match_single_runs(spark):
    from proxima.plans import workloads as W
    s = W.part_schema(strategies={"v": W.VARIANT_WEIGHTS})
    parts = W.parts(spark, SF_SMALL).limit(50)
    idx = ingest.build_index(W.parts(spark, SF_SMALL), s).index
    both = R.variants_side_by_side(parts, idx, s, ["0", "v"], k=3)
    one = R.similar_items(parts, idx, s, k=3, strategy_id="v", method="scan")
    a = [(r.query_id, r.rank, r.item_id) for r in both.filter("strategy_id = 'v'").orderBy("query_id", "rank").collect()]
    b = [(r.query_id, r.rank, r.item_id) for r in one.orderBy("query_id", "rank").collect()]
    assert a == b


def test_fetch_unknown_labels_vanish(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    idx = ingest.build_index(items, s).index
    labels = spark.createDataFrame([("1",), ("99",)], "item_id string")
    out = R.fetch_vectors(idx, labels, s).collect()
    assert [r.item_id for r in out] == ["1"]
