"""User profiles from histories (documented example) and event logs."""
import pytest
from pyspark.sql import functions as F

from proxima.operators import ingest, profiles
from proxima.plans import recommend as R
from proxima.schema import Schema

from conftest import ENCODERS_2, FILTERS


def _setup(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    return s, ingest.build_index(items, s).index


def test_history_repeats_counted(spark, items):
    s, idx = _setup(spark, items)
    users = spark.createDataFrame([("u", "US")], "user_id string, country string")
    hist = spark.createDataFrame([("u", "1"), ("u", "3"), ("u", "3")], "user_id string, item_id string")
    out = R.recommend(users, hist, idx, s, k=2).orderBy("rank").collect()
    assert [r.item_id for r in out] == ["3", "1"]
    assert [r.distance for r in out] == pytest.approx([8 / 9, 32 / 9])


def test_history_deduplicated(spark, items):
    s, idx = _setup(spark, items)
    users = spark.createDataFrame([("u", "US")], "user_id string, country string")
    hist = spark.createDataFrame([("u", "1"), ("u", "3"), ("u", "3")], "user_id string, item_id string")
    out = R.recommend(users, hist, idx, s, k=2, dedupe=True).orderBy("rank").collect()
    assert sorted(r.item_id for r in out) == ["1", "3"]
    assert [r.distance for r in out] == pytest.approx([2.0, 2.0])


def test_weighted_history_equals_repeats(spark, items):
    s, idx = _setup(spark, items)
    users = spark.createDataFrame([("u", "US")], "user_id string, country string")
    hist = spark.createDataFrame([("u", "1", 1.0), ("u", "3", 2.0)], "user_id string, item_id string, w double")
    out = R.recommend(users, hist, idx, s, k=2).orderBy("rank").collect()
    assert [r.distance for r in out] == pytest.approx([8 / 9, 32 / 9])


def test_event_weights(spark, items):
    s, idx = _setup(spark, items)
    users = spark.createDataFrame([("u", "US")], "user_id string, country string")
    ev = spark.createDataFrame([("u", "1", "view"), ("u", "3", "buy"), ("u", None, "buy")],
                               "user_id string, item_id string, event_type string")
    out = R.recommend_from_events(users, ev, idx, s, {"buy": 2.0}, k=2).orderBy("rank").collect()
    assert [r.distance for r in out] == pytest.approx([8 / 9, 32 / 9])


def test_cold_start_only(spark, items):
    s, idx = _setup(spark, items)
    users = spark.createDataFrame([("u", "US")], "user_id string, country string")
    hist = spark.createDataFrame([], "user_id string, item_id string")
    cold = spark.createDataFrame([("u", "mid", "meat")], "user_id string, price string, category string")
    out = R.recommend(users, hist, idx, s, k=1, cold_start=cold).collect()
    assert [r.item_id for r in out] == ["2"] and out[0].distance == pytest.approx(0.0)


def test_no_history_searches_zero_vector_unless_min_history(spark, items):
    s, idx = _setup(spark, items)
    users = spark.createDataFrame([("u", "US")], "user_id string, country string")
    hist = spark.createDataFrame([], "user_id string, item_id string")
    assert R.recommend(users, hist, idx, s, k=3).count() == 3
    assert R.recommend(users, hist, idx, s, k=3, min_history=1).count() == 0


def test_profile_reps_bounded_by_schema(spark, items):
    s, idx = _setup(spark, items)
    hist = spark.createDataFrame([("u", str(i % 3 + 1)) for i in range(300)], "user_id string, item_id string")
    p = profiles.profiles(hist, idx, s).collect()
    assert len(p) == 1 and p[0]["__n"] == 300


def test_cold_start_from_stored_vector(spark):
    """JN-10: a user's stored vector (looked up by key) is the cold-start pseudo-item."""
    s = Schema.build([{"field": "emb", "type": "embedding", "length": 2, "weight": 1}],
                     [{"field": "country", "values": ["US"]}], "l2")
    items = spark.createDataFrame([("a", "US", [0.0, 0.0]), ("b", "US", [1.0, 0.0]), ("c", "US", [5.0, 5.0])],
                                  "id string, country string, emb array<double>")
    idx = ingest.build_index(items, s).index
    vectors = spark.createDataFrame([("k1", [4.0, 4.0])], "key string, vec array<double>")
    users = spark.createDataFrame([("u", "US", "k1")], "user_id string, country string, key string")
    cold = users.join(vectors, "key", "left").select("user_id", F.col("vec").alias("emb"))
    hist = spark.createDataFrame([("u", "a")], "user_id string, item_id string")
    out = R.recommend(users.drop("key"), hist, idx, s, k=1, cold_start=cold).collect()
    # mean of a=(0,0) and the stored (4,4) is (2,2): nearest is b=(1,0) (dist 5) vs c (dist 18), a (dist 8)
    assert [r.item_id for r in out] == ["b"] and out[0].distance == pytest.approx(5.0)


def test_user_encoder_keeps_its_own_weight(spark):
    s = Schema.build([{"field": "c", "type": "onehot", "values": ["x", "y"], "weight": 1}], [], "l2",
                     user_encoders=[{"field": "c", "type": "onehot", "values": ["x", "y"], "weight": 5}])
    idx = ingest.build_index(spark.createDataFrame([("a", "x"), ("b", "y")], "id string, c string"), s).index
    users = spark.createDataFrame([("u", "x")], "user_id string, c string")
    hist = spark.createDataFrame([("u", "b")], "user_id string, item_id string")
    out = R.recommend(users, hist, idx, s, k=2).orderBy("rank").collect()
    assert [(r.item_id, r.distance) for r in out] == [("a", pytest.approx(16.0)), ("b", pytest.approx(26.0))]


def test_user_override_by_lookup(spark):
    vecs = spark.createDataFrame([("1", [0.0, 1.0]), ("2", [1.0, 0.0]), ("3", [9.0, 9.0]), ("3", [8.0, 8.0])], "key string, vector array<double>")
    enc = {"field": "e", "type": "embedding", "length": 2, "weight": 1, "table": "vecs"}
    s = Schema.build([enc], [], "l2", user_encoders=[enc])
    items = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "9")], "id string, e string")
    b = ingest.build_index(items, s, tables={"e": vecs})
    assert sorted(r.item_id for r in b.index.collect()) == ["a", "b", "d"]  # key 3 has two vectors
    users = spark.createDataFrame([("u", "2"), ("v", None)], "user_id string, e string")
    hist = spark.createDataFrame([("u", "a"), ("v", "a")], "user_id string, item_id string")
    out = {r.query_id: r.item_id for r in R.recommend(users, hist, b.index, s, k=1, tables={"e": vecs}).collect()}
    assert out == {"u": "b", "v": "a"}


def test_stored_vector_over_the_whole_space(spark):
    """Profiles with a stored vector equal the mean of the plain vectors, for every encoder."""
    import numpy as np

    from proxima.operators import encode as E
    from proxima.operators import knn
    s = Schema.build([
        {"field": "o", "type": "onehot", "values": ["x", "y"], "weight": 2}, {"field": "t", "type": "soh", "values": ["x", "y"], "weight": 1},
        {"field": "r", "type": "ordinal", "values": ["p", "q", "z"], "window": [0.5, 1, 0.5], "weight": 3}, {"field": "n", "type": "numeric", "weight": 0.5},
        {"field": "h", "type": "hierarchy", "values": {"m": ["h1", "h2"], "k": ["h3"]}, "weight": 1}, {"field": "v", "type": "json", "length": 2, "weight": 1}], [], "l2")
    rows = [("1", "x", "y", "p", 2.0, "h1", "[1,2]"), ("2", "y", "?", "q", -1.0, "h3", "[0,1]"), ("3", "?", "x", "?", 4.0, "h2", "[5,5]")]
    items = spark.createDataFrame(rows, "id string, o string, t string, r string, n double, h string, v string")
    idx = ingest.build_index(items, s).index
    vec = {r.item_id: np.array(r.vec) for r in E.decode(idx, s).collect()}
    stored = [0.5 * i - 2 for i in range(s.dim())]
    hist = spark.createDataFrame([("u", "1"), ("u", "2"), ("w", "3")], "user_id string, item_id string")
    vectors = spark.createDataFrame([("u", stored), ("k", stored), ("bad", [1.0])], "user_id string, vec array<double>")
    users = spark.createDataFrame([("u",), ("k",), ("w",), ("bad",)], "user_id string")
    out = R.recommend(users, hist, idx, s, k=3, cold_vectors=vectors, cold_start_weight=2.0)
    want = {"u": (vec["1"] + vec["2"] + 2 * np.array(stored)) / 4, "k": np.array(stored), "w": vec["3"], "bad": np.zeros(s.dim())}
    got = {(r.query_id, r.item_id): r.distance for r in out.collect()}
    assert len(got) == 12
    for (u, i), d in got.items():
        assert d == pytest.approx(float(((want[u] - vec[i]) ** 2).sum()), abs=1e-6)
    assert knn.QUERY_ID in out.columns


def test_rejected_users_are_listed(spark, items):
    s = Schema.build([{"field": "n", "type": "numeric", "weight": 1}], FILTERS, "l2", user_encoders=[{"field": "n", "type": "numeric", "weight": 1}])
    users = spark.createDataFrame([("a", "US", "1"), ("b", "XX", "1"), ("c", "EU", "one")], "user_id string, country string, n string")
    out = sorted((r.user_id, r.reason) for r in R.user_rejects(users, s).collect())
    assert out == [("b", "undeclared partition value for country"), ("c", "non-numeric value for n")]
    cold = spark.createDataFrame([("a", "1"), ("b", "NaN")], "user_id string, n string")
    assert [r.user_id for r in profiles.cold_start_rejects(cold, s).collect()] == ["b"]


def _as_rows(df):
    return {r.user_id: r.asDict(True) for r in df.collect()}


def _near(a, b):
    if isinstance(a, dict):
        return all(_near(a.get(k, 0.0), b.get(k, 0.0)) for k in {*a, *b})
    if isinstance(a, list):
        return len(a) == len(b) and all(_near(x, y) for x, y in zip(a, b))
    return a == b or abs(a - b) < 1e-9


def test_profiles_are_one_aggregation_that_explodes_nothing(spark, monkeypatch):
    """Sums side by side give the profiles that the long sums give, without a row for each feature."""
    s = Schema.build([{"field": "c", "type": "soh", "values": ["a", "b"], "weight": 2},
                      {"field": "b", "type": "binordinal", "values": [1, 2, 3], "window": [0.1, 1, 0.1], "weight": 1},
                      {"field": "n", "type": "numeric", "weight": 0.5}], [], "l2", "id")
    items = spark.createDataFrame([(str(i), "abz"[i % 3], i % 5, float(i)) for i in range(12)], "id string, c string, b int, n double")
    hist = spark.createDataFrame([(f"u{i % 4}" if i % 4 else None, str(i * 7 % 13), float(i % 3) - 0.5) for i in range(60)], "user_id string, item_id string, w double")
    idx = ingest.build_index(items, s).index
    out = profiles.profiles(hist, idx, s)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = _as_rows(out)
    monkeypatch.setattr(profiles, "MAX_SUMS", 0)
    want = _as_rows(profiles.profiles(hist, idx, s))
    assert len(got) == 4 and got.keys() == want.keys() and all(_near(got[u][c], want[u][c]) for u in want for c in want[u])


def test_stored_vectors_are_summed_with_the_history_at_once(spark, monkeypatch):
    s = Schema.build([{"field": "v", "type": "embedding", "length": 3, "weight": 2}, {"field": "n", "type": "numeric", "weight": 0.5}], [], "l2", "id")
    items = spark.createDataFrame([(str(i), [float(i), 1.0, -1.0], float(i)) for i in range(6)], "id string, v array<double>, n double")
    hist = spark.createDataFrame([("a", "1", 1.0), ("a", "2", 3.0), ("b", "5", 1.0), ("c", "9", 1.0)], "user_id string, item_id string, w double")
    own = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0]), ("d", [4.0, 3.0, 2.0, 1.0]), ("d", [1.0, 0.0, 0.0, 1.0]), ("b", [1.0])], "user_id string, vec array<double>")
    idx = ingest.build_index(items, s).index
    out = profiles.profiles_with_vectors(hist, idx, s, own, 2.0)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = _as_rows(out)
    monkeypatch.setattr(profiles, "MAX_SUMS", 0)
    want = _as_rows(profiles.profiles_with_vectors(hist, idx, s, own, 2.0))
    assert sorted(got) == ["a", "b", "d"] and got.keys() == want.keys() and all(_near(got[u][c], want[u][c]) for u in want for c in want[u])
