"""Encoder values over one-row DataFrames.  The expected vectors are fixed values: the
documented golden results."""
import math

import numpy as np
import pytest

from proxima.operators import encode as E
from proxima.operators import ingest
from proxima.schema import Schema

from conftest import ENCODERS_3, FILTERS


def vec_of(spark, schema, row, ddl, strategy_id=None):
    df = spark.createDataFrame([row], ddl)
    out = E.encode(df, schema, strategy_id=strategy_id).collect()
    assert len(out) == 1
    return np.array(out[0]["vec"])


def test_onehot_numeric_weights(spark):
    s = Schema.build(ENCODERS_3, FILTERS, "l2")
    v = vec_of(spark, s, {"id": "3", "price": "low", "category": "dairy", "weight": 1.5, "country": "US"},
               "id string, price string, category string, weight double, country string")
    assert np.allclose(v, [0, 1, 0, 0, 0, 2, 0, 3])


def test_variant_reweights_without_reindex(spark, items):
    s = Schema.build(ENCODERS_3, FILTERS, "l2").with_variant(2, "variant", {"price": 0.5})
    idx = ingest.build_index(items, s).index
    base = {r.item_id: np.array(r.vec) for r in E.decode(idx, s).collect()}
    var = {r.item_id: np.array(r.vec) for r in E.decode(idx, s, strategy_id="2").collect()}
    assert np.allclose(base["3"], [0, 1, 0, 0, 0, 2, 0, 3])
    assert np.allclose(var["3"], [0, 0.5, 0, 0, 0, 2, 0, 3])
    # the base strategy is unchanged by adding a variant (D9)
    assert s.weights()["price"] == 1
    d = s.variant_description("2")
    assert d["id"] == "2" and d["name"] == "variant"
    assert [e["weight"] for e in d["encoders"]] == [0.5, 2, 2]


ORD = {"field": "average_rating", "values": [2, 4], "type": "ordinal", "window": [0.1, 1, 0.2],
       "weight": math.sqrt(3)}


@pytest.mark.parametrize("window,values,weight,x,expected", [
    ([0.1, 1, 0.2], [2, 4], math.sqrt(3), 3.72, [1, 0, 0]),
    ([1], [2, 4], math.sqrt(3), 3.72, [math.sqrt(3), 0, 0]),
    ([0.1, 1, 0.2], [2, 4], math.sqrt(3), 2, [0, 1, 0.2]),
    ([0.1, 1, 0.2], [2, 4], math.sqrt(3), 4, [0, 0.1, 1]),
    ([0.5, 0.1, 1, 0.2, 0.4], [1, 2, 3, 4, 5], math.sqrt(5), 1, [0, 1, 0.2, 0.4, 0, 0]),
    ([0.5, 0.1, 1, 0.2, 0.4], [1, 2, 3, 4, 5], math.sqrt(5), 3, [0, 0.5, 0.1, 1, 0.2, 0.4]),
])
def test_ordinal_windows(spark, window, values, weight, x, expected):
    enc = dict(ORD, window=window, values=values, weight=weight)
    s = Schema.build([enc], [{"field": "language_code", "values": ["en", "de", "fr"]}], "l2")
    v = vec_of(spark, s, {"id": "1", "language_code": "en", "average_rating": float(x)},
               "id string, language_code string, average_rating double")
    assert np.allclose(v, expected)


@pytest.mark.parametrize("window,expected", [([1], [0, math.sqrt(3), 0]), ([0.1, 1, 0.2], [0.1, 1, 0.2])])
def test_bin_ordinal(spark, window, expected):
    enc = {"field": "average_rating", "values": [2, 4], "type": "binordinal", "window": window,
           "weight": math.sqrt(3)}
    s = Schema.build([enc], [{"field": "language_code", "values": ["en", "de", "fr"]}], "l2")
    v = vec_of(spark, s, {"id": "1", "language_code": "en", "average_rating": 3.72},
               "id string, language_code string, average_rating double")
    assert np.allclose(v, expected)


def test_even_window_rejected():
    with pytest.raises(ValueError):
        Schema.build([dict(ORD, window=[1, 1])], [], "l2")


def test_embedding_lookup_and_missing(spark):
    eye = spark.createDataFrame([(k, [float(i == j) for j in range(5)]) for i, k in enumerate("abcde")],
                                "key string, vector array<double>")
    enc = {"field": "state", "type": "np", "weight": 1, "length": 5, "table": "unused"}
    s = Schema.build([enc], FILTERS, "cosine")
    df = spark.createDataFrame([("1", "US", "b"), ("2", "US", "i")], "id string, country string, state string")
    out = {r.item_id: r.vec for r in E.encode(df, s, tables={"state": eye}).collect()}
    assert np.allclose(out["1"], [0, 1, 0, 0, 0])
    assert np.allclose(out["2"], [0, 0, 0, 0, 0])


def test_onehot_unknown_slot_and_strict(spark):
    s = Schema.build([{"field": "c", "type": "onehot", "values": ["x", "y"]},
                      {"field": "d", "type": "soh", "values": ["x", "y"]}], [], "l2")
    v = vec_of(spark, s, {"id": "1", "c": "zz", "d": "zz"}, "id string, c string, d string")
    assert np.allclose(v, [1, 0, 0, 0, 0])


def test_bin_real_binning(spark):
    s = Schema.build([{"field": "x", "type": "bin", "values": [10, 20]}], [], "l2")
    for x, slot in [(5.0, 0), (10.0, 0), (15.0, 1), (25.0, 2)]:
        v = vec_of(spark, s, {"id": "1", "x": x}, "id string, x double")
        assert int(np.argmax(v)) == slot


def test_hierarchy_tree_distance(spark):
    tree = {"a": ["a1", "a2"], "b": ["b1"]}
    s = Schema.build([{"field": "h", "type": "hierarchy", "values": tree, "weight": 1}], [], "l2")
    v1 = vec_of(spark, s, {"id": "1", "h": "a1"}, "id string, h string")
    v2 = vec_of(spark, s, {"id": "2", "h": "a2"}, "id string, h string")
    v3 = vec_of(spark, s, {"id": "3", "h": "b1"}, "id string, h string")
    # same leaf is nearer than a sibling, which is nearer than another branch
    d12 = np.sum((v1 - v2) ** 2)
    d13 = np.sum((v1 - v3) ** 2)
    assert 0 < d12 < d13


def test_json_dense_and_sparse(spark):
    s = Schema.build([{"field": "j", "type": "json", "length": 3}], [], "l2")
    dense = vec_of(spark, s, {"id": "1", "j": "(1, 2, 3)"}, "id string, j string")
    sparse = vec_of(spark, s, {"id": "1", "j": '{"1": 5}'}, "id string, j string")
    assert np.allclose(dense, [1, 2, 3])
    assert np.allclose(sparse, [0, 5, 0])


def test_schema_json_roundtrip():
    s = Schema.build(ENCODERS_3, FILTERS, "l2").with_variant("v", "v", {"price": 0.5})
    assert Schema.from_json(s.to_json()) == s or Schema.from_json(s.to_json()).to_json() == s.to_json()


def test_unknown_encoder_and_metric():
    with pytest.raises(TypeError):
        Schema.build([{"field": "x", "type": "nope"}], [], "l2")
    with pytest.raises(TypeError):
        Schema.build(ENCODERS_3, FILTERS, "manhattan")
