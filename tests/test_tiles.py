"""The search of items in tiles against brute force, where partitions have many tiles."""
import numpy as np
import pytest

from proxima.operators import ingest, knn, tiles
from proxima.schema import Schema


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_partitions_of_many_tiles_equal_brute_force(spark, monkeypatch, metric):
    monkeypatch.setattr(tiles, "TILE", 100)
    monkeypatch.setattr(tiles, "HITS", 200)
    rng = np.random.default_rng(3)
    rows = [(str(i), f"v{i % 4}", float(rng.integers(0, 400)) / 4 + 1) for i in range(900)]
    df = spark.createDataFrame(rows, "id string, c string, n double")
    s = Schema.build([{"field": "c", "type": "onehot", "values": [f"v{i}" for i in range(4)], "weight": 2}, {"field": "n", "type": "numeric", "weight": 0.5}], [], metric)
    out = knn.knn(knn.item_queries(df.limit(30), s), ingest.build_index(df, s).index, s, k=4, tie_decimals=9, exclude_self=True)
    w = [s.factor(f) for f in ("c", "n")]
    vec = {i: np.r_[w[0] * (np.arange(4) == int(c[1])), w[1] * n] for i, c, n in rows}
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.distance))
    assert len(got) == 30
    for q, hits in got.items():
        far = lambda v: float(((vec[q] - v) ** 2).sum()) if metric == "l2" else 1 - float(vec[q] @ v) / (np.linalg.norm(vec[q]) * np.linalg.norm(v))
        want = sorted((np.rint(far(v) * 1e9 + 0.0123), i) for i, v in vec.items() if i != q)[:4]
        assert [i for _, i, _ in sorted(hits)] == [i for _, i in want]
        assert [d for _, _, d in sorted(hits)] == pytest.approx([far(vec[i]) for _, i in want], abs=1e-9)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_a_query_costs_a_bound_a_piece_however_many_items(metric, monkeypatch):
    """Items of few codes: every query is bounded against pieces of equal codes and the runs of the
    best of them, and finds what comparing everything finds."""
    import pyarrow as pa
    rng, n, nq = np.random.default_rng(4), 20_000, 40
    s = Schema.build([{"field": "c", "type": "onehot", "values": [f"v{i}" for i in range(20)], "weight": 2}, {"field": "n", "type": "numeric", "weight": 0.01}], [], metric)
    items = pa.table({"item_id": [str(i) for i in rng.permutation(n)], "__i0": pa.array(rng.integers(1, 21, n), pa.int32()), "__i1": 900 + rng.integers(0, 1000, n) / 10})
    codes = rng.integers(1, 21, nq)
    queries = pa.table({"query_id": [str(i) for i in range(nq)], "__s0": np.ones(nq), "__x1": 900 + rng.random(nq) * 100,
                        "__g0": pa.MapArray.from_arrays(pa.array(range(nq + 1), pa.int32()), pa.array(codes, pa.int32()), pa.array(np.ones(nq)))})
    sp = tiles.spec(s, 5, [None], None, metric, 9, False, False)
    run = tiles._kernel(sp, [], pa.schema([("query_id", pa.string()), ("strategy_id", pa.string()), ("item_id", pa.string()), ("distance", pa.float64()), ("r", pa.int32())]))
    made, bounds = [], tiles.bounds
    monkeypatch.setattr(tiles, "bounds", lambda *a: made.append(bounds(*a)) or made[-1])
    found = run(queries, items)
    assert sum(b.size for b in made) < nq * n / tiles.RUN / 2
    monkeypatch.setattr(tiles, "DENSE", -1)  # everything is compared
    assert found.select(["query_id", "item_id", "r"]).equals(run(queries, items).select(["query_id", "item_id", "r"]))


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("decimals", [None, 0])
def test_one_number_is_searched_along_its_order(monkeypatch, decimals, exclude_self):
    """No bounds where values lie apart; ties, equal values, both ends and far queries as when everything is compared."""
    import pyarrow as pa
    rng, n, k = np.random.default_rng(8), 3000, 3
    s = Schema.build([{"field": "n", "type": "numeric", "weight": 2}], [], "l2")
    value = np.r_[rng.integers(0, 400, n // 2) * 100.0, rng.random(n - n // 2) * 1e5 + 5e4]
    rank = rng.permutation(n)
    x = np.r_[value[:200], rng.random(50) * 1e5, -1e6, 1e6, 150.0, 250.0]
    ids = [*(f"i{r:05}" for r in rank[:200]), *(f"q{i}" for i in range(54))]
    items = pa.table({"item_id": [f"i{r:05}" for r in rank], "__i0": value})
    queries = pa.table({"query_id": ids, "__x0": x})
    sp = tiles.spec(s, k, [None], None, "l2", decimals, exclude_self, False)
    run = tiles._kernel(sp, [], pa.schema([("query_id", pa.string()), ("strategy_id", pa.string()), ("item_id", pa.string()), ("distance", pa.float64()), ("r", pa.int32())]))
    got = {}
    for r in run(queries, items).to_pylist():
        got.setdefault(r["query_id"], []).append((r["r"], r["item_id"], r["distance"]))
    assert len(got) == len(x)
    for qid, v in zip(ids, x):
        d = s.factor("n") ** 2 * ((v - value) * (v - value))
        key = d if decimals is None else np.rint(d + tiles.GRID_OFFSET)
        order = [j for j in np.lexsort((rank, key)) if not (exclude_self and f"i{rank[j]:05}" == qid)][:k]
        assert [(r, i) for r, i, _ in sorted(got[qid])] == [(p + 1, f"i{rank[j]:05}") for p, j in enumerate(order)]
        assert [f for _, _, f in sorted(got[qid])] == [d[j] for j in order]
    monkeypatch.setattr(tiles, "bounds", None)
    apart = items.slice(n // 2)
    assert run(queries.slice(200), apart).num_rows == k * 54


def test_one_number_in_many_tiles(spark, monkeypatch):
    """Both passes, with equal values and ends of tiles."""
    monkeypatch.setattr(tiles, "TILE", 10)
    rng = np.random.default_rng(9)
    value = np.r_[rng.integers(0, 300, 500) * 10.0, rng.random(400) * 3000]
    df = spark.createDataFrame([(f"i{i:04}", float(v)) for i, v in enumerate(value)], "id string, n double")
    s = Schema.build([{"field": "n", "type": "numeric", "weight": 1}], [], "l2")
    got = {}
    for r in knn.knn(knn.item_queries(df, s), ingest.build_index(df, s).index, s, k=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id, r.distance))
    assert len(got) == len(value)
    for i, v in enumerate(value):
        d = (v - value) ** 2
        order = np.lexsort((np.arange(len(value)), d))[:3]
        assert sorted(got[f"i{i:04}"]) == [(p + 1, f"i{j:04}", d[j]) for p, j in enumerate(order)]
