"""Graph search: recall against the exact search, bounded degree, every argument of a search."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from proxima.operators import ann, graph, ingest, knn
from proxima.schema import Schema
from proxima.session import write_table


def _clusters(spark, n=400, dim=8, seed=3):
    """Vectors in a few tight clusters far apart, with some equal ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) + 50.0 * rng.integers(0, 4, size=(n, 1))
    x[:20] = x[0]
    rows = [(i, i % 2, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "id long, part long, vec array<double>")


def _schema(metric="l2", factory="Flat"):
    return Schema.build([{"field": "vec", "type": "embedding", "length": 8, "weight": 2}], [{"field": "part", "values": [0, 1]}], metric, "id", index_factory=factory)


def test_descent_finds_the_true_neighbours_within_partitions(spark):
    df, s = _clusters(spark), _schema()
    idx = ingest.build_index(df, s).index
    vec = write_table(graph.vectors(idx, s), "graph-test")
    edges, _ = graph.neighbours(vec, ["part"], m=10)
    x = {r["id"]: (r.part, 2 * np.array(r.vec)) for r in df.collect()}
    got, found, total = {}, 0, 0
    for r in edges.collect():
        assert r.a.part == r.b.part and r.a != r.b
        a, b = int(r.a.item_id), int(r.b.item_id)
        assert r["__d"] == pytest.approx(((x[a][1] - x[b][1]) ** 2).sum(), rel=1e-3, abs=0.05)
        got.setdefault(a, set()).add(b)
    for a, (p, v) in x.items():
        d = sorted((((v - w) ** 2).sum(), b) for b, (q, w) in x.items() if q == p and b != a)
        assert len(got[a]) == 10
        found += sum(((v - x[b][1]) ** 2).sum() <= d[9][0] + 1e-3 for b in got[a])
        total += 10
    assert found >= 0.9 * total


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_walks_reach_the_recall_under_every_metric(spark, metric):
    df, s = _clusters(spark), _schema(metric, "HNSW12")
    idx = ingest.build_index(df, s).index
    q = knn.item_queries(df.filter("id % 10 = 0"), s)
    exact = knn.knn(q, idx, s, k=5, method="scan", tie_decimals=6).cache()
    hits = knn.knn(q, idx, s, k=5, tie_decimals=6).cache()  # the schema names the engine
    assert ann.recall_at_k(hits, exact).first().recall >= 0.9
    assert hits.count() == exact.count() and hits.columns == exact.columns
    both = hits.join(exact.select("query_id", "item_id", F.col("distance").alias("d")), ["query_id", "item_id"])
    assert both.filter(F.abs(F.col("d") - F.col("distance")) > 1e-6).count() == 0


def test_degree_is_bounded_and_engine_names(spark):
    df, s = _clusters(spark), _schema()
    idx = ingest.build_index(df, s).index
    g = graph.build_graph(idx, s, m=4, restrict_partition=False)
    assert g.links.agg(F.max(F.size("links"))).first()[0] <= 2 * 4 + graph.DEALS * graph.LINKS
    assert g.links.count() == 400 and g.entries.select(F.size("links")).first()[0] == graph.ENTRIES
    assert knn.engine(_schema(factory="HNSW")) == ("graph", None) and knn.degree(_schema(factory="HNSW24"), 16) == 24
    with pytest.raises(ValueError):
        knn.engine(_schema(factory="HNSWx"))


def test_wide_walks_are_the_exact_search(spark):
    """A walk that may hold all items finds what the scan finds, whatever is asked; an empty
    index has no hits."""
    df = _clusters(spark, n=60)
    s = Schema.build([{"field": "vec", "type": "embedding", "length": 8, "weight": 2}], [{"field": "part", "values": [0, 1]}], "l2", "id")
    idx = ingest.build_index(df, s).index
    q = knn.item_queries(df.limit(10), s)
    rows = lambda d: sorted((r.query_id, r["rank"], r.item_id, round(r.distance, 6)) for r in d.collect())
    inside, across = (graph.build_graph(idx, s, m=6, restrict_partition=r) for r in (True, False))
    for kw in ({"exclude_self": True, "l2_root": True}, {"k_scope": "total", "explain": True}, {"restrict_partition": False}):
        g = inside if kw.get("restrict_partition", True) else across
        a = knn.knn(q, idx, s, k=4, method="graph", graph={"ef": 200, "graphs": [g]}, tie_decimals=9, **kw)
        b = knn.knn(q, idx, s, k=4, method="scan", tie_decimals=9, **kw)
        assert a.columns == b.columns and rows(a) == rows(b)
    assert knn.knn(q, idx.limit(0), s, k=4, method="graph", graph={"ef": 8}).count() == 0


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_walks_cross_the_tiles(spark, monkeypatch, metric):
    """Leaves of a few items: the lists of many tiles make one graph, and a walk that may hold
    all items finds them all, wherever it starts."""
    monkeypatch.setattr(graph, "LEAF", 24)
    monkeypatch.setattr(graph, "WALKED", 2)
    df, s = _clusters(spark, n=300), _schema(metric)
    idx = ingest.build_index(df, s).index
    vec = write_table(graph.vectors(idx, s, metric=metric), "graph-test")
    nodes = graph.numbered(vec, [], 6, 17)
    assert nodes.select(graph.NUMBER).distinct().count() == 300 == nodes.count()
    for j in range(graph.DEALS):
        sizes = [r["count"] for r in nodes.groupBy(f"__l{j}.leaf").count().collect()]
        assert len(sizes) > 6 and max(sizes) <= 3 * graph.LEAF
    g = graph.build_graph(idx, s, m=6, restrict_partition=False)
    q = write_table(knn.item_queries(df.filter("id % 20 = 0"), s, restrict_partition=False), "graph-test-queries")
    rows = lambda d: sorted((r.query_id, r["rank"], r.item_id, round(r.distance, 6)) for r in d.collect())
    a = knn.knn(q, idx, s, k=4, method="graph", graph={"ef": 300, "graphs": [g]}, tie_decimals=9, restrict_partition=False)
    assert rows(a) == rows(knn.knn(q, idx, s, k=4, method="scan", tie_decimals=9, restrict_partition=False))
    there = graph.placed(idx, s, g)
    assert there.select(graph.TILE).distinct().count() > 3
    asked = q.drop(*s.filter_fields).dropDuplicates(["query_id"])
    met = graph.walk(asked, there, s, g, 300, None, metric)
    assert met.distinct().count() == met.count() >= 0.99 * 300 * 15  # an item that no other lists can only be an entry
    assert graph.walk(asked, there, s, g, 12, None, metric).groupBy("query_id").count().filter("count <> 12").count() == 0
