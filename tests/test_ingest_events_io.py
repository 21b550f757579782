"""Index loads (rejects, modes, stats), events, save/load."""
import os
import uuid

from pyspark.sql import functions as F

from proxima.operators import events as EV
from proxima.operators import ingest
from proxima.plans import recommend as R
from proxima.schema import Schema
from proxima.session import ensure_checkpoint_dir
from proxima.sources import model_io

from conftest import ENCODERS_2, FILTERS

# fixed values: the documented second load of the toy catalogue
MORE = [("id1", "low", "meat", "US"), ("id2", "mid", "meat", "EU"), ("id3", "low", "dairy", "US"),
        ("id4", "high", "meat", "EU"), ("id5", "low", "meat", "US"), ("id6", "mid", "meat", "EU")]
DDL = "id string, price string, category string, country string"


def _counts(idx, s):
    return {r.partition: r.element_count for r in ingest.partition_stats(idx, s).collect()}


def test_incremental_load_partition_counts(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    first = ingest.build_index(items, s)
    assert _counts(first.index, s) == {"US": 3, "EU": 1}
    second = ingest.build_index(spark.createDataFrame(MORE, DDL), s, existing=first.index)
    assert _counts(second.index, s) == {"US": 6, "EU": 4}
    assert second.added.count() == 6
    assert ingest.affected_partitions(second.added, s).first()[0] == 2


def test_rejects_and_duplicates(spark):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    df = spark.createDataFrame([("1", "low", "meat", "US"), ("2", "low", "meat", "XX"), ("1", "mid", "meat", "US"),
                                (None, "low", "meat", "US")], DDL)
    b = ingest.build_index(df, s)
    reasons = sorted(r.reason for r in b.rejects.collect())
    assert len(reasons) == 2 and any("partition" in r for r in reasons)
    assert [r.item_id for r in b.duplicates.collect()] == ["1"]
    assert b.index.count() == 2   # append keeps both copies of id 1 (D3)


def test_modes(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    base = ingest.build_index(items, s).index
    new = spark.createDataFrame([("1", "high", "dairy", "US"), ("9", "low", "meat", "EU")], DDL)
    skip = ingest.build_index(new, s, "skip_existing", base).index
    up = ingest.build_index(new, s, "upsert", base).index
    ow = ingest.build_index(new, s, "overwrite", base).index
    assert skip.count() == 5 and up.count() == 5 and ow.count() == 2
    code = lambda idx: idx.filter("item_id = '1'").select("codes.price").first()[0]
    assert code(skip) == 1 and code(up) == 3


def test_save_load_roundtrip_same_results(spark, items):
    s = Schema.build(ENCODERS_2, FILTERS, "l2").with_variant("v", "v", {"price": 0.5})
    idx = ingest.build_index(items, s).index
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    model_io.save_model(idx, s, path)
    idx2, s2 = model_io.load_model(spark, path)
    assert s2.to_json() == s.to_json()
    q = items
    a = R.similar_items(q, idx, s, k=3, explain=True, strategy_id="v").orderBy("query_id", "rank").collect()
    b = R.similar_items(q, idx2, s2, k=3, explain=True, strategy_id="v").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b]


def _events(spark):
    return spark.createDataFrame([("u1", 2, 1, "1", "view"), ("u1", 1, 2, "3", "buy"), ("u2", 5, 3, "2", "view")],
                                 "user_id string, ts long, event_id long, item_id string, event_type string")


def test_events_order_pop_delete(spark):
    ev = _events(spark)
    o = EV.ordered_events(ev).filter("user_id = 'u1'").orderBy("pos").collect()
    assert [r.item_id for r in o] == ["3", "1"]
    popped, rest = EV.pop_oldest(ev)
    assert sorted(r.event_id for r in popped.collect()) == [2, 3]
    assert [r.event_id for r in rest.collect()] == [1]
    gone = EV.delete_users(ev, spark.createDataFrame([("u1",)], "user_id string"))
    assert [r.user_id for r in gone.collect()] == ["u2"]


def test_events_export_import_roundtrip(spark):
    ev = _events(spark).withColumn("qty", F.lit(2.0))
    raw = EV.export_events(ev, ["item_id", "event_type", "qty"])
    back = EV.import_events(raw, ["item_id", "event_type", "qty"]).orderBy("ts").collect()
    assert back[0].raw == "3|buy|2" and back[0].qty == "2"


def test_vectors_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", [1.0], 1), ("b", [2.0], 1)], "key string, vec array<double>, seq long")
    new = spark.createDataFrame([("a", [9.0], 2), ("a", [8.0], 3)], "key string, vec array<double>, seq long")
    out = {r.key: r.vec for r in EV.upsert_vectors(old, new).collect()}
    assert out == {"a": [8.0], "b": [2.0]}


def test_ordered_events_hot_user_split_across_tasks(spark):
    # one user holds most of the log; positions must still be 1..n in (ts, event_id) order
    ev = spark.range(30000).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise((F.col("id") % 7).cast("string")).alias("user_id"),
        ((F.col("id") * 7919) % 30011).alias("ts"), F.col("id").alias("event_id"))
    out = EV.ordered_events(ev)
    hot = out.filter("user_id = 'hot'")
    rows = [(r.ts, r.event_id, r.pos) for r in hot.orderBy("pos").collect()]
    assert [p for _, _, p in rows] == list(range(1, len(rows) + 1))
    assert [(t, e) for t, e, _ in rows] == sorted((t, e) for t, e, _ in rows)
    per_user = out.groupBy("user_id").agg(F.max("pos").alias("m"), F.count(F.lit(1)).alias("n"))
    assert per_user.filter("m != n").count() == 0


def test_pop_takes_one_event_of_each_user(spark):
    ev = spark.createDataFrame([("u1", 1, 1), ("u1", 2, 2), ("u2", 1, 1), ("u2", 3, 1), ("u3", 5, 9), ("u3", 5, 9)], "user_id string, ts long, event_id long")
    popped, rest = EV.pop_oldest(ev)
    assert sorted(map(tuple, popped.collect())) == [("u1", 1, 1), ("u2", 1, 1), ("u3", 5, 9)]
    assert sorted(map(tuple, rest.collect())) == [("u1", 2, 2), ("u2", 3, 1), ("u3", 5, 9)]


def test_text_fields_are_not_trimmed_and_short_lines_pass(spark):
    ev = spark.createDataFrame([("u", 1, "007", 2.0), ("u", 2, "1e3", 2.5)], "user_id string, ts long, code string, qty double")
    raw = EV.export_events(ev, ["code", "qty"]).orderBy("ts").collect()
    assert [r.raw for r in raw] == ["007|2", "1e3|2.5"]
    back = EV.import_events(spark.createDataFrame([("a|b",), ("a",)], "raw string"), ["x", "y"]).collect()
    assert [(r.x, r.y) for r in back] == [("a", "b"), ("a", None)]


def test_filter_values_keep_their_type(spark):
    s = Schema.build(ENCODERS_2, [{"field": "country", "values": ["01", "1"]}], "l2")
    df = spark.createDataFrame([("a", "low", "meat", "01"), ("b", "low", "meat", "1")], DDL)
    path = os.path.join(ensure_checkpoint_dir(spark), f"model-{uuid.uuid4().hex}")
    model_io.save_model(ingest.build_index(df, s).index, s, path)
    model_io.save_model(ingest.build_index(df.filter("id = 'b'"), s).index, s.with_variant("v", "v", {}), path, mode="append")
    idx, s2 = model_io.load_model(spark, path)
    assert sorted((r.item_id, r.country) for r in idx.collect()) == [("a", "01"), ("b", "1"), ("b", "1")]
    assert len(s2.strategies) == 2


def test_upsert_keeps_the_row_with_the_largest_order(spark):
    s = Schema.build(ENCODERS_2, FILTERS, "l2")
    df = spark.createDataFrame([("1", "low", "meat", "US", 3), ("1", "mid", "meat", "EU", 9), ("1", "high", "meat", "US", 5), ("2", "low", "meat", "XX", 1)], DDL + ", v int")
    up = ingest.build_index(df, s, "upsert", order_col="v").index.collect()
    assert [(r.item_id, r.country, r.codes.price) for r in up] == [("1", "EU", 2)]
    first = ingest.build_index(df, s, "skip_existing", order_col="v").index.collect()
    assert [(r.item_id, r.country, r.codes.price) for r in first] == [("1", "US", 1)]


def test_json_files_with_lists_and_broken_lines(spark):
    from proxima.sources import files
    path = os.path.join(ensure_checkpoint_dir(spark), f"json-{uuid.uuid4().hex}")
    lines = ['{"id": "1", "price": "low", "category": "meat", "country": ["US", "EU"]}', '{"id": "2", "price": "mid", "category": "meat", "country": "US"}',
             '{"id": "3", "price": ', '{"id": "4", "price": "mid", "category": "meat", "country": "XX"}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    b = files.ingest_json(spark, path, Schema.build(ENCODERS_2, FILTERS, "l2"))
    assert sorted((r.item_id, r.country) for r in b.index.collect()) == [("1", "EU"), ("1", "US"), ("2", "US")]
    assert sorted(r.reason for r in b.rejects.collect()) == ["malformed record", "undeclared partition value for country"]


def test_clusters_need_a_shared_checkpoint_folder(spark, monkeypatch):
    from types import SimpleNamespace

    import pytest

    from proxima import session
    conf = SimpleNamespace(get=lambda *a: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(fake)


def test_events_without_a_user_are_kept(spark):
    from proxima.operators import events as EV
    ev = spark.createDataFrame([(None, 1, 1), (None, 2, 2), ("u", 3, 3), (None, 1, 4)], "user_id string, ts long, event_id long")
    assert sorted((r.user_id or "", r.pos, r.event_id) for r in EV.ordered_events(ev).collect()) == [("", 1, 1), ("", 2, 4), ("", 3, 2), ("u", 1, 3)]
    popped, rest = EV.pop_oldest(ev)
    assert sorted(r.event_id for r in popped.collect()) == [1, 3] and sorted(r.event_id for r in rest.collect()) == [2, 4]
    listed = spark.createDataFrame([(None,), ("u",)], "user_id string")
    assert EV.delete_users(ev, listed).count() == 3
