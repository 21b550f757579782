"""Streams: final state after consuming a replayed log equals the batch result."""
import datetime as dt

from pyspark.sql import functions as F

from proxima.plans import workloads as W
from proxima.streaming import events as SE

from conftest import SF_SMALL


def _canon(df):
    return sorted(tuple(r) for r in df.collect())


def test_event_lists_idle_expiry_batch(spark):
    t0 = dt.datetime(2024, 1, 1)
    h = lambda x: t0 + dt.timedelta(hours=x)
    ev = spark.createDataFrame([("u", h(0)), ("u", h(1)), ("u", h(25)), ("u", h(49.5)), ("v", h(3))],
                               "user_id string, ts timestamp")
    out = sorted((r.user_id, r.n_events) for r in SE.event_lists(ev, ttl_s=24 * 3600).collect())
    # a gap of exactly 24 h (1h -> 25h) keeps the list alive; 24.5 h (25h -> 49.5h) expires it
    assert out == [("u", 1), ("u", 3), ("v", 1)]


def test_stream_event_lists_match_batch(spark):
    streamed = W.stream_event_lists(spark, SF_SMALL)
    batch = SE.event_lists(W.table(spark, SF_SMALL, "events")).select(
        "user_id", "list_start_us", "last_event_us", "expires_at_us", "n_events")
    assert _canon(streamed) == _canon(batch)


def test_stream_events_is_whole_log(spark):
    assert _canon(W.stream_events(spark, SF_SMALL)) == _canon(W.events_ordered(spark, SF_SMALL))


def test_stream_recommend_equals_batch(spark):
    assert _canon(W.stream_recommend(spark, SF_SMALL)) == _canon(W.user_query_events(spark, SF_SMALL))


def test_stream_index_equals_batch(spark):
    s = W.part_schema()
    batch = W._codes_out(W.part_index(spark, SF_SMALL, s), s)
    assert _canon(W.stream_index(spark, SF_SMALL)) == _canon(batch)


def test_stream_recommend_with_compaction_equals_batch(spark, monkeypatch):
    from proxima.streaming import recommend as SR
    orig = SR.recommend_batch_fn
    monkeypatch.setattr(SR, "recommend_batch_fn", lambda *a, **kw: orig(*a, **{**kw, "compact_every": 2}))
    monkeypatch.setattr(W, "STREAM_CHUNKS", 5)
    assert _canon(W.stream_recommend(spark, SF_SMALL)) == _canon(W.user_query_events(spark, SF_SMALL))


def test_stream_event_lists_delete_control_event(spark):
    from proxima.session import scratch_path
    from proxima.streaming.runner import batch_sink, file_stream, run_available_now
    t0 = dt.datetime(2024, 1, 1)
    h = lambda x: t0 + dt.timedelta(hours=x)
    ev = spark.createDataFrame([("u", h(0), "view"), ("u", h(1), "view"), ("u", h(2), "delete"),
                                ("u", h(3), "click"), ("u", h(4), "view"), ("v", h(0), "view")],
                               "user_id string, ts timestamp, event_type string")
    src, sink = scratch_path(spark, "del-src"), scratch_path(spark, "del-sink")
    ev.coalesce(1).write.parquet(src)
    lists = SE.event_lists(file_stream(spark, src, ev), delete_types=["delete"])
    run_available_now(lists.writeStream.outputMode("update").foreachBatch(batch_sink(sink)),
                      scratch_path(spark, "del-ck"))
    out = sorted((r.user_id, r.n_events, r.status) for r in SE.live_lists(spark.read.parquet(sink)).collect())
    assert out == [("u", 2, "deleted"), ("u", 2, "open"), ("v", 1, "open")]
    batch = SE.event_lists(ev, delete_types=["delete"])
    assert sorted((r.user_id, r.n_events, r.status == "deleted") for r in batch.collect()) == [("u", 2, False), ("u", 2, True), ("v", 1, False)]


def test_runs_merge_whatever_the_order_and_the_cut():
    import numpy as np
    rng = np.random.default_rng(1)
    none = np.zeros(0, np.int64)
    for _ in range(50):
        t = rng.integers(0, 200, 30)
        one = np.ones(30, np.int64)
        whole = SE.merge_runs(t, t, one, none, 5)
        cut = rng.integers(1, 29)
        parts = [SE.merge_runs(x, x, one[:len(x)], none, 5) for x in (t[:cut], t[cut:])]
        again = SE.merge_runs(*[np.concatenate(c) for c in zip(*parts)], none, 5)
        assert all((a == b).all() for a, b in zip(whole, again))


def test_unsorted_and_control_streams_match_batch(spark):
    cols = W.LIST_COLS
    batch = SE.event_lists(W.table(spark, SF_SMALL, "events")).select(*cols)
    assert _canon(W.stream_event_lists_unsorted(spark, SF_SMALL)) == _canon(batch)
    control = SE.event_lists(W.table(spark, SF_SMALL, "events"), delete_types=["purchase"], pop_types=["error"])
    control = control.select(*cols, (F.col("status") == "deleted").alias("deleted"))
    assert _canon(W.stream_event_control(spark, SF_SMALL)) == _canon(control)


def test_runs_of_a_batch_are_found_for_all_users_at_once(monkeypatch):
    """As ``merge_runs`` finds them user by user, but without a call for each user."""
    import numpy as np
    import pandas as pd
    from proxima.streaming import events as SE
    rng = np.random.default_rng(5)
    start = rng.integers(0, 3000, 400)
    pdf = pd.DataFrame({"user_id": [None if u == 0 else str(u) for u in rng.integers(0, 40, 400)], "start_us": start, "last_us": start + rng.integers(0, 50, 400), "n": 1})
    want = set()
    for uid, g in pdf.groupby("user_id", dropna=False):
        for s, z, n in zip(*SE.merge_runs(*(g[c].to_numpy(np.int64) for c in ("start_us", "last_us", "n")), np.zeros(0, np.int64), 100)):
            want.add((uid if isinstance(uid, str) else None, int(s), int(z), int(n)))
    monkeypatch.setattr(SE, "merge_runs", None)
    got = pd.concat(SE._partial_runs(100)(iter([pdf, pdf.iloc[:0]])))
    assert {(u if isinstance(u, str) else None, int(s), int(z), int(n)) for u, s, z, n in got[["user_id", "start_us", "last_us", "n"]].itertuples(index=False)} == want


def _dealt_tables(spark, path, files, by=()):
    """The small tables with the events in so many files, each over the whole time."""
    ev = W.table(spark, SF_SMALL, "events")
    ev.repartition(files, *by).write.parquet(f"{path}/events.parquet")
    W.table(spark, SF_SMALL, "part").write.parquet(f"{path}/part.parquet")
    return str(path)


def test_a_chunk_is_one_batch_however_many_files_it_has(spark, monkeypatch, tmp_path):
    from proxima.streaming import recommend as SR
    orig, batches = SR.recommend_batch_fn, []

    def counted(*a, **kw):
        body = orig(*a, **kw)
        return lambda upd, batch_id: (batches.append(batch_id), body(upd, batch_id))[1]

    monkeypatch.setattr(SR, "recommend_batch_fn", counted)
    monkeypatch.setattr(W, "STREAM_CHUNKS", 2)
    sf = _dealt_tables(spark, tmp_path / "sf", 4)
    assert _canon(W.stream_recommend(spark, sf)) == _canon(W.user_query_events(spark, sf))
    assert batches == [0, 1]


def test_no_event_is_late_because_it_is_in_another_file(spark, tmp_path):
    sf = _dealt_tables(spark, tmp_path / "sf", 3, ["user_id"])
    batch = SE.event_lists(W.table(spark, sf, "events")).select(*W.LIST_COLS)
    assert _canon(W.stream_event_lists(spark, sf)) == _canon(batch)


def test_running_sums_are_a_row_a_user(spark):
    """One state row for each user, with the profiles of the long sums."""
    from proxima.operators import profiles as P
    s, long = W.part_schema(), ["user_id", "f", "c"]
    idx = W.coded_parts(spark, SF_SMALL, s)
    rows = P.weighted_rows(P.history_from_events(W.table(spark, SF_SMALL, "events"), W.EVENT_WEIGHTS, item_col=W._event_item()), idx, s)
    wide = P.running_sums(rows, s)
    assert P.sums_key(wide) == ["user_id"] and P.sums_key(P.profile_sums(rows, s)) == long
    read = lambda df: {r.user_id: r.asDict() for r in df.collect()}
    a, b = read(P.profiles_of_sums(wide, s)), read(P.profiles_of_sums(P.profile_sums(rows, s), s))
    assert a.keys() == b.keys() and len(a) > 10
    for u in a:
        for c, x in a[u].items():
            y = b[u][c]
            assert x == y or (all(abs(x.get(k, 0) - y.get(k, 0)) < 1e-9 for k in {*x, *y}) if isinstance(x, dict) else abs(x - y) < 1e-6), (u, c)
