"""Live lists as retractable sums: the deltas add up to a plain replay of every user's list."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from proxima.plans import workloads as W
from proxima.session import scratch_path
from proxima.streaming import live as SL
from proxima.streaming.runner import file_stream, run_available_now

T0 = 1_700_000_000_000_000
TTL = 100
SCHEMA = "user_id string, ts timestamp, event_id long, event_type string, item_id string"


def slow(rows, mark):
    """Replay each user's log in order of time."""
    out = Counter()
    for user in {r[0] for r in rows if r[0] is not None}:
        mine = sorted(((t, {"pop": 1, "delete": 2}.get(k, 0), i, item) for u, t, i, k, item in rows if u == user), key=lambda x: x[:3])
        live, last = [], None
        for t, kind, _, item in mine:
            if kind == 0 and last is not None and t - last > TTL * 1_000_000:
                live = []
            if kind == 0:
                live.append(item)
                last = t
            elif kind == 1:
                live = live[1:]
            else:
                live = []
        if last is not None and (last + TTL * 1_000_000) // 1000 * 1000 >= mark:
            out.update((user, item) for item in live)
    return {k: n for k, n in out.items() if n}


def deltas_of(spark, batches, lateness="1000 seconds", **kw):
    src, sink = scratch_path(spark, "live-src"), scratch_path(spark, "live-sink")
    for rows in batches:
        at = [(u, dt.datetime.fromtimestamp(t / 1e6, dt.timezone.utc), i, k, item) for u, t, i, k, item in rows]
        spark.createDataFrame(at, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = file_stream(spark, src, SCHEMA, max_files_per_trigger=1)
    out = SL.live_deltas(stream, {"view": 2.0, "buy": 3.0}, ttl_s=TTL, lateness=lateness, **kw)
    run_available_now(out.writeStream.format("parquet").outputMode("append").option("path", sink), scratch_path(spark, "live-ck"))
    return spark.read.schema(SL.DELTAS).parquet(sink)


def added_up(df):
    rows = df.groupBy("user_id", "item_id").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).filter("n <> 0 or w <> 0").collect()
    return {(r.user_id, r.item_id): r.n for r in rows}, {(r.user_id, r.item_id): r.w for r in rows}


def log(seed, users=6, n=240, controls=True):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rnd.choices(["view", "pop", "delete"], [12, 4, 1] if controls else [1, 0, 0])[0]
        rows.append((f"u{rnd.randrange(users)}", T0 + rnd.randrange(0, 2000) * 1_000_000, i, kind, rnd.choice("abcd") if kind == "view" else None))
    return rows


def mark_of(rows, late_s):
    return (max(r[1] for r in rows) // 1000 - late_s * 1000) * 1000


@pytest.mark.parametrize("order", ["time", "shuffled"])
def test_deltas_add_up_to_the_replayed_lists(spark, order):
    rows = log(1)
    if order == "time":
        rows.sort(key=lambda r: r[1])
        late = 30
    else:
        random.Random(2).shuffle(rows)  # control events arrive after the events they cut
        late = 5000
    batches = [rows[i::1][:0] or rows[k:k + 60] for i, k in enumerate(range(0, len(rows), 60))]
    got, weights = added_up(deltas_of(spark, batches, f"{late} seconds", delete_types=["delete"], pop_types=["pop"]))
    want = slow(rows, mark_of(rows, late))
    assert got == want and weights == {k: 2.0 * n for k, n in want.items()}


def test_a_hot_user_in_slots(spark):
    rows = [("hot", T0 + i * 1_000_000, i, "view", f"i{i % 7}") for i in range(400)] + [("hot", T0 + 390_500_000, 1000, "delete", None)]
    rows += [("cold", T0, 2000, "view", "x"), (None, T0, 2001, "view", "x"), ("nul", T0 + 399_000_000, 2002, "view", None)]
    rows.sort(key=lambda r: r[1])
    df = deltas_of(spark, [rows[k:k + 101] for k in range(0, len(rows), 101)], "20 seconds", delete_types=["delete"], slots=4)
    assert added_up(df)[0] == {("hot", f"i{i % 7}"): n for i, n in Counter(x % 7 for x in range(391, 400)).items()}
    with pytest.raises(ValueError):
        SL.live_deltas(spark.createDataFrame([], SCHEMA), pop_types=["pop"], slots=2)


def test_expiry_without_further_events_of_the_user(spark):
    rows = [[("a", T0, 1, "view", "x"), ("a", T0 + 1, 2, "view", "y")], [("b", T0 + 500_000_000, 3, "view", "z")], [("c", T0 + 900_000_000, 4, "view", "z")]]
    assert added_up(deltas_of(spark, rows, "1 second"))[0] == {("c", "z"): 1}


def test_recommendations_follow_the_live_lists(spark, monkeypatch):
    from proxima.streaming import recommend as SR
    orig = SR.recommend_batch_fn
    monkeypatch.setattr(SR, "recommend_batch_fn", lambda *a, **kw: orig(*a, **{**kw, "compact_every": 2}))
    live = W.stream_recommend_live(spark, "/root/testdata/sf0.001")
    everyone = W.user_query_events(spark, "/root/testdata/sf0.001").select("query_id").distinct().count()
    assert 0 < live.select("query_id").distinct().count() < everyone


def test_a_batch_is_dealt_for_all_users_at_once(monkeypatch):
    """The users' runs as ``merge_runs`` finds them, without a call for each user."""
    import numpy as np
    import pandas as pd
    from proxima.streaming import events as SE
    from proxima.streaming import live as SL
    rng = np.random.default_rng(6)
    t = rng.integers(0, 3000, 300)
    pdf = pd.DataFrame({"user_id": [str(u) for u in rng.integers(0, 30, 300)], "slot": 0, "kind": rng.choice([SL.EVENT, SL.EVENT, SL.POP, SL.DELETE], 300), "t": t, "z": t,
                        "seq": np.arange(300), "item": "x", "w": 1.0})
    want = set()
    for uid, g in pdf[pdf.kind == SL.EVENT].groupby("user_id"):
        at = g.t.to_numpy(np.int64)
        for s, z in zip(*SE.merge_runs(at, at, np.ones(len(at), np.int64), SL.NONE, 100)[:2]):
            want.add((uid, int(s), int(z)))
    monkeypatch.setattr(SL, "merge_runs", None)
    got = pd.concat(SL._dealt(100, 1)(iter([pdf, pdf.iloc[:0]])))
    assert set(got[got.kind == SL.RUN][["user_id", "t", "z"]].itertuples(index=False, name=None)) == want
    assert len(got) - len(want) == len(pdf)


def test_the_users_of_a_bucket_are_advanced_at_once():
    """One call for all users, batch after batch, gives what a replay of each user's log gives."""
    import numpy as np
    import pandas as pd
    rows = [r for r in log(7, users=40, n=1500)]
    random.Random(3).shuffle(rows)
    blob, live, mark = None, Counter(), 0
    for k in range(0, len(rows), 300):
        part = rows[k:k + 300]
        kinds = {"view": SL.EVENT, "pop": SL.POP, "delete": SL.DELETE}
        pdf = pd.DataFrame({"user_id": [r[0] for r in part], "slot": 0, "kind": [kinds[r[3]] for r in part], "t": [r[1] for r in part], "z": [r[1] for r in part],
                            "seq": [r[2] for r in part], "item": [r[4] for r in part], "w": 1.0})
        lists = SL.Lists.of(blob, list(SL._dealt(TTL * 1_000_000, 1)(iter([pdf]))))
        mark = mark_of(rows, 5000) if k + 300 >= len(rows) else 0
        entered, left, keep, merged, again = lists.advance(TTL * 1_000_000, mark)
        for mask, sign in ((entered, 1), (left, -1)):
            for at in np.flatnonzero(mask):
                live[(lists.names[lists.user[at]], lists.item[at])] += sign
        blob = lists.blob(keep, merged)
    assert {k: n for k, n in live.items() if n} == slow(rows, mark) and len(lists.names) == 40
    lists = SL.Lists.of(blob, [])
    entered, left, keep, merged, again = lists.advance(TTL * 1_000_000, max(r[1] for r in rows) + 10_000_000_000)
    assert not entered.any() and left.sum() == sum(slow(rows, mark).values()) and not keep.any() and again is None
