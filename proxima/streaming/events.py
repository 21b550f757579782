"""Event-log streams (STR-1, STR-2).

STR-1 is a plain append: ``readStream`` -> ``writeStream`` in append mode; per-user
order is kept by the ``ts``/``event_id`` columns, not by arrival.

STR-2 is a user's live event list that expires after ``ttl`` of inactivity, refreshed by
every new event.  With event time that is a gap-based session: a list is a run of a
user's events whose successive gaps are <= ``ttl``, and it expires after ``last event +
ttl``.  Spark's own ``session_window`` only runs in append mode, which would hide the open
lists, so the operator is an ``applyInPandasWithState`` with an event-time timeout.

Each task first reduces its events to runs (start, last, n) per user, so what is shuffled
and merged per user is a few intervals, not events.  The state is the list of runs that a
late event may still extend.  Runs merge as intervals, so neither the order of arrival
nor the cut into batches matters.

STR-3: a *delete* event ends the list that is open at its time (the list is ``deleted``, later
events start a new one); a *pop* event takes one event off it.  Lists then depend on the
events' order around the control event, so with control types the events are not reduced
beforehand; a control event that arrives in a later micro-batch than newer events of its
list cannot cut that list any more.
"""

from __future__ import annotations

import json
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship_package
from .runner import latest

DAY_S = 86400  # the reference's default event TTL (seconds)

LIST_SCHEMA = ("user_id string, list_start_us long, last_event_us long, expires_at_us long, n_events long, "
               "status string")
STATE_SCHEMA = "state string"
RUNS = "user_id string, start_us long, last_us long, n long, kind string, at timestamp"


def append_stream(events: DataFrame, path: str, partition_by=()):
    """STR-1: a ``DataStreamWriter`` appending the event stream to ``path`` as Parquet."""
    w = events.writeStream.format("parquet").outputMode("append").option("path", path)
    if partition_by:
        w = w.partitionBy(*partition_by)
    return w


def merge_runs(start, last, n, barriers, ttl_us: int):
    """Join intervals whose gap is at most ``ttl_us`` and that no barrier separates (a barrier
    ``d`` stands between ``x <= d < y``).  Returns sorted (start, last, n)."""
    order = np.argsort(start, kind="stable")
    start, last, n = start[order], last[order], n[order]
    if not len(start):
        return start, last, n
    reach = np.maximum.accumulate(last)
    apart = start[1:] - reach[:-1] > ttl_us
    apart |= np.searchsorted(barriers, reach[:-1], "left") < np.searchsorted(barriers, start[1:], "left")
    first = np.flatnonzero(np.r_[True, apart])
    return start[first], np.maximum.reduceat(last, first), np.add.reduceat(n, first)


def _partial_runs(ttl_us: int):
    """Per Arrow batch: the users' events as runs, all users at once."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if not len(pdf):
                continue
            users, uid = pd.factorize(pdf["user_id"], use_na_sentinel=False)
            start, last, n = (pdf[c].to_numpy(np.int64) for c in ("start_us", "last_us", "n"))
            order = np.lexsort((start, users))
            users, start, last, n = users[order], start[order], last[order], n[order]
            first = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
            # how far a user's earlier events reach: a running maximum that starts anew with each user
            reach = pd.Series(last).groupby(users, sort=False).cummax().to_numpy()
            apart = start[1:] - reach[:-1] > ttl_us
            apart[first[1:] - 1] = True
            first = np.flatnonzero(np.r_[True, apart])
            z = np.maximum.reduceat(last, first)
            yield pd.DataFrame({"user_id": np.asarray(uid, object)[users[first]], "start_us": start[first], "last_us": z, "n": np.add.reduceat(n, first),
                                "kind": "event", "at": pd.to_datetime(z, unit="us")})

    return run


def _lists_fn(ttl_us: int):
    def fn(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = json.loads(state.get[0]) if state.exists else {"runs": [], "delete": [], "pop": []}
        parts = {k: [np.array(old[k], np.int64)] for k in ("delete", "pop")}
        runs = [np.array(old["runs"], np.int64).reshape(-1, 3)]
        if not state.hasTimedOut:
            for pdf in chunks:
                kind = pdf["kind"].to_numpy()
                block = pdf[["start_us", "last_us", "n"]].to_numpy(np.int64)
                runs.append(block[kind == "event"])
                for k in parts:
                    parts[k].append(block[kind == k, 0])
        barriers, pops = (np.sort(np.concatenate(parts[k])) for k in ("delete", "pop"))
        all_runs = np.concatenate(runs)
        start, last, n = merge_runs(all_runs[:, 0], all_runs[:, 1], all_runs[:, 2], barriers, ttl_us)
        mark = state.getCurrentWatermarkMs() * 1000
        rows, keep = [], []
        for i in range(len(start)):
            s, z, c = int(start[i]), int(last[i]), int(n[i])
            cut = barriers[np.searchsorted(barriers, z, "left"):]
            ended = min(z + ttl_us, int(cut[0]) if len(cut) else z + ttl_us)  # a list lives until its expiry or deletion
            live = max(0, c - int(((pops >= s) & (pops <= ended)).sum()))
            gone = len(cut) and int(cut[0]) <= z + ttl_us
            past = (z + ttl_us) // 1000 * 1000 < mark
            status = "deleted" if gone else "expired" if past or i + 1 < len(start) else "open"
            rows.append((s, z, z + ttl_us, live, status))
            if not past:
                keep.append([s, z, c])
        for s, z, _ in old["runs"]:  # a list that a late event joined to an earlier one
            if s not in start:
                rows.append((s, z, z + ttl_us, 0, "merged"))
        if keep:
            oldest = min(s for s, _, _ in keep)
            young = {k: [int(x) for x in v if x >= oldest] for k, v in (("delete", barriers), ("pop", pops))}
            state.update((json.dumps({"runs": keep, **young}),))
            state.setTimeoutTimestamp(max(min(z for _, z, _ in keep) + ttl_us, mark + 1000) // 1000)
        elif state.exists:
            state.remove()
        df = pd.DataFrame(rows, columns=["list_start_us", "last_event_us", "expires_at_us", "n_events", "status"])
        df.insert(0, "user_id", key[0])
        yield df
    return fn


def live_lists(sink: DataFrame) -> DataFrame:
    """The newest row of every list in an ``event_lists`` sink, without lists that were
    joined to an earlier one."""
    return latest(sink, ["user_id", "list_start_us"]).filter("status <> 'merged'")


def event_lists(events: DataFrame, ttl_s: int = DAY_S, lateness: str = "1 hour", user_col: str = "user_id",
                ts_col: str = "ts", delete_types=(), pop_types=(), type_col: str = "event_type") -> DataFrame:
    """STR-2/3: ``user_id, list_start_us, last_event_us, expires_at_us, n_events, status``.

    Streaming input: the stateful operator (update output mode).  Each update re-emits the
    user's lists that may still change; ``live_lists`` reads the newest state from a sink.
    Status: ``open``, ``expired`` (a newer list began, or the watermark, max event time minus
    ``lateness``, passed its expiry), ``deleted``, or ``merged`` (it became part of an
    earlier list).  Control events (``delete_types``, ``pop_types``) are no events of a list.

    Batch input: the same lists from Spark's ``session_window`` aggregation (gap = ``ttl_s``),
    whose sessions are merged within each partition before the shuffle; a user's control
    events, which are few, are collected and joined to the user's events."""
    ts = F.col(ts_col).cast("timestamp")
    ttl_us = int(ttl_s) * 1_000_000
    kind = F.lit("event")
    for name, types in (("pop", pop_types), ("delete", delete_types)):
        if types:
            kind = F.when(F.col(type_col).isin(list(types)), name).otherwise(kind)
    ev = events.select(F.col(user_col).cast("string").alias("user_id"), ts.alias("at"), F.unix_micros(ts).alias("t"), kind.alias("kind"))
    if not events.isStreaming:
        return _batch_lists(ev, int(ttl_s), bool(delete_types or pop_types))
    ship_package(events.sparkSession)
    runs = ev.select("user_id", F.col("t").alias("start_us"), F.col("t").alias("last_us"), F.lit(1).cast("long").alias("n"), "kind", "at")
    if not (delete_types or pop_types):
        runs = runs.mapInPandas(_partial_runs(ttl_us), RUNS)
    return runs.withWatermark("at", lateness).groupBy("user_id").applyInPandasWithState(
        _lists_fn(ttl_us), LIST_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.EventTimeTimeout)


def _batch_lists(ev: DataFrame, ttl_s: int, controls: bool) -> DataFrame:
    sw = F.session_window("at", f"{ttl_s} seconds")
    own = [F.min("t").alias("s"), F.max("t").alias("z"), F.count(F.lit(1)).alias("n")]
    ttl = F.lit(ttl_s * 1_000_000)
    if not controls:
        g = ev.groupBy("user_id", sw).agg(*own)
        return g.select("user_id", F.col("s").alias("list_start_us"), F.col("z").alias("last_event_us"),
                        (F.col("z") + ttl).alias("expires_at_us"), F.col("n").alias("n_events"), F.lit("closed").alias("status"))
    few = ev.filter("kind <> 'event'").groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "delete", F.col("t")))).alias("d"),
        F.collect_list(F.when(F.col("kind") == "pop", F.col("t"))).alias("p"))
    empty = F.array().cast("array<bigint>")
    j = ev.filter("kind = 'event'").join(few, "user_id", "left").withColumns({"d": F.coalesce("d", empty), "p": F.coalesce("p", empty)})
    j = j.withColumn("epoch", F.size(F.filter("d", lambda d: d < F.col("t"))))
    g = j.groupBy("user_id", "epoch", sw).agg(*own, F.first("d").alias("d"), F.first("p").alias("p"))
    cut = F.get(F.filter("d", lambda d: d >= F.col("z")), 0)
    ended = F.least(F.col("z") + ttl, F.coalesce(cut, F.col("z") + ttl))
    g = g.withColumns({"cut": cut, "ended": ended})
    popped = F.size(F.filter("p", lambda p: (p >= F.col("s")) & (p <= F.col("ended"))))
    gone = F.coalesce(F.col("cut") <= F.col("z") + ttl, F.lit(False))
    return g.select("user_id", F.col("s").alias("list_start_us"), F.col("z").alias("last_event_us"), (F.col("z") + ttl).alias("expires_at_us"),
                    F.greatest(F.col("n") - popped, F.lit(0)).cast("long").alias("n_events"),
                    F.when(gone, "deleted").otherwise("closed").alias("status"))
