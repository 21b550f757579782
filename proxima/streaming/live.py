"""Profiles and recommendations that follow the live event list (STR-2 x STR-4, Q-3).

A user's *live list* at a point of event time: the events after the user's last delete that
belong to the run of events still open (successive gaps of at most the expiry, the last event
no longer ago than that), less the oldest ones that pop events took off.  A profile must lose
what the list loses, so the sums behind it are retractable:

1. ``live_deltas`` is the stateful part.  It emits a row with the item's weight when an event
   enters a live list and one with the negated weight when the event leaves it, be it by
   expiry, delete or pop, also when the event or the control event that causes it arrives late
   (within the watermark's delay).
2. The deltas are an append-only table, and the profile sums are a native streaming
   aggregation over it: ``running_sums`` of the signed weights.
3. ``recommend.recommend_batch_fn`` answers the users whose sums changed; who has no live
   event left has no answer.

Each task reduces its events to runs per user before the shuffle.  A user's events may be dealt
to several ``slots``: every slot gets all of the user's runs and delete events, which are few,
and holds its share of the events, so a user with a large part of the log is many state groups.
Pops need the order of a user's whole list and so one slot.  The users of a bucket are one state
group, advanced in one call (a call for each user would cost more than its rows): the state is
their runs, last deletes, and the events of the lists that can still change.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import profiles
from ..schema import Schema
from ..session import ship_package
from .events import DAY_S, _partial_runs, merge_runs  # noqa: F401 (one of the names of this module)

USER_ID = profiles.USER_ID
DELTAS = "user_id string, item_id string, w double, n long"
ROWS = "user_id string, slot int, kind int, t long, z long, seq long, item string, w double"
EVENT, POP, DELETE, RUN = range(4)  # at the same instant in this order
STATE = pa.schema([("user_id", pa.string()), ("kind", pa.int8()), ("t", pa.int64()), ("z", pa.int64()), ("seq", pa.int64()), ("item", pa.string()), ("w", pa.float64()), ("live", pa.bool_())])
NONE = np.zeros(0, np.int64)
BEFORE, NEVER = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BUCKETS = 1024  # groups of users, each with one state


def _dealt(ttl_us: int, slots: int):
    """Per Arrow batch: events to their slots, and the users' runs (found at once) and deletes to every slot."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            events = pdf[pdf.kind == EVENT]
            yield pdf[pdf.kind != DELETE]
            few = [pdf[pdf.kind == DELETE]]
            at = pd.DataFrame({"user_id": events.user_id, "start_us": events.t, "last_us": events.t, "n": 1})
            for runs in _partial_runs(ttl_us)(iter([at])):
                few.append(pd.DataFrame({"user_id": runs.user_id, "slot": 0, "kind": RUN, "t": runs.start_us, "z": runs.last_us, "seq": 0, "item": None, "w": 0.0}))
            few = pd.concat(few, ignore_index=True)
            for slot in range(slots):
                yield few.assign(slot=np.int32(slot))
    return run


class Lists:
    """The rows of one group (a bucket of users), by user and time: ``live`` marks the events that
    deltas have added.  All users are advanced at once."""

    def __init__(self, user, kind, t, z, seq, item, w, live):
        self.names, code = np.zeros(0, object), np.zeros(0, np.int64)
        if len(user):
            code, self.names = pd.factorize(user)
        order = np.lexsort((seq, kind, t, code))
        self.user, self.kind, self.t, self.z, self.seq, self.item, self.w, self.live = (x[order] for x in (code, kind, t, z, seq, item, w, live))

    @classmethod
    def of(cls, blob: bytes | None, chunks: list[pd.DataFrame]) -> "Lists":
        parts = []
        if blob:
            parts.append(pa.ipc.open_stream(blob).read_all().to_pandas())
        parts += [c[["user_id", "kind", "t", "z", "seq", "item", "w"]].assign(live=False) for c in chunks if len(c)]
        df = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({f.name: [] for f in STATE})
        kinds = {"user_id": object, "kind": np.int64, "t": np.int64, "z": np.int64, "seq": np.int64, "item": object, "w": float, "live": bool}
        return cls(*(df[c].to_numpy(k) for c, k in kinds.items()))

    def blob(self, keep: np.ndarray, merged) -> bytes:
        """The rows to keep and the merged runs (users, starts, ends)."""
        u, s, z = merged
        full = lambda x, kind=np.int64: np.full(len(u), x, kind)
        runs = (self.names[u], full(RUN), s, z, full(0), full(None, object), full(0.0, float), full(False, bool))
        own = (self.names[self.user], self.kind, self.t, self.z, self.seq, self.item, self.w, self.live)
        cols = [pa.array(np.concatenate([x[keep], r]), f.type, from_pandas=True) for x, r, f in zip(own, runs, STATE)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, STATE) as out:
            out.write_batch(pa.record_batch(cols, schema=STATE))
        return sink.getvalue().to_pybytes()

    def _runs(self, ttl_us: int):
        """(user, start, last) of the users' runs, by user and start."""
        runs = self.kind == RUN
        u, s, z = self.user[runs], self.t[runs], self.z[runs]
        if not len(u):
            return u, s, z
        reach = pd.Series(z).groupby(u, sort=False).cummax().to_numpy()
        first = np.flatnonzero(np.r_[True, (u[1:] != u[:-1]) | (s[1:] - reach[:-1] > ttl_us)])
        return u[first], s[first], np.maximum.reduceat(z, first)

    def _taken(self, among: np.ndarray) -> np.ndarray:
        """By user, how many events the pops among these rows take: a pop of an empty list takes none."""
        out, at = np.zeros(len(self.names), np.int64), np.flatnonzero(among)
        if not len(at):
            return out
        u, step = self.user[at], np.where(self.kind[at] == EVENT, 1, -1)
        first = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
        size = np.diff(np.r_[first, len(at)])
        total = np.cumsum(step)
        balance = total - np.repeat(total[first] - step[first], size)
        left = balance[first + size - 1] - np.minimum(0, np.minimum.reduceat(balance, first))
        out[u[first]] = np.add.reduceat(step == 1, first, dtype=np.int64) - left
        return out

    def _first(self, among: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first ``n`` (by user) of these rows."""
        at = np.flatnonzero(among)
        u = self.user[at]
        count = np.bincount(u, minlength=len(self.names))
        return at[np.arange(len(at)) - (np.cumsum(count) - count)[u] < n[u]]

    def advance(self, ttl_us: int, mark: int):
        """At watermark ``mark``: (entered, left) masks of events, the rows to keep, the runs to
        keep, and when the group has to look again (None: never)."""
        users, user, kind, t = len(self.names), self.user, self.kind, self.t
        ru, start, last = self._runs(ttl_us)
        cut = np.full(users, BEFORE)
        np.maximum.at(cut, user[kind == DELETE], t[kind == DELETE])
        after = t > cut[user]
        past = (last + ttl_us) // 1000 * 1000 < mark
        newest = np.flatnonzero(np.r_[ru[1:] != ru[:-1], True]) if len(ru) else ru
        since = np.full(users, NEVER)  # the start of a list that is open
        since[ru[newest]] = np.where(past[newest], NEVER, start[newest])
        event, listed = kind == EVENT, (kind <= POP) & after
        inside = listed & (t >= since[user])
        now = inside & event
        now[self._first(now, self._taken(inside))] = False
        entered, left = event & now & ~self.live, event & ~now & self.live
        self.live = now
        # what can still change: the lists that are not past, and what is after the last delete
        first, kept = np.full(users, NEVER), np.bincount(ru[~past], minlength=users)
        np.minimum.at(first, ru[~past], start[~past])
        keep = listed & (t >= first[user])
        settled = inside & (t < mark) & (kept == 1)[user]  # pops before the watermark are settled
        keep[self._first(settled & event, self._taken(settled))] = False
        keep &= ~(settled & (kind == POP))
        keep |= (kind == POP) & after & (t >= mark) & (kept == 0)[user]
        held = (cut > BEFORE) & ((kept > 0) | (cut >= mark))
        keep[self._first((kind == DELETE) & (t == cut[user]), held.astype(np.int64))] = True
        ends = np.r_[last[~past] + ttl_us, t[keep & ~event]]
        return entered, left, keep, (ru[~past], start[~past], last[~past]), int(ends.min()) if len(ends) else None


def _delta_fn(ttl_us: int):
    def fn(key, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = [] if state.hasTimedOut else list(chunks)
        rows = Lists.of(state.get[0] if state.exists else None, new)
        mark = max(0, state.getCurrentWatermarkMs()) * 1000
        entered, left, keep, merged, again = rows.advance(ttl_us, mark)
        if again is None:
            if state.exists:
                state.remove()
        else:
            state.update((rows.blob(keep, merged),))
            state.setTimeoutTimestamp(max(again, mark + 1000) // 1000)
        either = entered | left
        sign = np.where(entered[either], 1, -1)
        out = pd.DataFrame({"user_id": rows.names[rows.user[either]], "item_id": rows.item[either], "w": rows.w[either] * sign, "n": sign})
        out = out.groupby(["user_id", "item_id"], sort=False, as_index=False).sum()
        yield out[(out.n != 0) | (out.w != 0)]
    return fn


def live_deltas(events: DataFrame, event_weights=None, ttl_s: int = DAY_S, lateness: str = "1 hour", user_col: str = "user_id", ts_col: str = "ts",
                seq_col: str = "event_id", item_col="item_id", type_col: str = "event_type", delete_types=(), pop_types=(), slots: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Streaming ``user_id, item_id, w, n``: the signed weights (and numbers) of the events that
    entered or left the users' live lists (write in append mode).

    Control events (``delete_types``, ``pop_types``) enter no list; a delete ends the list up to
    and including its own instant; a pop takes the oldest event of a list that has one.  Events
    without a user, time or item are in no list.  Events of the same instant are ordered by
    ``seq_col`` (a number), before a pop and a pop before a delete.  The users are dealt to
    ``buckets`` groups, whose number stays with a checkpoint as that of the slots does."""
    if pop_types and slots > 1:
        raise ValueError("pop events take the oldest event of a whole list: slots must be 1")
    ship_package(events.sparkSession)
    ttl_us = int(ttl_s) * 1_000_000
    ts, name = F.col(ts_col).cast("timestamp"), F.col(type_col)
    kind = F.lit(EVENT)
    for code, types in ((POP, pop_types), (DELETE, delete_types)):
        if types:
            kind = F.when(name.isin(list(types)), code).otherwise(kind)
    weights = F.create_map(*[x for k, v in (event_weights or {"": 1.0}).items() for x in (F.lit(k), F.lit(float(v)))])
    item = (F.col(item_col) if isinstance(item_col, str) else item_col).cast("string")
    seq = F.coalesce(F.col(seq_col).cast("long"), F.lit(0).cast("long"))
    rows = events.select(F.col(user_col).cast("string").alias("user_id"), F.pmod(F.xxhash64(seq_col, ts_col), F.lit(slots)).cast("int").alias("slot"),
                         kind.alias("kind"), F.unix_micros(ts).alias("t"), F.unix_micros(ts).alias("z"), seq.alias("seq"), item.alias("item"),
                         F.coalesce(F.element_at(weights, name), F.lit(1.0)).alias("w"))
    rows = rows.filter(F.col("user_id").isNotNull() & F.col("t").isNotNull() & (F.col("item").isNotNull() | (F.col("kind") != EVENT)))
    return (rows.mapInPandas(_dealt(ttl_us, slots), ROWS).withColumn("at", F.timestamp_micros("z")).withWatermark("at", lateness)
            .withColumn("bucket", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")).groupBy("bucket", "slot")
            .applyInPandasWithState(_delta_fn(ttl_us), DELTAS, "rows binary", "append", GroupStateTimeout.EventTimeTimeout))


def live_profile_sums(deltas: DataFrame, index: DataFrame, schema: Schema) -> DataFrame:
    """Streaming (or batch) profile sums of a table of deltas (update mode): additive in the
    signed weights, so an event that left a list leaves no trace."""
    return profiles.running_sums(profiles.weighted_rows(deltas.select(USER_ID, "item_id", "w"), index, schema), schema)
