"""Event-log and stored-vector tables (SRC-6/7, SNK-4/5, WIN-4/5, AGG-5/6, JN-11).

The reference keeps a per-user list of ``sep``-joined strings and a key -> vector store.
Here both are plain tables: ``events(user_id, ts, seq, <fields>)`` and
``vectors(key, vec, seq)``.  Every operator is a keyed aggregation, anti-join or
window; no per-user list is ever collected into one task.
"""

from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table


def trim_int(c: Column, kind: T.DataType) -> Column:
    """The string form of a field; a number without a fraction loses its ``.0``.  Text stays
    as it is (``007`` is not 7)."""
    if not isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
        return c.cast("string")
    d = c.cast("double")
    whole = (d == F.rint(d)) & (F.abs(d) < F.lit(9.0e15))
    return F.when(whole, d.cast("long").cast("string")).otherwise(c.cast("string"))


def export_events(events: DataFrame, fields: Sequence[str], sep: str = "|", user_col: str = "user_id",
                  order_cols: Sequence[str] = ("ts",)) -> DataFrame:
    """Structured events -> ``user_id, <order cols>, raw`` with ``raw`` the ``sep``-joined
    fields (import/export format only, D18)."""
    raw = F.concat_ws(sep, *[F.coalesce(trim_int(F.col(f), events.schema[f].dataType), F.lit("")) for f in fields])
    return events.select(F.col(user_col).alias("user_id"), *order_cols, raw.alias("raw"))


def import_events(raw: DataFrame, fields: Sequence[str], sep: str = "|", raw_col: str = "raw") -> DataFrame:
    """``raw`` strings -> one string column per field name (SRC-6); a line with fewer fields
    leaves the others null."""
    parts = F.split(F.col(raw_col), re.escape(sep), -1)
    return raw.select(*raw.columns, *[F.get(parts, i).alias(f) for i, f in enumerate(fields)])


def _with(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with one row per group; a null key is a group like any other."""
    named = groups.select(*[F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(keys)], *[F.col(f"`{c}`") for c in groups.columns if c not in keys])
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__g{i}")) for i, k in enumerate(keys)]
    return rows.join(named, on).drop(*[f"__g{i}" for i in range(len(keys))])


def ordered_events(events: DataFrame, user_col: str = "user_id", order_cols: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """AGG-6 in long form: every event with its 1-based position in the user's log (events
    without a user are one log of their own).

    A user is never sorted in one task: a range partitioning by (user, order) — Spark
    samples the keys, so a user with a third of the log is split over many tasks — is written
    once, each task's row count per user gives every (task, user) its offset from the
    earlier tasks, and the position is that offset + the row's number inside its task."""
    keys = [user_col, *order_cols]
    part = "__part"
    srt = events.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(part, F.spark_partition_id())
    pos = srt.withColumn("__loc", F.row_number().over(Window.partitionBy(part, user_col).orderBy(*order_cols)))
    # both branches below must see the same task assignment (range sampling is not
    # repeatable): write it once as a table in the shared checkpoint folder
    pos = write_table(pos, "event-positions")
    counts = pos.groupBy(part, user_col).agg(F.max("__loc").alias("__cnt"))
    prior = Window.partitionBy(user_col).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(part, user_col, F.coalesce(F.sum("__cnt").over(prior), F.lit(0)).alias("__off"))
    out = _with(pos, offsets, [part, user_col])
    return out.select(*events.columns, (F.col("__off") + F.col("__loc")).cast("int").alias("pos"))


def pop_oldest(events: DataFrame, user_col: str = "user_id", order_cols: Sequence[str] = ("ts", "event_id")
               ) -> tuple[DataFrame, DataFrame]:
    """WIN-4: (popped, remaining).  The oldest event per user is found with a map-side
    combined ``min`` over the ordering struct, not a per-user sort; of several events with
    that order exactly one is popped.  Events without a user are one log of their own; every
    event is in one of the two results."""
    order = F.struct(*[F.col(c) for c in order_cols])
    first = events.groupBy(user_col).agg(F.min(order).alias("__first"))
    marked = _with(events, first, [user_col]).withColumn("__is", order.eqNullSafe(F.col("__first")))
    oldest = marked.filter("__is").withColumn("__rn", F.row_number().over(
        Window.partitionBy(user_col).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in events.columns]))))
    popped = oldest.filter("__rn = 1").select(*events.columns)
    rest = marked.filter(~F.col("__is")).select(*events.columns)
    return popped, rest.unionByName(oldest.filter("__rn > 1").select(*events.columns))


def delete_users(events: DataFrame, users: DataFrame, user_col: str = "user_id") -> DataFrame:
    """JN-11: drop every event of the listed users; events without a user stay."""
    return events.join(users.select(user_col).distinct(), user_col, "left_anti")


def append_events(events: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-4 (batch): append keeps per-user order through ``ts``/``event_id``."""
    return events.unionByName(new, allowMissingColumns=True)


def distinct_keys(df: DataFrame, key_col: str, kind: str) -> DataFrame:
    """AGG-5: distinct keys of a table, tagged with their kind."""
    return df.select(F.lit(kind).alias("kind"), F.col(key_col).cast("string").alias("key")).distinct()


def upsert_vectors(vectors: DataFrame, new: DataFrame, key_col: str = "key", vec_col: str = "vec",
                   seq_col: str = "seq") -> DataFrame:
    """SNK-5 / WIN-5: last write wins per key.  ``max_by`` is a map-side-combined
    aggregate, so a key written very often is reduced before the shuffle."""
    both = vectors.select(key_col, vec_col, seq_col).unionByName(new.select(key_col, vec_col, seq_col))
    return both.groupBy(key_col).agg(F.max_by(vec_col, seq_col).alias(vec_col), F.max(seq_col).alias(seq_col))


def get_vectors(vectors: DataFrame, keys: DataFrame, key_col: str = "key") -> DataFrame:
    """SRC-7: stored vectors of the given keys (equi-join)."""
    return vectors.join(keys.select(key_col).distinct(), key_col, "left_semi")
