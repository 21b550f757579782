"""Live user profiles and recommendations from an event stream (STR-4, STR-5), and
incremental indexing of an item stream (STR-6).

STR-4: events -> stream-static join with the indexed codes -> ``running_sums`` as a
native streaming aggregation in update mode: ``groupBy(user)`` with the sums of all codes side
by side, or ``groupBy(user, feature, code).sum`` for larger schemas.  The
state store holds the running sums (bounded by users x schema, not by events), and the
aggregation is partial before the shuffle, so a hot user is pre-aggregated per task.

STR-5: ``foreachBatch`` on that aggregation.  Each micro-batch writes the updated sums
to ``sums/batch_id=N``, reads back the current sums of just the users touched in the
batch (side by side an updated row has all of them; else the newest version per key), assembles their profiles and runs the regular kNN join
against the static index; recommendations go to ``recs/batch_id=N`` and the users that were
answered to ``recs_users/batch_id=N``.  The newest batch per user is the live answer; after
the stream has consumed the whole log it equals the batch ``recommend_from_events`` result.
Over the sums of ``streaming.live`` the profile follows the live event list instead.

STR-6: items stream -> ``build_index`` per micro-batch (stateless coding + rejects) ->
accepted rows to ``index/batch_id=N/<filters>``, rejects to ``rejects/batch_id=N``.
"""

from __future__ import annotations

from typing import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, knn, profiles
from ..operators.encode import CODES, ITEM_ID
from ..schema import Schema
from ..session import remove_folder
from ..sources.model_io import read_typed, save_types
from .runner import BATCH_ID

USER_ID = profiles.USER_ID


def profile_sums_stream(events: DataFrame, index: DataFrame, schema: Schema,
                        event_weights: Mapping[str, float] | None = None, user_col: str = "user_id",
                        item_col="item_id", event_col: str = "event_type") -> DataFrame:
    """STR-4: streaming ``profiles.running_sums`` (write in update mode)."""
    hist = profiles.history_from_events(events, event_weights, user_col, item_col, event_col)
    rows = profiles.weighted_rows(hist, index, schema)
    return profiles.running_sums(rows, schema)


def current_sums(sums_path: str, spark, users: DataFrame | None = None, base_path: str | None = None,
                 base_upto: int | None = None) -> DataFrame:
    """Newest running sums per user (or ``(user_id, f, c)``) from the batch-keyed sums sink, or from
    a compacted snapshot (newest per key up to batch ``base_upto``) plus the batches
    after it (``batch_id > base_upto`` prunes the older folders)."""
    s = spark.read.parquet(sums_path)
    if base_path is not None and base_upto is not None:
        s = s.filter(F.col(BATCH_ID) > F.lit(base_upto)).unionByName(spark.read.parquet(base_path))
    if users is not None:
        s = s.join(users, USER_ID, "left_semi")
    return latest_keep_batch(s, profiles.sums_key(s))


def latest_keep_batch(df: DataFrame, keys) -> DataFrame:
    """``latest`` that keeps the winning ``batch_id`` (so a snapshot can be merged again)."""
    vals = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col(BATCH_ID)).alias("__v"))
    return top.select(*keys, *[F.col(f"__v.`{c}`").alias(c) for c in vals])


def newest_snapshot(spark, sums_path: str) -> tuple[str | None, int | None]:
    """(path, last batch in it) of the newest finished snapshot of the sums.  A snapshot counts
    once its marker is written, so the pointer outlives the driver and a torn write is unseen."""
    try:
        marks = spark.read.schema("upto long").parquet(f"{sums_path}_markers")
    except AnalysisException:  # no snapshot yet
        return None, None
    upto = marks.agg(F.max("upto")).first()[0]
    return (f"{sums_path}_snapshots/upto={upto}", upto) if upto is not None else (None, None)


def recommend_batch_fn(index: DataFrame, schema: Schema, users_fn: Callable[[DataFrame], DataFrame],
                       sums_path: str, recs_path: str, k: int = 10, compact_every: int = 16, min_history: float = 0.0, **knn_kw):
    """The ``foreachBatch`` body of STR-5 (see module doc).  ``users_fn`` maps the touched
    ``user_id`` table to the query users (``user_id, <filters>[, <user encoder fields>]``).
    Users whose weights sum up to less than ``min_history`` get no answer, and lose an earlier
    one.

    Every ``compact_every`` batches the newest sums are written as a snapshot, so a batch
    reads the snapshot plus at most ``compact_every`` newer batch folders instead of the
    whole history; the folders that a newer snapshot covers are removed.  The pointer to the
    snapshot is a table of its own beside the sums, so a restarted driver goes on from it."""
    def on_batch(upd: DataFrame, batch_id: int) -> None:
        spark = upd.sparkSession
        upd.write.mode("overwrite").parquet(f"{sums_path}/{BATCH_ID}={batch_id}")
        new_sums = spark.read.parquet(f"{sums_path}/{BATCH_ID}={batch_id}")
        touched = new_sums.select(USER_ID).distinct()
        touched.write.mode("overwrite").parquet(f"{recs_path}_users/{BATCH_ID}={batch_id}")
        touched = spark.read.parquet(f"{recs_path}_users/{BATCH_ID}={batch_id}")
        path, upto = newest_snapshot(spark, sums_path)
        whole = profiles.sums_key(new_sums) == [USER_ID]  # an updated row has all sums of its user
        cur = new_sums if whole else current_sums(sums_path, spark, touched, path, upto).drop(BATCH_ID)
        prof = profiles.profiles_of_sums(cur, schema)
        q = profiles.user_queries(users_fn(touched), prof, schema, min_history=min_history)
        recs = knn.knn(q, index, schema, k=k, **knn_kw)
        recs.write.mode("overwrite").parquet(f"{recs_path}/{BATCH_ID}={batch_id}")
        if compact_every and (batch_id + 1) % compact_every == 0:
            new = f"{sums_path}_snapshots/upto={batch_id}"
            current_sums(sums_path, spark, None, path, upto).write.mode("overwrite").parquet(new)
            spark.range(batch_id, batch_id + 1).select(F.col("id").alias("upto")).coalesce(1).write.mode("append").parquet(f"{sums_path}_markers")
            for old in range(0 if upto is None else upto + 1, batch_id):  # the newest folder stays, so that the table keeps its schema
                remove_folder(spark, f"{sums_path}/{BATCH_ID}={old}")
            if path is not None:
                remove_folder(spark, path)
    return on_batch


def live_recommendations(spark, recs_path: str, query_col: str = knn.QUERY_ID) -> DataFrame:
    """The newest recommendation set of every user: all rows of the newest batch that
    answered the user, none if that batch found no history any more."""
    r = spark.read.parquet(recs_path)
    asked = spark.read.parquet(f"{recs_path}_users")
    newest = asked.groupBy(F.col(USER_ID).alias(query_col)).agg(F.max(BATCH_ID).alias(BATCH_ID))
    return r.join(newest, [query_col, BATCH_ID], "left_semi").drop(BATCH_ID)


def index_batch_fn(schema: Schema, index_path: str, rejects_path: str, tables=None, strict_unknown: bool = False):
    """STR-6 ``foreachBatch`` body: code a micro-batch of items, split off the rejects."""
    def on_batch(items: DataFrame, batch_id: int) -> None:
        b = ingest.build_index(items, schema, tables=tables, strict_unknown=strict_unknown)
        w = b.added.write.mode("overwrite")
        if schema.filter_fields:
            w = w.partitionBy(*schema.filter_fields)
        w.parquet(f"{index_path}/{BATCH_ID}={batch_id}")
        save_types(b.added, f"{index_path}_types")
        b.rejects.write.mode("overwrite").parquet(f"{rejects_path}/{BATCH_ID}={batch_id}")
    return on_batch


def read_stream_index(spark, index_path: str, schema: Schema) -> DataFrame:
    """The index written by STR-6 (every batch), in the usual index layout."""
    return read_typed(spark, index_path, f"{index_path}_types").select(ITEM_ID, *schema.filter_fields, CODES)
