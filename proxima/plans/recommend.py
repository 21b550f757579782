"""User-facing composite operators (Q-1..Q-7): one call = one Spark plan over whole
tables of queries or users."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ingest, knn, profiles
from ..operators.encode import ITEM_ID
from ..schema import Schema


def similar_items(queries: DataFrame, index: DataFrame, schema: Schema, k: int = 10, strategy_id=None,
                  explain: bool = False, query_id: str | None = None, **kw) -> DataFrame:
    """Q-1 (+Q-4): k nearest indexed items of every item-like query row."""
    q = knn.item_queries(queries, schema, query_id=query_id, restrict_partition=kw.get("restrict_partition", True))
    return knn.knn(q, index, schema, k=k, strategy_id=strategy_id, explain=explain, **kw)


def query_rejects(queries: DataFrame, schema: Schema, **kw) -> DataFrame:
    """The query rows that ``similar_items`` cannot search, with the reason."""
    return knn.query_rejects(queries, schema, **kw)


def user_rejects(users: DataFrame, schema: Schema, **kw) -> DataFrame:
    """The users that ``recommend`` cannot search as asked, with the reason."""
    return profiles.user_rejects(users, schema, **kw)


def recommend(users: DataFrame, history: DataFrame, index: DataFrame, schema: Schema, k: int = 10,
              strategy_id=None, explain: bool = False, dedupe: bool = False,
              cold_start: DataFrame | None = None, cold_start_weight: float = 1.0,
              min_history: float = 0.0, cold_vectors: DataFrame | None = None,
              tables: Mapping | None = None, **kw) -> DataFrame:
    """Q-2: k nearest items to each user's (weighted) item history.

    ``users``: ``user_id, <filters>[, <user encoder fields>]``; ``history``:
    ``user_id, item_id[, w]``.  Cold start: pseudo-items (``cold_start``) or stored vectors
    over the whole feature space (``cold_vectors``: ``user_id, vec``, JN-10), either with
    ``cold_start_weight``.  ``user_rejects`` and ``profiles.cold_start_rejects`` list what
    could not be used."""
    if cold_vectors is not None:
        if cold_start is not None:
            raise ValueError("give cold_start items or cold_vectors, not both")
        prof = profiles.profiles_with_vectors(history, index, schema, cold_vectors, cold_start_weight, dedupe)
    else:
        prof = profiles.profiles(history, index, schema, dedupe=dedupe, cold_start=cold_start,
                                 cold_start_weight=cold_start_weight)
    q = profiles.user_queries(users, prof, schema, min_history=min_history, tables=tables)
    # the search writes the user queries once, so the history is not aggregated again
    return knn.knn(q, index, schema, k=k, strategy_id=strategy_id, explain=explain, **kw)


def recommend_from_events(users: DataFrame, events: DataFrame, index: DataFrame, schema: Schema,
                          event_weights: Mapping[str, float] | None = None, k: int = 10,
                          user_col: str = "user_id", item_col="item_id", event_col: str = "event_type",
                          **kw) -> DataFrame:
    """Q-3: like ``recommend`` with the history taken from a weighted event log."""
    hist = profiles.history_from_events(events, event_weights, user_col, item_col, event_col)
    return recommend(users, hist, index, schema, k=k, **kw)


def variants_side_by_side(queries: DataFrame, index: DataFrame, schema: Schema,
                          strategy_ids: Sequence, k: int = 10, **kw) -> DataFrame:
    """Q-5: the same queries ranked under several weight sets."""
    q = knn.item_queries(queries, schema)
    return knn.knn(q, index, schema, k=k, strategies=list(strategy_ids), **kw)


def index_stats(index: DataFrame, schema: Schema, strategy_id=None) -> DataFrame:
    """Q-7: per declared partition: element count, plus the vector dimension."""
    st = ingest.partition_stats(index, schema)
    return st.withColumn("dim", F.lit(schema.dim(strategy_id)))


def fetch_vectors(index: DataFrame, labels: DataFrame, schema: Schema, strategy_id=None,
                  label_col: str = ITEM_ID) -> DataFrame:
    """JN-3: vectors of the given labels grouped by partition."""
    return knn.fetch(index, labels, schema, strategy_id, label_col)
