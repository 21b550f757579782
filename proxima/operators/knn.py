"""Partitioned k-nearest-neighbour join with per-feature explanations (JN-1/2/5,
DST-1..4, WIN-1/2, TOP-1..4, FLT-3/5/6, AGG-7, Q-1/4/5).

Distances are *factored*: every feature contributes its own component, computed from
the item's code and a query-side representation, so the explanation is free and no
item vector is ever materialised.  For a coded feature with Gram matrix ``G`` (see
``functions.blocks``) and weight factor ``c`` the query side is a pair
``(s, g)`` = (``hᵀGh``, ``Gh``) of its code histogram ``h``; a single item code ``a``
is the histogram ``e_a``.  Then

    l2 component  = c² (s - 2 g[b] + G[b,b])        ip component = c² g[b]

which is exactly ‖mean block - item block‖² / the dot product, for items (one code)
and for averaged user profiles alike.  Numeric features use the scalar, vector features
(embedding / JSON / feature table) the vector.

Plan shape: the query side is broadcast when its row count times the schema's row
width is proven below ``broadcast_bytes`` (a bounded ``limit(n+1).count()`` probe);
otherwise it is a shuffle join whose hot keys are cut into buckets by their pair count.
Candidates are cut to k per query inside each task (``WindowGroupLimit`` partial) before
the single shuffle on the query id.  Hits are ordered by the exact double distance, then
by item id.  Which items a query is compared with is decided by ``operators.cells`` (exact
bounds), by the approximate engines of ``operators.ann``, or not at all (``scan``).
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import encoders as X
from ..functions.numeric import rank_key
from ..schema import Schema
from ..session import write_table
from .encode import CODES, ITEM_ID, REJECT, with_codes
from .ingest import explode_filters, filter_reject

QUERY_ID = "query_id"
STRATEGY_ID = "strategy_id"
DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024
METHODS = ("auto", "scan", "blocked", "ivf", "lsh", "graph")
PAIRS_PER_TASK = 20_000_000   # query-item pairs that one task compares
SCAN_PAIRS = 500_000          # up to so many in all, every pair is compared: finding fewer costs more
NO_ID = "\x00"
TORN_ID = "query id stands for different rows"


# ------------------------------------------------------------------ query reps
def rep_s(f: str) -> str:
    return f"__qs_{f}"


def rep_g(f: str) -> str:
    return f"__qg_{f}"


def rep_x(f: str) -> str:
    return f"__qx_{f}"


def rep_columns(schema: Schema) -> list[str]:
    out = []
    for e in schema.encoders:
        out += [rep_s(e.field), rep_g(e.field)] if e.coded else [rep_x(e.field)]
    return out


def g_at(f: str, code: Column) -> Column:
    """The query's dot product with a code's block; codes the map lacks have none."""
    return F.coalesce(F.try_element_at(F.col(rep_g(f)), code), F.lit(0.0))


def diag_at(e, code: Column) -> Column:
    """Squared norm of a code's unweighted block."""
    if B.identity(e):
        return F.when(code > 0, F.lit(1.0)).otherwise(F.lit(0.0)) if e.type == "strict_onehot" else F.lit(1.0)
    return F.element_at(X.lit_vector(B.gram_diagonal(e)), code + 1)


def coded_rep_from_code(e, code: Column) -> tuple[Column, Column]:
    """(s, g) of a single code: its squared norm and the non-zero products with all codes."""
    if B.identity(e):
        own = F.create_map(code, F.lit(1.0))
        g = F.when(code > 0, own).otherwise(EMPTY_MAP()) if e.type == "strict_onehot" else own
    else:
        g = X.row_map(X.lit_rows(B.gram_rows(e)), code)
    return diag_at(e, code), g


def EMPTY_MAP() -> Column:  # noqa: N802
    return F.create_map().cast("map<int,double>")


def reps_from_codes(schema: Schema, codes: str = CODES) -> list[Column]:
    cols = []
    for e in schema.encoders:
        c = F.col(f"{codes}.`{e.field}`")
        if e.coded:
            s, g = coded_rep_from_code(e, c)
            cols += [s.alias(rep_s(e.field)), g.alias(rep_g(e.field))]
        else:
            cols.append(c.alias(rep_x(e.field)))
    return cols


def _coded_queries(df: DataFrame, schema: Schema, query_id, tables, strict_unknown, restrict_partition) -> DataFrame:
    qid = query_id or schema.id_col
    src = df.withColumn("__qid", F.col(f"`{qid}`").cast("string"))
    src = src.withColumn("__datum", F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    coded = with_codes(src, schema, tables, strict_unknown, keep=["__qid", "__datum"])
    coded = explode_filters(coded, schema)
    if restrict_partition:
        coded = coded.withColumn(REJECT, F.coalesce(F.col(REJECT), filter_reject(schema)))
    return coded


def item_queries(df: DataFrame, schema: Schema, query_id: str | None = None, tables=None,
                 strict_unknown: bool = False, restrict_partition: bool = True) -> DataFrame:
    """Query table with item-like rows -> ``query_id, <filters>, <reps>`` (Q-1).

    Filter values may be lists (the query searches every listed partition, FLT-3).  Rows
    that cannot be encoded or name an undeclared partition are not searched;
    ``query_rejects`` returns them with the reason."""
    coded = _coded_queries(df, schema, query_id, tables, strict_unknown, restrict_partition).filter(F.col(REJECT).isNull())
    return coded.select(F.col("__qid").alias(QUERY_ID), *schema.filter_fields, *reps_from_codes(schema))


def query_rejects(df: DataFrame, schema: Schema, query_id: str | None = None, tables=None,
                  strict_unknown: bool = False, restrict_partition: bool = True) -> DataFrame:
    """``query_id, datum, reason`` of the query rows that are not searched: those that
    ``item_queries`` leaves out (one row for each undeclared value of a listed filter), and
    those of an id that stands for rows with different codes."""
    coded = _coded_queries(df, schema, query_id, tables, strict_unknown, restrict_partition)
    h = F.xxhash64(CODES)
    same = F.coalesce("__qid", F.lit(NO_ID))
    torn = coded.filter(F.col(REJECT).isNull()).groupBy(same.alias("__torn")).agg(F.min(h).alias("a"), F.max(h).alias("b")).filter("a <> b").select("__torn")
    bad = coded.join(torn, same == F.col("__torn"), "left").withColumn(REJECT, F.coalesce(F.col(REJECT), F.when(F.col("__torn").isNotNull(), F.lit(TORN_ID))))
    bad = bad.filter(F.col(REJECT).isNotNull())
    return bad.select(F.col("__qid").alias(QUERY_ID), F.col("__datum").alias("datum"), F.col(REJECT).alias("reason"))


def one_per_id(queries: DataFrame, schema: Schema, restrict_partition: bool = True) -> DataFrame:
    """One row for each query id and partition.  Equal rows of an id are one query, asked once;
    an id whose rows differ in what they ask is not searched (``query_rejects``,
    ``profiles.user_rejects``).  A null id is an id like any other (``NO_ID`` inside a search)."""
    parts = [c for c in schema.filter_fields if c in queries.columns] if restrict_partition else []
    reps = [c for c in rep_columns(schema) if c in queries.columns]
    kinds = dict(queries.dtypes)
    h = F.xxhash64(*[F.array_sort(F.map_entries(F.col(f"`{c}`"))) if kinds[c].startswith("map") else F.col(f"`{c}`") for c in reps], F.lit(0))
    some = F.struct(*[F.col(f"`{c}`") for c in reps], F.lit(0).alias("__any"))
    aggs = [F.first(some).alias("__r"), F.min(h).alias("__a"), F.max(h).alias("__b")]
    if parts:  # as many as the id lists partitions
        aggs.append(F.collect_set(F.struct(*parts)).alias("__p"))
    out = queries.groupBy(F.coalesce(QUERY_ID, F.lit(NO_ID)).alias(QUERY_ID)).agg(*aggs).filter(F.col("__a") == F.col("__b"))
    if parts:
        out = out.withColumn("__p", F.explode("__p"))
    return out.select(QUERY_ID, *[F.col(f"__p.`{c}`").alias(c) for c in parts], *[F.col(f"__r.`{c}`").alias(c) for c in reps])


# ------------------------------------------------------------------ components
def _is_coded(schema, f):
    return schema.encoder(f).coded


def components(schema: Schema, strategy_id=None, weights=None, metric: str | None = None,
               codes: str = CODES) -> dict:
    """Per-feature component columns: l2 -> squared distance part, ip/cosine -> dot part."""
    metric = metric or schema.metric
    w = schema.weights(strategy_id, weights)
    out = {}
    for e in schema.encoders:
        f = e.field
        if w[f] == 0:
            out[f] = F.lit(0.0)  # ENC-14: zero-weight features cost nothing
            continue
        c2 = F.lit(schema.factor(f, strategy_id, weights) ** 2)
        item = F.col(f"{codes}.`{f}`")
        if e.coded:
            gb = g_at(f, item)
            if metric == "l2":
                out[f] = c2 * F.greatest(F.col(rep_s(f)) - 2 * gb + diag_at(e, item), F.lit(0.0))
            else:
                out[f] = c2 * gb
        elif e.type == "numeric":
            q = F.col(rep_x(f))
            out[f] = c2 * ((q - item) * (q - item)) if metric == "l2" else c2 * q * item
        else:
            q = F.col(rep_x(f))
            out[f] = c2 * (X.sqdist(q, item) if metric == "l2" else X.dot(q, item))
    return out


def norms(schema: Schema, strategy_id=None, weights=None, codes: str = CODES) -> tuple[Column, Column]:
    """Squared norms (query, item) of the weighted vectors, for cosine."""
    w = schema.weights(strategy_id, weights)
    qn, inn = F.lit(0.0), F.lit(0.0)
    for e in schema.encoders:
        f = e.field
        if w[f] == 0:
            continue
        c2 = F.lit(schema.factor(f, strategy_id, weights) ** 2)
        item = F.col(f"{codes}.`{f}`")
        if e.coded:
            qn = qn + c2 * F.col(rep_s(f))
            inn = inn + c2 * diag_at(e, item)
        elif e.type == "numeric":
            q = F.col(rep_x(f))
            qn, inn = qn + c2 * q * q, inn + c2 * item * item
        else:
            q = F.col(rep_x(f))
            qn, inn = qn + c2 * X.sqnorm(q), inn + c2 * X.sqnorm(item)
    return qn, inn


def _total(cols: Iterable[Column]) -> Column:
    cols = list(cols)
    t = cols[0]
    for c in cols[1:]:
        t = t + c
    return t


def distance(schema: Schema, comps: Mapping[str, Column], metric: str, strategy_id=None, weights=None,
             l2_root: bool = False) -> Column:
    """Ranking distance: l2 squared (or root, DST-2), ip -> -dot (D5), cosine -> 1 - cos."""
    t = _total(comps.values())
    if metric == "l2":
        return F.sqrt(t) if l2_root else t
    if metric == "ip":
        return -t
    qn, inn = norms(schema, strategy_id, weights)
    den = F.sqrt(qn) * F.sqrt(inn)
    return F.when(den > 0, F.lit(1.0) - t / den).otherwise(F.lit(1.0))


# ------------------------------------------------------------------ the join
def row_count_at_most(df: DataFrame, n: int) -> bool:
    """Proves a size bound with a bounded scan (never reads more than n + 1 rows)."""
    return df.limit(n + 1).count() <= n


def query_row_bytes(schema: Schema) -> int:
    """Upper estimate of one query representation row (ids, filters, reps)."""
    b = 64 + 32 * len(schema.filters)
    for e in schema.encoders:
        b += 16 + (8 * B.n_codes(e) if e.coded else 8 * max(1, e.length))
    return b


def broadcast_row_limit(schema: Schema, broadcast_bytes: int = DEFAULT_BROADCAST_BYTES) -> int:
    return max(1, broadcast_bytes // query_row_bytes(schema))


SPREAD_BYTES = 64 * 1024 * 1024


def _spread(index: DataFrame) -> DataFrame:
    """A broadcast join runs one task per stream-side partition, and a small index may be
    stored in fewer files than there are cores: it is dealt over them.  The plan's own size
    estimate decides, without a job; a large index is never moved."""
    cores = index.sparkSession.sparkContext.defaultParallelism
    estimate = int(index._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return index.repartition(cores) if estimate < cores * SPREAD_BYTES else index


def _balanced(index: DataFrame, q: DataFrame, keys: list[str], pairs_per_task: int) -> DataFrame:
    """Shuffle join whose hot keys are cut by their pair count: a key with more than
    ``pairs_per_task`` query-item pairs deals its items to that many more buckets and
    repeats its queries in each."""
    ni = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("__ni"))
    nq = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("__nq"))
    buckets = F.least(F.col("__ni"), F.ceil(F.col("__ni") * F.col("__nq") / F.lit(float(pairs_per_task)))).cast("bigint")
    hot = ni.join(nq, keys).select(*keys, buckets.alias("__b")).filter("__b > 1")
    one = F.coalesce(F.col("__b"), F.lit(1).cast("bigint"))
    items = index.join(hot, keys, "left").withColumn("__salt", F.pmod(F.xxhash64(ITEM_ID), one)).drop("__b")
    qq = q.join(hot, keys, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1))).drop("__b")
    return items.join(qq, keys + ["__salt"]).drop("__salt")


def candidate_pairs(queries: DataFrame, index: DataFrame, schema: Schema, restrict_partition: bool = True,
                    broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, pairs_per_task: int = PAIRS_PER_TASK,
                    broadcast: bool | None = None, extra_keys: Sequence[str] = ()) -> DataFrame:
    """query ⋈ items on the partition keys (+ ``extra_keys``).

    Small query side (size proven by a bounded count): broadcast hash join, items streamed.
    Otherwise the shuffle join of ``_balanced``.  Unrestricted queries are searched once,
    however many partitions they list; without any key all queries meet all items in blocks
    of items, as many as there are cores or as their pairs fill."""
    keys = (list(schema.filter_fields) if restrict_partition else []) + list(extra_keys)
    q = queries
    if not restrict_partition and any(c in queries.columns for c in schema.filter_fields):
        q = queries.drop(*schema.filter_fields).dropDuplicates([QUERY_ID, *extra_keys])
    if not keys:
        cores = index.sparkSession.sparkContext.defaultParallelism
        blocks = F.lit(max(cores, -(-index.count() * q.count() // pairs_per_task))).cast("bigint")
        index = index.withColumn("__block", F.pmod(F.xxhash64(ITEM_ID), blocks))
        q = q.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        return index.join(q, ["__block"]).drop("__block")
    if broadcast is None:
        broadcast = row_count_at_most(q, broadcast_row_limit(schema, broadcast_bytes))
    if broadcast:
        return _spread(index).join(F.broadcast(q), keys)
    return _balanced(index, q, keys, pairs_per_task)


def _score(pairs: DataFrame, schema: Schema, sids, weights, metric, l2_root, explain, part_cols) -> DataFrame:
    """Per pair: strategy_id, distance and (if explaining) the per-feature components."""
    feats = schema.features
    per = []
    for sid in sids:
        comps = components(schema, sid, weights, metric)
        fields = [F.lit(sid if sid is not None else schema.base_strategy_id).alias(STRATEGY_ID),
                  distance(schema, comps, metric, sid, weights, l2_root).alias("distance")]
        if explain:
            fields += [comps[f].alias(f"__c_{f}") for f in feats]
        per.append(F.struct(*fields))
    base = [QUERY_ID, *part_cols, ITEM_ID]
    if len(per) > 1:
        return pairs.select(*base, F.explode(F.array(*per)).alias("__s")).select(*base, "__s.*")
    return pairs.select(*base, per[0].alias("__s")).select(*base, "__s.*")


def _topk(scored: DataFrame, k: int, group, tie_decimals: int | None) -> DataFrame:
    # equal distances are ties, broken by item_id (D20)
    order = [rank_key(F.col("distance"), tie_decimals), F.col(ITEM_ID)]
    w = Window.partitionBy(*group).orderBy(*order)
    return scored.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")


def engine(schema: Schema, nlist: int | None = None) -> tuple[str, int | None]:
    """(method, nlist) that the schema's ``index_factory`` names: ``Flat`` (exact, the
    default), ``IVF`` or ``IVF<lists>`` (inverted lists), ``LSH`` (random projections),
    ``HNSW`` or ``HNSW<neighbours>`` (neighbour graph; ``degree`` reads the number)."""
    name = (schema.index_factory or "Flat").split(",")[0].strip()
    if name.lower() in ("flat", "exact", ""):
        return "auto", nlist
    if name.upper().startswith("IVF") and name[3:].isdigit() | (len(name) == 3):
        return "ivf", nlist or (int(name[3:]) if name[3:] else None)
    if name.upper() == "LSH":
        return "lsh", nlist
    if name.upper().startswith("HNSW") and name[4:].isdigit() | (len(name) == 4):
        return "graph", nlist
    raise ValueError(f"unknown index_factory {schema.index_factory!r}: Flat, IVF<lists>, LSH or HNSW<neighbours>")


def degree(schema: Schema, default: int) -> int:
    """Neighbours of an item in the graph that ``HNSW<neighbours>`` names."""
    name = (schema.index_factory or "").split(",")[0].strip()
    return int(name[4:]) if name.upper().startswith("HNSW") and name[4:].isdigit() else default


def knn(queries: DataFrame, index: DataFrame, schema: Schema, k: int = 10, strategy_id=None,
        strategies: Sequence | None = None, weights=None, explain: bool = False, k_scope: str = "partition",
        restrict_partition: bool = True, l2_root: bool = False, metric: str | None = None,
        broadcast_bytes: int = DEFAULT_BROADCAST_BYTES, pairs_per_task: int = PAIRS_PER_TASK, broadcast: bool | None = None,
        tie_decimals: int | None = None, exclude_self: bool = False, method: str = "auto",
        nlist: int | None = None, nprobe: int | None = None, ann_feature: str | None = None, centroids=None,
        lsh: Mapping | None = None, graph: Mapping | None = None, materialize: bool = True) -> DataFrame:
    """k nearest items of every query (exact).

    ``k_scope="partition"`` keeps up to k hits per searched partition (the reference's
    multi-partition behaviour, D4); ``"total"`` keeps k per query overall.  With
    ``strategies`` (a list of strategy ids) every variant is ranked side by side from the
    same candidate scan (Q-5) and a ``strategy_id`` column is added.

    ``method``: ``"scan"`` compares each query with every item of its partition;
    ``"blocked"`` visits only the cells of items whose exact bound allows a hit
    (``operators.cells``; any metric, any number of strategies) and gives the same result;
    ``"auto"`` picks ``blocked`` unless there are few pairs anyway.  Where most items share
    their codes with others, both search the distinct codes.  ``"ivf"`` and ``"lsh"`` are the
    approximate engines of ``operators.ann`` on the vector feature ``ann_feature``: inverted
    lists (``nlist``, ``nprobe``, or fitted ``centroids``; without ``nprobe`` as many lists as
    reach ``ann.RECALL`` of the exact hits) and random projections (``lsh``: ``bucket_length``,
    ``num_tables``, ``num_hashes``, ``seed``).  ``"graph"`` walks a neighbour graph over the whole
    weighted vector (``operators.graph``; ``graph``: ``m``, ``delta``, ``seed``, ``ef`` or built
    ``graphs``, one a strategy; without ``ef`` the walks are as wide as reach ``ann.RECALL``).
    They choose the candidates; strategies, weights,
    metric, scopes and explanations are those of the exact search.  A query that meets fewer
    than k items is searched exactly.

    ``materialize`` writes the query table and an approximate engine's hits once under the
    checkpoint folder; the cell search always writes its bounded tables.

    Queries are asked once an id (``one_per_id``).

    Output: ``query_id, [strategy_id], <filters>, rank, item_id, distance, [x_<feature>...]``
    where ``rank`` is 1-based over the query's merged, distance-ordered hits.
    """
    from . import cells, tiles
    metric = metric or schema.metric
    multi = strategies is not None
    if method == "auto":
        method, nlist = engine(schema, nlist)
    if method not in METHODS:
        raise ValueError(f"unknown search method {method!r}: one of {', '.join(METHODS)}")
    sids = [str(s) for s in strategies] if multi else [strategy_id]
    feats = schema.features
    part_cols = list(schema.filter_fields)
    keys = part_cols if restrict_partition else []
    grp = [QUERY_ID, STRATEGY_ID]
    local_grp = grp + (part_cols if (k_scope == "partition" and restrict_partition) else [])
    met = [c for c in local_grp if c != STRATEGY_ID]
    saved = (lambda df, name: write_table(df, name)) if materialize else (lambda df, name: df)
    queries = saved(one_per_id(queries, schema, restrict_partition), "knn-queries")

    ids = None
    used = [e for e in schema.encoders if any(schema.weights(s, weights)[e.field] != 0 for s in sids)]
    if method == "graph":
        if not (graph and graph.get("graphs")):
            # search the distinct codes; the query's own id is taken off when they are opened again
            ids = index = saved(cells.distinct_codes(index, schema, k + exclude_self), "knn-codes")
    elif method in ("auto", "scan", "blocked") and cells.repeated_codes(schema, index, used):
        index = saved(cells.few_of_a_code(index, schema, k + exclude_self), "knn-codes")
    most = k + (1 if ids is not None and exclude_self else 0)
    not_self = F.coalesce(F.col(ITEM_ID) != F.col(QUERY_ID), F.lit(True))

    def best(pairs, explained=explain):
        if exclude_self and ids is None:
            pairs = pairs.filter(not_self)
        return _topk(_score(pairs, schema, sids, weights, metric, False, explained, part_cols), most, local_grp, tie_decimals)

    def told(explained):
        return tiles.spec(schema, most, sids, weights, metric, tie_decimals, exclude_self and ids is None, explained)

    def merged(found):
        return _topk(found.drop(tiles.RANK), most, local_grp, tie_decimals)

    def hits(q, items, extra=(), explained=explain):
        by = [*keys, *extra]
        items, table, _ = tiles.tiled(items, by, size=tiles.tile_size(told(explained)))
        return merged(tiles.met(tiles.all_tiles(q, table, by), items, schema, told(explained), by, part_cols))

    ranked = False  # do the hits come with their place in the whole list?
    if method in ("ivf", "lsh", "graph"):
        from . import ann
        if method == "graph":
            near = best(_graph_pairs(queries, index, schema, most, sids, weights, metric, restrict_partition, best, hits, dict(graph or {})))
        elif method == "ivf":
            cents = centroids if centroids is not None else ann.fit_ivf(index, schema, nlist, ann_feature)
            ib = ann.assign_lists(index, schema, cents, ann_feature)
            if nprobe is None:
                nprobe = ann.measured_probes(queries, ib, schema, cents, k, sids=sids, weights=weights, metric=metric,
                                             restrict_partition=restrict_partition, group=local_grp, exclude_self=exclude_self,
                                             tie_decimals=tie_decimals, feature=ann_feature)
            near = hits(ann.probe_lists(queries, schema, cents, nprobe, ann_feature), ib, [ann.LIST_ID])
        else:
            # the best of each bucket; an item that several tables bring counts in the first of them
            q, items = ann.lsh_buckets(queries, index, schema, ann_feature, metric, sids, weights, **(lsh or {}))
            items, table, _ = tiles.tiled(saved(items, "lsh-items"), [*keys, *ann.BUCKET])
            near = tiles.met(tiles.all_tiles(q, table, [*keys, *ann.BUCKET]), items, schema, told(explain), [*keys, *ann.BUCKET], [*part_cols, ann.BUCKET[0]])
            again = Window.partitionBy(*grp, *part_cols, ITEM_ID)
            near = merged(near.withColumn("__first", F.min(ann.BUCKET[0]).over(again)).filter(F.col("__first") == F.col(ann.BUCKET[0])).drop("__first", ann.BUCKET[0]))
        near = saved(near, f"{method}-hits")
        # queries that met fewer than k items are searched exactly
        full = near.groupBy(*met).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") >= most * len(sids)).select(*met)
        short = saved(queries.join(full, met, "left_anti"), f"{method}-short")
        top = near.join(full, met, "left_semi").unionByName(hits(short, index))
    else:
        plan, items = None, index
        if method == "blocked" or method == "auto" and tiles.largest(index, keys) > tiles.tile_size(told(False)):
            plan, _ = cells.plan(schema, index, most, sids, weights, metric, restrict_partition)
            if method == "blocked" and plan is None and index.take(1):
                raise ValueError("blocked search needs a feature that bounds distances")
            if plan is not None:
                items = cells.with_cells(index, plan)
        sp = told(explain)
        items, table, tiles_of_a_key = tiles.tiled(items, keys, plan, tiles.tile_size(sp))
        if plan is None or tiles_of_a_key <= 1:
            top = tiles.met(tiles.all_tiles(queries, table, keys), items, schema, sp, keys, part_cols)
            ranked = tiles_of_a_key <= 1 and (not keys or not queries.groupBy(QUERY_ID).count().filter("count > 1").take(1))
            if not (ranked or tiles_of_a_key <= 1 and local_grp != grp):
                top = merged(top)
        else:
            first = saved(tiles.met(tiles.visits(queries, table, schema, sp, plan, False), items, schema, sp, keys, part_cols), "knn-first")
            asked = queries.join(tiles.taus(first, met, sp, most), met, "left")
            rest = tiles.met(tiles.visits(asked, table, schema, sp, plan, True), items, schema, sp, keys, part_cols)
            top = merged(first.unionByName(rest))
    if ids is not None:
        top = top.join(ids.select(ITEM_ID, *part_cols, cells.IDS), [ITEM_ID, *part_cols])
        top = top.withColumn(ITEM_ID, F.explode(cells.IDS)).drop(cells.IDS)
        top = _topk(top.filter(not_self) if exclude_self else top, k, local_grp, tie_decimals)
    if l2_root and metric == "l2":
        top = top.withColumn("distance", F.sqrt("distance"))
    top = top.withColumn(QUERY_ID, F.nullif(F.col(QUERY_ID), F.lit(NO_ID)))

    if ranked:
        top = top.withColumnRenamed(tiles.RANK, "rank")
    else:
        order = [rank_key(F.col("distance"), tie_decimals), F.col(ITEM_ID)]
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*grp).orderBy(*order)))
    out_cols = [QUERY_ID] + ([STRATEGY_ID] if multi else []) + part_cols + ["rank", ITEM_ID, "distance"]
    if explain:
        if metric == "l2":
            xs = [F.col(f"__c_{f}").alias(f"x_{f}") for f in feats]
        else:
            # D7: each feature's similarity relative to the first hit's similarity
            first = Window.partitionBy(*grp).orderBy("rank")
            xs = []
            for f in feats:
                f0 = F.first(F.col(f"__c_{f}")).over(first)
                xs.append(F.coalesce(F.lit(1.0) - F.try_divide(F.col(f"__c_{f}"), f0), F.lit(0.0)).alias(f"x_{f}"))
        return top.select(*out_cols, *xs)
    return top.select(*out_cols)


def _graph_pairs(queries, index, schema, k, sids, weights, metric, restrict_partition, best, hits, opts) -> DataFrame:
    """Candidates of ``graph.graph_pairs`` over given graphs or new ones, one a strategy."""
    from . import ann, graph
    ef, graphs, m = opts.pop("ef", None), opts.pop("graphs", None), opts.pop("m", degree(schema, graph.M))
    if graphs is None:
        graphs = [graph.build_graph(index, schema, m, s, weights, metric, restrict_partition, **opts) for s in sids]
    items = [graph.placed(index, schema, g) for g in graphs]
    if ef is None:
        ef = graph.measured_ef(queries, index, schema, graphs, items, k, best, ann.RECALL, ann.MEASURED_QUERIES, weights, metric,
                               lambda q: hits(q, index))
    return graph.graph_pairs(queries, index, schema, graphs, items, max(int(ef), k + 1), weights, metric)


def explanation_map(df: DataFrame, schema: Schema, name: str = "explanation") -> DataFrame:
    """Pack ``x_<feature>`` columns into one ``MAP<STRING,DOUBLE>`` column (Q-4)."""
    feats = schema.features
    m = F.create_map(*[x for f in feats for x in (F.lit(f), F.col(f"x_{f}"))])
    return df.select(*[c for c in df.columns if not c.startswith("x_")], m.alias(name))


def explanation_check(df: DataFrame, schema: Schema) -> DataFrame:
    """AGG-7: for l2 the components sum to the distance; adds ``explain_gap``."""
    s = _total([F.col(f"x_{f}") for f in schema.features])
    return df.withColumn("explain_gap", F.abs(s - F.col("distance")))


def fetch(index: DataFrame, labels: DataFrame, schema: Schema, strategy_id=None, label_col: str = "item_id") -> DataFrame:
    """JN-3: vectors of the listed labels, per partition; unknown labels vanish."""
    from .encode import decode
    lbl = labels.select(F.col(label_col).cast("string").alias(ITEM_ID)).distinct()
    hit = index.join(lbl, ITEM_ID, "left_semi")
    return decode(hit, schema, strategy_id)
