"""Exact kNN over cells: bounds decide which items a query is compared with (JN-1, DST-1..4,
FLT-5, Q-5).

Items fall into cells by the features that tell them apart: a coded feature's code, a numeric
feature's value bucket, a vector feature's nearest pivot (an indexed vector).  Only cells that
hold items exist: one row each, with what bounds every item in it (codes, value range, pivot
radius, range of norms).  For a query and a cell that gives an exact lower bound of the
distance under every metric:

    l2      the sum of the components' lower bounds (triangle inequality at the pivot)
    ip      minus the sum of the dot products' upper bounds (Cauchy-Schwarz around the pivot)
    cosine  the same over the query's norm and the cell's smallest (or largest) norm

A search has two passes.  The first takes a query's cells by bound until they hold k items and
searches those: the k-th distance found is tau.  The second visits the cells whose bound is at
most tau.  Both go down two levels, coarse cells (a bounded number in a partition) and the
cells in them, so a query never looks at all cells.  With several weight sets the bounds, tau
and the visits are kept for each, and a cell is visited once if any of them asks for it.

Every join is an equi-join on the partition and the cell; hot cells are cut by their pairs as
hot partitions are (``knn._balanced``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import encoders as X
from ..schema import Schema
from ..session import ship_package, write_table
from .encode import CODES, ITEM_ID

MAX_CODES = 4096    # a query holds one bound for each code of a coded dimension
MAX_COARSE = 4096   # coarse cells of a partition
MAX_BUCKETS = 4096  # of a numeric dimension
MAX_PIVOTS = 1024   # of a vector dimension
SAMPLE = 4          # indexed vectors, a pivot, that pivots are chosen from (any choice gives the same hits)
FILL = 4            # items of a cell, in k; a coarse cell holds so many times more
VISIT = 16          # pairs that cost as much as one visit of a cell
SAMPLED = 64        # queries that the cost of a search is measured on
ROUNDING = 1e-9     # relative error that bounds are widened by
COARSE, FINE = "__c", "__f"


@dataclass
class Dim:
    """One dimension of the cells: ``cell`` numbers the items' cells from 0."""
    e: object
    kind: str  # code, numeric, vector
    size: int
    cell: Column
    pivots: np.ndarray | None = None


@dataclass
class Plan:
    schema: Schema
    metric: str
    strategies: Sequence
    weights: object
    dims: list[Dim]
    coarse: int  # so many dimensions make the coarse cells
    keys: list[str]  # partition columns
    rest: list = field(default_factory=list)  # features that are no dimension

    def factor(self, e, sid) -> float:
        w = self.schema.weights(sid, self.weights)
        return 0.0 if w[e.field] == 0 else self.schema.factor(e.field, sid, self.weights) ** 2


def _code(e) -> Column:
    return F.col(f"{CODES}.`{e.field}`")


def _vector(e) -> Column:
    return _code(e).cast("array<double>")


def plan(schema: Schema, index: DataFrame, k: int, strategies: Sequence = (None,), weights=None, metric: str | None = None,
         restrict_partition: bool = True) -> tuple[Plan | None, int]:
    """(cell plan or None if no feature bounds anything, items of an average partition).

    Dimensions are added while a cell holds ``FILL`` x k items on average, as a visit costs
    about as much as comparing so many: coded features (those whose codes lie furthest apart first), then numeric ones in equal
    buckets, then vectors around pivots.  Sizes are those of the partitions that have items."""
    metric = metric or schema.metric
    keys = list(schema.filter_fields) if restrict_partition else []
    used = [e for e in schema.encoders if any(schema.weights(s, weights)[e.field] != 0 for s in strategies)]
    nums = [e for e in used if e.type == "numeric"]
    aggs = [F.count(F.lit(1)).alias("n")]
    if keys:
        aggs.append(F.approx_count_distinct(F.struct(*keys)).alias("parts"))
    for i, e in enumerate(nums):
        aggs += [F.min(_code(e)).alias(f"lo{i}"), F.max(_code(e)).alias(f"hi{i}")]
    stats = index.agg(*aggs).first()
    per_part = (stats["n"] or 0) / max(1, stats["parts"] if keys else 1)
    if not stats["n"]:
        return None, 0
    out = Plan(schema, metric, list(strategies), weights, [], 0, keys)
    coded = [(B.separation(e) * max(out.factor(e, s) for s in strategies), i, e) for i, e in enumerate(used)
             if e.coded and 1 < B.n_codes(e) <= MAX_CODES]
    cells = 1
    for apart, _, e in sorted(coded, key=lambda x: (-x[0], x[1])):
        if (apart > 0 or metric != "l2") and (cells == 1 or cells * B.n_codes(e) * FILL * k <= per_part):
            out.dims.append(Dim(e, "code", B.n_codes(e), _code(e)))
            cells *= B.n_codes(e)
    for i, e in enumerate(nums):
        lo, hi = float(stats[f"lo{i}"]), float(stats[f"hi{i}"])
        n = int(min(MAX_BUCKETS, max(1, per_part / (cells * FILL * k))))
        width = (hi - lo) / n if hi > lo else 1.0
        at = F.least(F.greatest(F.floor((_code(e) - F.lit(lo)) / F.lit(width)), F.lit(0)), F.lit(n - 1)).cast("int")
        out.dims.append(Dim(e, "numeric", n, at))
        cells *= n
    for e in used:
        if e.coded or e.type == "numeric":
            continue
        n = int(min(MAX_PIVOTS, max(1, round((per_part / cells) ** 0.5))))
        top = index.orderBy(F.xxhash64(ITEM_ID), ITEM_ID).limit(SAMPLE * n).select(_vector(e).alias("v")).collect()
        pivots = _far_apart(np.array([r.v for r in top], float), n)
        out.dims.append(Dim(e, "vector", len(pivots), F.lit(0), pivots))
        cells *= len(pivots)
    if not out.dims:
        return None, per_part
    out.rest = [e for e in used if all(e is not d.e for d in out.dims)]
    size = 1
    for d in out.dims:
        if out.coarse and (size * d.size > MAX_COARSE or per_part / (size * d.size) < FILL * FILL * k):
            break
        size, out.coarse = size * d.size, out.coarse + 1
    return out, per_part


# ------------------------------------------------------------------ vectors
def _apart(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances by differences, as a distance of nothing must come out as nothing."""
    out = np.empty((len(x), len(pivots)))
    step = max(1, (1 << 21) // max(1, pivots.size))
    for i in range(0, len(x), step):
        out[i:i + step] = np.sqrt(((x[i:i + step, None, :] - pivots[None]) ** 2).sum(axis=2))
    return out


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the vectors, each as far as possible from those before it; fewer if the rest are
    copies.  Groups of near vectors then have a pivot each, and small radii."""
    chosen, d = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < n and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _vector_column(spark, vec: Column, pivots: np.ndarray, work, kind: str) -> Column:
    ship_package(spark)
    shared = spark.sparkContext.broadcast(pivots)

    def run(it):
        for a in it:
            yield work(np.asarray(a.flatten(), dtype=float).reshape(len(a), shared.value.shape[1]), shared.value)

    return _arrow(run, kind)(vec)


def _arrow(fn, kind: str):
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from fn(it)

    return F.arrow_udf(run, kind).asNondeterministic()


def _nearest(x, pivots):
    d = _apart(x, pivots)
    at = d.argmin(axis=1) if len(x) else np.zeros(0, int)
    return pa.StructArray.from_arrays([pa.array(at, pa.int32()), pa.array(d[np.arange(len(x)), at])], names=["at", "r"])


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(values.ravel()))


def _distances(x, pivots):
    return _lists(_apart(x, pivots))


def _dots(x, pivots):
    return _lists(x @ pivots.T)


# ------------------------------------------------------------------ cells
def with_cells(index: DataFrame, p: Plan) -> DataFrame:
    """The index with the numbers of each item's coarse cell and cell, and its distance from the
    pivot.  Written once if a vector decides (its pivots are searched once)."""
    out, at = index, []
    for j, d in enumerate(p.dims):
        if d.kind == "vector":
            out = out.withColumn(f"__p{j}", _vector_column(index.sparkSession, _vector(d.e), d.pivots, _nearest, "struct<at: int, r: double>"))
            out = out.select("*", F.col(f"__p{j}.at").alias(f"__d{j}"), F.col(f"__p{j}.r").alias(f"__r{j}")).drop(f"__p{j}")
        else:
            out = out.withColumn(f"__d{j}", d.cell.cast("int"))
        at.append(F.col(f"__d{j}").cast("bigint"))
    key = lambda n: _key(at[:n], p.dims[:n])
    out = out.select("*", key(p.coarse).alias(COARSE), key(len(at)).alias(FINE))
    return write_table(out, "cell-items") if any(d.kind == "vector" for d in p.dims) else out


def _key(cells: Sequence[Column], dims: Sequence[Dim]) -> Column:
    """One number for the cells of several dimensions; there are about as many as items at most."""
    out = F.lit(0).cast("bigint")
    for c, d in zip(cells, dims):
        out = out * F.lit(d.size).cast("bigint") + c
    return out


def _stats(p: Plan, items: DataFrame | None) -> list[Column]:
    """Aggregates that bound the items of a cell; over cells (``items`` None) those of a coarse one."""
    lowest = lambda c, x: (F.min(c) if items is None else F.min(x)).alias(c)
    highest = lambda c, x: (F.max(c) if items is None else F.max(x)).alias(c)
    out = [(F.sum("n") if items is None else F.count(F.lit(1))).alias("n")]
    for j, d in enumerate(p.dims):
        own = items is not None or j < p.coarse
        if d.kind == "numeric":
            out += [lowest(f"lo{j}", _code(d.e)), highest(f"hi{j}", _code(d.e))]
        elif own:
            out.append((F.min(f"d{j}") if items is None else F.min(f"__d{j}")).alias(f"d{j}"))
        if d.kind == "vector" and own:
            out.append(highest(f"r{j}", F.col(f"__r{j}")))
    for name, e in _vectors(p):
        out += [lowest(f"{name}lo", X.sqnorm(_vector(e))), highest(f"{name}hi", X.sqnorm(_vector(e)))]
    return out


def _vectors(p: Plan):
    """Vector features whose norms bound something."""
    if p.metric == "l2":
        return []
    return [(f"v{i}", e) for i, e in enumerate([d.e for d in p.dims if d.kind == "vector"] + [e for e in p.rest if not e.coded])]


def cell_table(items: DataFrame, p: Plan) -> DataFrame:
    return write_table(items.groupBy(*p.keys, COARSE, FINE).agg(*_stats(p, items)), "cells")


def coarse_table(cells: DataFrame, p: Plan) -> DataFrame:
    """One row a partition: the list of its coarse cells, at most ``MAX_COARSE`` (or as many as
    the first dimension has)."""
    each = cells.groupBy(*p.keys, COARSE).agg(*_stats(p, None))
    names = [c for c in each.columns if c not in p.keys]
    return each.groupBy(*p.keys).agg(F.collect_list(F.struct(*names)).alias("__top"))


# ------------------------------------------------------------------ bounds
def _against_code(e, l2: bool):
    from .knn import diag_at, g_at, rep_s

    def one(code):
        g = g_at(e.field, code)
        return F.greatest(F.col(rep_s(e.field)) - 2 * g + diag_at(e, code), F.lit(0.0)) if l2 else g
    return one


def prepared(queries: DataFrame, p: Plan) -> DataFrame:
    """Query id, partition and what the bounds read: per dimension the components against every
    code, the distances or dot products with every pivot, and the norms."""
    from .knn import QUERY_ID, norms, rep_x
    cols = [QUERY_ID, *p.keys]
    for j, d in enumerate(p.dims):
        f = d.e.field
        if d.kind == "code":
            one = _against_code(d.e, p.metric == "l2")
            cols.append(F.transform(F.sequence(F.lit(0), F.lit(d.size - 1)), one).alias(f"__a{j}"))
        elif d.kind == "numeric":
            cols.append(F.col(rep_x(f)).alias(f"__a{j}"))
        else:
            work = _distances if p.metric == "l2" else _dots
            cols.append(_vector_column(queries.sparkSession, F.col(rep_x(f)).cast("array<double>"), d.pivots, work, "array<double>").alias(f"__a{j}"))
    for name, e in _vectors(p):
        cols.append(F.sqrt(X.sqnorm(F.col(rep_x(e.field)))).alias(f"__{name}"))
    for i, e in enumerate(p.rest):
        if e.coded and p.metric != "l2":
            best = F.array_max(F.concat(F.map_values(F.col(f"__qg_{e.field}")), F.array(F.lit(0.0))))
            cols.append(best.alias(f"__g{i}"))
    if p.metric == "cosine":
        for i, s in enumerate(p.strategies):
            cols.append(F.sqrt(norms(p.schema, s, p.weights)[0]).alias(f"__qn{i}"))
    out = queries.select(*cols)
    for j, d in enumerate(p.dims):
        if d.kind != "numeric" and j >= p.coarse:  # for coarse cells, which do not tell this dimension
            out = out.withColumn(f"__m{j}", F.array_min(f"__a{j}") if p.metric == "l2" else F.array_max(f"__a{j}"))
    return write_table(out, "cell-queries") if any(d.kind == "vector" for d in p.dims) else out


def bound(p: Plan, i: int, get, fine: bool) -> Column:
    """Lower bound, under strategy ``i``, of the distance to every item of a cell whose values
    ``get`` names; widened by the rounding of its terms."""
    sid, terms, low, high = p.strategies[i], [], F.lit(0.0), F.lit(0.0)
    names = {e.field: name for name, e in _vectors(p)}
    l2 = p.metric == "l2"
    diag = lambda e: (min(B.gram_diagonal(e)), max(B.gram_diagonal(e))) if not B.identity(e) else ((0.0 if e.type == "strict_onehot" else 1.0), 1.0)
    for j, d in enumerate(p.dims):
        c2, a = p.factor(d.e, sid), F.col(f"__a{j}")
        if c2 == 0:
            continue
        told, w = fine or j < p.coarse, F.lit(c2)
        if d.kind == "numeric":
            lo, hi = get(f"lo{j}"), get(f"hi{j}")
            gap = F.greatest(lo - a, a - hi, F.lit(0.0))
            terms.append(w * (gap * gap if l2 else F.greatest(a * lo, a * hi)))
            least = F.when((lo <= 0) & (hi >= 0), F.lit(0.0)).otherwise(F.least(lo * lo, hi * hi))
            low, high = low + w * least, high + w * F.greatest(lo * lo, hi * hi)
        elif d.kind == "code":
            terms.append(w * (F.element_at(a, get(f"d{j}") + 1) if told else F.col(f"__m{j}")))
            n = diag(d.e)
            if told and not l2:
                from .knn import diag_at
                n = (diag_at(d.e, get(f"d{j}")),) * 2
            low, high = low + w * n[0], high + w * n[1]
        else:
            if l2 and told:
                gap = F.greatest(F.element_at(a, get(f"d{j}") + 1) * F.lit(1 - ROUNDING) - get(f"r{j}") * F.lit(1 + ROUNDING), F.lit(0.0))
                terms.append(w * gap * gap)
            elif not l2:
                q, v = F.col(f"__{names[d.e.field]}"), names[d.e.field]
                most = q * F.sqrt(get(f"{v}hi"))  # Cauchy-Schwarz around nothing, and around the pivot
                if told:
                    most = F.least(most, F.element_at(a, get(f"d{j}") + 1) + q * get(f"r{j}") + F.abs(F.element_at(a, get(f"d{j}") + 1)) * F.lit(ROUNDING))
                terms.append(w * most)
                low, high = low + w * get(f"{v}lo"), high + w * get(f"{v}hi")
    for n, e in enumerate(p.rest):
        c2 = p.factor(e, sid)
        if c2 == 0 or l2:
            continue
        if e.coded:
            terms.append(F.lit(c2) * F.col(f"__g{n}"))
            low, high = low + F.lit(c2 * diag(e)[0]), high + F.lit(c2 * diag(e)[1])
        else:
            v = names[e.field]
            terms.append(F.lit(c2) * F.col(f"__{v}") * F.sqrt(get(f"{v}hi")))
            low, high = low + F.lit(c2) * get(f"{v}lo"), high + F.lit(c2) * get(f"{v}hi")
    total, size = F.lit(0.0), F.lit(0.0)
    for t in terms:
        total, size = total + t, size + F.abs(t)
    slack = size * F.lit(ROUNDING)
    if l2:
        return total - slack
    if p.metric == "ip":
        return -(total + slack)
    most = total + slack
    norm = F.sqrt(F.when(most >= 0, low).otherwise(high)) * F.col(f"__qn{i}")
    near = F.when(norm > 0, most / norm).otherwise(F.when(most > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    return F.when(F.col(f"__qn{i}") > 0, F.lit(1.0) - F.least(F.greatest(near, F.lit(-1.0)), F.lit(1.0)) - F.lit(ROUNDING)).otherwise(F.lit(1.0 - ROUNDING))


def _bounded(q: DataFrame, cells: DataFrame, p: Plan) -> DataFrame:
    """Queries with the list ``__b`` of their partition's coarse cells and bounds."""
    tops = coarse_table(cells, p)
    if p.keys:
        q = q.join(tops, p.keys)
    else:  # one list, of bounded length
        kind = dict(tops.dtypes)["__top"]
        rows = [r.asDict() for r in tops.collect()[0][0]] if tops.take(1) else []
        q = q.withColumn("__top", X.lit_json(rows, kind))
    each = lambda x: F.struct(x[COARSE].alias("c"), x["n"].alias("n"), *[bound(p, i, lambda c: x[c], False).alias(f"b{i}") for i in range(len(p.strategies))])
    return q.withColumn("__b", F.transform("__top", each)).drop("__top")


def _first_cells(b: Column, k: int) -> Column:
    """The coarse cells with the smallest bounds that hold k items together."""
    ordered = F.array_sort(F.transform(b, lambda x: F.struct(x["b0"].alias("b"), x["c"].alias("c"), x["n"].alias("n"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast("array<bigint>").alias("c"))
    take = lambda acc, x: F.when(acc["n"] >= k, acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), F.array_append(acc["c"], x["c"]).alias("c")))
    return F.aggregate(ordered, start, take, lambda acc: acc["c"])


def visits(queries: DataFrame, cells: DataFrame, p: Plan, k: int, search, tau_keys: Sequence[str], tie_decimals: int | None = None) -> DataFrame:
    """``query_id, <partition>, __f``: the cells (of ``cell_table``) that hold every one of the k
    nearest items.

    ``search(visits)`` returns the scored top k of the cells given; it is called for the first
    pass.  ``tau_keys`` are the columns a result list belongs to, without the strategy."""
    from .knn import QUERY_ID, STRATEGY_ID
    me = [QUERY_ID, *p.keys]
    q = _bounded(prepared(queries, p), cells, p)
    values = [c for c in q.columns if c != "__b"]
    down = lambda rows: rows.join(cells.withColumnRenamed(COARSE, "c"), [*p.keys, "c"])
    under = lambda i: bound(p, i, F.col, True)
    # pass 1: the best cells of the best coarse cells, until they hold k items
    near = down(q.select(*values, F.explode(_first_cells(F.col("__b"), k)).alias("c")))
    near = near.select(*me, FINE, "n", under(0).alias("__lb"))
    so_far = Window.partitionBy(*me).orderBy("__lb", FINE).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("__sum", F.coalesce(F.sum("n").over(so_far), F.lit(0))).where(F.col("__sum") < k).select(*me, FINE)
    hits = search(near)
    # tau of each strategy: the k-th distance found, none if fewer were found
    s = lambda i: F.col(STRATEGY_ID) == (p.strategies[i] if p.strategies[i] is not None else p.schema.base_strategy_id)
    aggs = [x for i in range(len(p.strategies)) for x in (F.max(F.when(s(i), F.col("distance"))).alias(f"__t{i}"), F.count(F.when(s(i), 1)).alias(f"__n{i}"))]
    tau = write_table(hits.groupBy(*tau_keys).agg(*aggs), "cell-tau")
    q = q.join(tau, list(tau_keys), "left")
    limits = []
    for i in range(len(p.strategies)):
        slack = F.abs(F.col(f"__t{i}")) * F.lit(ROUNDING) + F.lit(0.0 if tie_decimals is None else 2.0 * 10.0 ** -tie_decimals)
        limits.append(F.when(F.col(f"__n{i}") >= k, F.col(f"__t{i}") + slack).otherwise(F.lit(float("inf"))).alias(f"__lim{i}"))
    q = q.select(*values, "__b", *limits)
    # pass 2: every cell that may hold an item as near
    some = lambda test: _any([test(i) for i in range(len(p.strategies))])
    q = q.select(*values, *[f"__lim{i}" for i in range(len(limits))],
                 F.explode(F.transform(F.filter("__b", lambda x: some(lambda i: x[f"b{i}"] <= F.col(f"__lim{i}"))), lambda x: x["c"])).alias("c"))
    return down(q).where(some(lambda i: under(i) <= F.col(f"__lim{i}"))).select(*me, FINE)


def worthwhile(found: DataFrame, cells: DataFrame, p: Plan, asked: int, per_part: float) -> bool:
    """Is visiting these cells cheaper than comparing the ``asked`` queries with everything?"""
    n = found.join(cells, [*p.keys, FINE]).agg(F.sum(F.col("n") + VISIT).alias("n")).first()[0]
    return (n or 0) < 0.5 * asked * per_part


def _any(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


# ------------------------------------------------------------------ distinct codes
IDS = "__ids"


def repeated_codes(schema: Schema, index: DataFrame, used: Sequence) -> bool:
    """Do most items share their partition and codes with another one?  Vectors are not asked."""
    if any(not e.coded and e.type != "numeric" for e in used) or not used:
        return False
    n = index.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*schema.filter_fields, CODES)).alias("d")).first()
    return bool(n["n"]) and n["d"] * 2 < n["n"]


def few_of_a_code(index: DataFrame, schema: Schema, k: int) -> DataFrame:
    """The index with the k smallest ids of each partition and codes: of equally far items the
    smallest ids are nearest, so these hold the k nearest of any query."""
    w = Window.partitionBy(*schema.filter_fields, CODES).orderBy(ITEM_ID)
    return index.select(ITEM_ID, *schema.filter_fields, CODES).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def distinct_codes(index: DataFrame, schema: Schema, k: int) -> DataFrame:
    """One item for each partition and codes, under its smallest id, with the k smallest ids
    (``__ids``).  All items of a combination are equally far from any query, and of equally far
    items the smallest ids are nearest, so the k nearest combinations and these ids hold the k
    nearest items.  A combination of most items is cut to k ids in each task first."""
    w = Window.partitionBy(*schema.filter_fields, CODES).orderBy(ITEM_ID)
    few = index.select(ITEM_ID, *schema.filter_fields, CODES).withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k)
    out = few.groupBy(*schema.filter_fields, CODES).agg(F.sort_array(F.collect_list(ITEM_ID)).alias(IDS))
    return out.withColumn(ITEM_ID, F.get(IDS, 0))
