"""Graph search (Q-6, UDF-3): a neighbour graph over the items, walked best first.

**Building** is NN-descent.  Random hyperplanes cut the items into leaves of about ``LEAF``, anew
for each of ``DEALS`` deals; an item starts with the nearest of its leaves.  Then, round
by round, the neighbours of an item (its own list and some of the items that list it) are compared
with each other, as near items tend to have near neighbours in common.  Only pairs with at least
one entry that is new since the last round are compared.  The leaves of the first deal are the
tiles: an item's number tells its tile, the lists of a tile's items are compared in one task, which
is sent each vector that they name once and emits for each item no more than the ``m`` nearest,
and those only if they are nearer than the item's present last neighbour.  Building stops when a
round replaces less than ``delta`` of the entries.

The graph holds an item's ``m`` neighbours, at most ``m`` items that list it (the nearest), and
``LINKS`` random items of each of ``DEALS`` random lists, which join parts of the graph that no neighbour
list joins: at most ``2 m + DEALS * LINKS`` ids a row.  Distances are Euclidean over the weighted vectors; for cosine over
their directions; for ip over the vectors with one more component that gives all the same norm,
which orders them as the dot product does.

**Walking** keeps a frontier, at most ``ef`` items a query.  A round sends each query to the tiles
(``WALKED`` of the building's together) of its ``ef / 2`` nearest items that it has not opened and of the items
that opened ones lead to.  A task scores by the search's own distance and walks on, best first, as
far as links stay in its tile; links out of it are followed from the second round on, of items
that are still among the ``ef`` nearest.  An item that once fell
out of the frontier cannot come back, so the frontier is all that a walk has to remember.  The
walk ends when every item of every frontier is open.

All joins are on an item, a tile or a query, so a hot partition is many keys.  Every table is written under
the checkpoint folder and the round before is removed.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import encoders as X
from ..schema import Schema
from ..session import remove_folder, scratch_path, ship_package, write_table
from .encode import CODES, ITEM_ID, vector_from_codes

M = 16            # neighbours of an item
LINKS = 2         # random items of each list it began in that an item is also joined to
ENTRIES = 64      # items of a partition that every walk starts from
DELTA = 0.01      # a round that replaces a smaller share of the neighbours is the last
DEALS = 3         # leaves and random lists that every item begins in: with one, no list would lead out of itself
LEAF = 4096       # items of a leaf, about
WALKED = 8        # tiles of the building that are one of the walk
PLANES = 1 << 22  # numbers of the vectors that hyperplanes are drawn from, at most (they decide leaves only)
OPENED = 32       # items of a query's frontier that are opened at once
ASKED = 128       # queries of a task that walk at once
NODE, FAR, NUMBER, TILE = "__node", "__d", "__id", "__tile"


@dataclass
class Graph:
    """``links``: node, its number and the numbers it leads to; ``entries``: partition and the
    numbers to start from; ``keys``: the partition columns that no link crosses;
    ``numbers``: every node and its number."""
    links: DataFrame
    entries: DataFrame
    keys: list[str]
    strategy: str | None
    numbers: DataFrame


def _node(schema: Schema):
    return F.struct(*[F.col(f"`{c}`") for c in [*schema.filter_fields, ITEM_ID]])


def _part(keys: Sequence[str]):
    return F.struct(*[F.col(f"{NODE}.`{c}`") for c in keys], F.lit(0).alias("__any"))


def vectors(index: DataFrame, schema: Schema, strategy=None, weights=None, metric: str = "l2") -> DataFrame:
    """``__node, __v``: one row for each item and partition, its vector as floats."""
    v = vector_from_codes(schema, strategy, weights).cast("array<double>")
    df = index.select(_node(schema).alias(NODE), v.alias("__v")).groupBy(NODE).agg(F.min("__v").alias("__v"))
    norm = F.sqrt(X.sqnorm(F.col("__v")))
    if metric == "cosine":
        df = df.withColumn("__v", F.when(norm > 0, F.transform("__v", lambda x: x / norm)).otherwise(F.col("__v")))
    elif metric == "ip":
        most = df.agg(F.max(X.sqnorm(F.col("__v")))).first()[0] or 0.0
        rest = F.sqrt(F.greatest(F.lit(float(most)) - X.sqnorm(F.col("__v")), F.lit(0.0)))
        df = df.withColumn("__v", F.concat("__v", F.array(rest)))
    return df.withColumn("__v", F.col("__v").cast("array<float>"))


# ------------------------------------------------------------------ leaves and numbers
def _planes(x: np.ndarray, depth: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """A tree of hyperplanes that halve the vectors: (normals, thresholds), node by node and level by level."""
    w, t = np.zeros(((1 << depth) - 1, x.shape[1])), np.zeros((1 << depth) - 1)
    parts = [np.arange(len(x))]
    for node in range(len(w)):
        at = parts[node]
        if len(at) > 1:
            a, b = rng.choice(at, 2, replace=False)
            w[node] = x[a] - x[b]
            far = x[at] @ w[node]
            t[node] = np.median(far)
            right = far > t[node]
            parts += [at[~right], at[right]]
        else:
            parts += [at, at[:0]]
    return w, t


def _paths(spark, trees, depth: int):
    """Per vector, the leaf of every tree."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(trees)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in it:
            x = np.asarray(a.flatten(), dtype=float).reshape(len(a), -1) if len(a) else np.zeros((0, 1))
            out = np.zeros((len(a), len(shared.value)), np.int32)
            for j, (w, t) in enumerate(shared.value):
                for level in range(depth if len(a) else 0):
                    node = (1 << level) - 1 + out[:, j]
                    out[:, j] = 2 * out[:, j] + (np.einsum("ij,ij->i", x, w[node]) > t[node])
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, max(1, len(shared.value))), pa.int32()), pa.array(out.ravel()))

    return F.arrow_udf(run, "array<int>").asNondeterministic()


def numbered(vec: DataFrame, keys: Sequence[str], m: int, seed: int) -> DataFrame:
    """``__id, __node, __v, __p, __b`` and for every deal ``pack, leaf``, written once.  A leaf holds about ``LEAF``
    items of one partition (one that holds more than twice as many, copies for one, is dealt by
    hash), a pack is a leaf or several small ones.  An item's number is its pack of the first deal
    and its place in it; ``__b`` are the random lists of its partition."""
    spark, part = vec.sparkSession, _part(keys)
    size = F.count(F.lit(1))
    counts = write_table(vec.groupBy(part.alias("__p")).agg(size.alias("__n")), "graph-parts")
    total, most = counts.agg(F.sum("__n"), F.max("__n")).first()
    total, most = total or 0, most or 0
    dim = len(vec.select("__v").first()[0]) if total else 1
    few = max(64, PLANES // max(1, dim))
    depth = int(max(0, min(np.ceil(np.log2(max(1, most) / LEAF)), np.floor(np.log2(few / 32)))))
    some = np.zeros((0, dim))
    if depth:
        few = min(few, 64 << depth)
        some = vec.filter(F.pmod(F.xxhash64(NODE, F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, few / total))).select("__v").toArrow()
        some = np.asarray(some.column(0).combine_chunks().flatten(), float).reshape(-1, dim)
    trees = [_planes(some, depth, np.random.default_rng((seed, j))) for j in range(DEALS)]
    levels = F.least(F.lit(depth), F.greatest(F.lit(0), F.ceil(F.log2(F.col("__n") / F.lit(float(LEAF)))).cast("int")))
    df = vec.withColumn("__p", part).join(counts, "__p").withColumn("__at", _paths(spark, trees, depth)(F.col("__v").cast("array<double>")))
    df = df.withColumn("__at", F.transform("__at", lambda x: F.call_function("shiftright", x, F.lit(depth) - levels)))
    df = write_table(df.select(NODE, "__v", "__p", "__at", F.ceil(F.col("__n") / F.lit(2 * m)).alias("__b")), "graph-leaves")
    each = df.select("__p", F.posexplode("__at").alias("deal", "cell")).groupBy("deal", "__p", "cell").agg(size.alias("__n"))
    each = each.withColumn("__parts", F.ceil(F.col("__n") / F.lit(2 * LEAF)))
    each = each.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__parts") - 1)))
    by = Window.orderBy("deal", "__p", "cell", "part")
    before = F.coalesce(F.sum(F.col("__n") / F.col("__parts")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    packed = each.withColumn("pack", F.floor(before / F.lit(LEAF))).withColumn("leaf", F.row_number().over(by))
    packed = packed.withColumn("pack", F.dense_rank().over(Window.orderBy("deal", "pack")).cast("bigint"))
    cells = write_table(packed.groupBy("deal", "__p", "cell").agg(F.array_sort(F.collect_list(F.struct("part", "pack", "leaf"))).alias("__to")), "graph-packs")
    for j in range(DEALS):
        to = cells.filter(F.col("deal") == j).select("__p", F.col("cell").alias(f"__c{j}"), F.col("__to").alias(f"__t{j}"))
        df = df.withColumn(f"__c{j}", F.get("__at", j)).join(to, ["__p", f"__c{j}"])
        one = F.get(f"__t{j}", F.pmod(F.xxhash64(NODE, F.lit(j)), F.size(f"__t{j}")).cast("int"))
        df = df.withColumn(f"pack{j}", one.getField("pack")).withColumn(f"leaf{j}", one.getField("leaf")).drop(f"__c{j}", f"__t{j}")
    place = F.row_number().over(Window.partitionBy("pack0").orderBy("leaf0", NODE))
    number = F.shiftleft(F.col("pack0"), 32) + place
    return write_table(df.select(number.alias(NUMBER), NODE, "__v", "__p", "__b", *[F.struct(F.col(f"pack{j}").alias("pack"), F.col(f"leaf{j}").alias("leaf")).alias(f"__l{j}") for j in range(DEALS)]), "graph-nodes")


def _tile(number="a"):
    return F.shiftright(F.col(number), 32)


# ------------------------------------------------------------------ arrays of a task
EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField(FAR, T.DoubleType()), T.StructField("new", T.BooleanType())])


def _column(t: pa.Table, name: str, kind=np.int64) -> np.ndarray:
    return np.asarray(t.column(name).to_numpy(), dtype=kind)


def _vectors_of(t: pa.Table) -> np.ndarray:
    v = t.column("__v").combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return np.asarray(v.flatten(), dtype=float).reshape(t.num_rows, -1)


def _edges(a, b, d, new) -> pa.Table:
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(d, pa.float64()), pa.array(new, pa.bool_())], names=EDGE.names)


def _best(a, b, d, new, m: int):
    """Each pair once (its smaller distance, new if it never is old), and of each ``a`` the ``m`` nearest."""
    order = np.lexsort((d, b, a))
    a, b, d, new = a[order], b[order], d[order], new[order]
    if not len(a):
        return a, b, d, new
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b, d, new = a[first], b[first], d[first], np.logical_and.reduceat(new, first)
    order = np.lexsort((b, d, a))
    a, b, d, new = a[order], b[order], d[order], new[order]
    keep = _place(a) < m
    return a[keep], b[keep], d[keep], new[keep]


def _place(a) -> np.ndarray:
    """The place of a row among those of its (sorted) value."""
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    return np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)]))


def _merge(m: int):
    def run(t: pa.Table) -> pa.Table:
        return _edges(*_best(_column(t, "a"), _column(t, "b"), _column(t, FAR, float), _column(t, "new", bool), m))
    return run


def _within_leaves(m: int):
    """All pairs of a leaf: for each item the ``m`` nearest others."""
    def run(t: pa.Table) -> pa.Table:
        ids, leaf, x, out = _column(t, NUMBER), _column(t, "leaf"), _vectors_of(t), []
        for one in np.unique(leaf):
            at = np.flatnonzero(leaf == one)
            n, p, who = min(m, len(at) - 1), x[at], ids[at]
            if n < 1:
                continue
            sq = (p * p).sum(axis=1)
            for lo in range(0, len(at), 256):
                d = sq[lo:lo + 256, None] + sq[None, :] - 2.0 * (p[lo:lo + 256] @ p.T)
                d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
                near = np.argpartition(d, n - 1, axis=1)[:, :n]
                far = np.maximum(np.take_along_axis(d, near, axis=1), 0.0)
                out.append((np.repeat(who[lo:lo + 256], n), who[near].ravel(), far.ravel()))
        a, b, d = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, int) for c in range(3))
        return _edges(a, b, d, np.ones(len(a), bool))
    return run


LIST = T.StructType([T.StructField(TILE, T.LongType()), T.StructField("c", T.LongType()), T.StructField(NUMBER, T.LongType()), T.StructField("new", T.BooleanType())])


def _mixed(x, seed: int) -> np.ndarray:
    """Numbers in an order of their own."""
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _around(m: int, seed: int):
    """What is compared around an item: its own list, and as many of the items that list it (new ones first)."""
    def run(t: pa.Table) -> pa.Table:
        c, i, new, back = _column(t, "c"), _column(t, NUMBER), _column(t, "new", bool), _column(t, "back", bool)
        at = np.flatnonzero(back)
        at = at[np.lexsort((_mixed(i[at], seed), ~new[at], c[at]))]
        at = np.r_[np.flatnonzero(~back), at[_place(c[at]) < m]]
        c, i, new = c[at], i[at], new[at]
        order = np.lexsort((i, c))
        c, i, new = c[order], i[order], new[order]
        first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (i[1:] != i[:-1])])
        return pa.table([pa.array(c[first] >> 32), pa.array(c[first]), pa.array(i[first]), pa.array(np.logical_or.reduceat(new, first))], names=LIST.names)
    return run


def _compared(m: int):
    """Lists of a tile and the vectors that they name: the ``m`` nearest of every item among the
    pairs of a list that have a new entry, if below the item's limit."""
    def run(lists: pa.Table, named: pa.Table) -> pa.Table:
        none = _edges([], [], [], [])
        if not lists.num_rows or not named.num_rows:
            return none
        ids, x, tau = _column(named, "__right1"), _vectors_of(named), _column(named, "tau", float)
        order = np.argsort(ids)
        ids, x, tau = ids[order], x[order], tau[order]
        sq = (x * x).sum(axis=1)
        c, at, new = _column(lists, "c"), np.searchsorted(ids, _column(lists, NUMBER)), _column(lists, "new", bool)
        order = np.argsort(c, kind="stable")
        c, at, new = c[order], at[order], new[order]
        place, row = _place(c), np.cumsum(np.r_[False, c[1:] != c[:-1]])
        wide, out = int(place.max()) + 1, []
        if wide < 2:
            return none
        full, fresh = np.full((row[-1] + 1, wide), -1), np.zeros((row[-1] + 1, wide), bool)
        full[row, place], fresh[row, place] = at, new
        step = max(1, (1 << 19) // (wide * max(wide, x.shape[1])))
        own = np.eye(wide, dtype=bool)
        for lo in range(0, len(full), step):
            i, f = full[lo:lo + step], fresh[lo:lo + step]
            p = x[i]
            d = sq[i][:, :, None] + sq[i][:, None, :] - 2.0 * (p @ p.transpose(0, 2, 1))
            np.maximum(d, 0.0, out=d)
            fit = (f[:, :, None] | f[:, None, :]) & (i >= 0)[:, :, None] & (i >= 0)[:, None, :] & ~own & (d < tau[i][:, :, None])
            r, left, right = np.nonzero(fit)
            out.append((ids[i[r, left]], ids[i[r, right]], d[r, left, right]))
        a, b, d = (np.concatenate([o[k] for o in out]) for k in range(3))
        return _edges(*_best(a, b, d, np.ones(len(a), bool), m))
    return run


def _grouped(df: DataFrame, by, run, schema) -> DataFrame:
    """``run`` over the rows of each tile, dealt out so that adaptive execution does not merge them."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.withColumn("__by", by).repartition(n, "__by").groupBy("__by").applyInArrow(run, schema)


def _descent(nodes: DataFrame, far: DataFrame, m: int, delta: float, seed: int) -> DataFrame:
    """NN-descent over the numbers: ``a, b, __d`` with the ``m`` nearest found of every item."""
    from .tiles import _together
    spark = nodes.sparkSession
    ship_package(spark)
    path, folder = None, scratch_path(spark, "graph-edges")
    leaves = nodes.select(NUMBER, "__v", F.explode(F.array(*[f"__l{j}" for j in range(DEALS)])).alias("__l")).select(NUMBER, "__v", "__l.pack", "__l.leaf")
    _grouped(_grouped(leaves, F.col("pack"), _within_leaves(m), EDGE), _tile(), _merge(m), EDGE).write.parquet(folder)
    total, n = nodes.count(), 2 * spark.sparkContext.defaultParallelism
    # in the first round an item also meets the random items that it is joined to
    extra = far.select(F.col("a").alias("c"), F.col("b").alias(NUMBER)).unionByName(nodes.select(F.col(NUMBER).alias("c"), NUMBER))
    while True:
        edges = spark.read.schema(EDGE).parquet(folder)
        if path:
            remove_folder(spark, path)
        if edges.filter("new").count() <= delta * total * m:
            return edges.drop("new")
        own = edges.select(F.col("a").alias("c"), F.col("b").alias(NUMBER), "new", F.lit(False).alias("back"))
        own = own.unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias(NUMBER), "new", F.lit(True).alias("back")))
        if extra is not None:
            own, extra = own.unionByName(extra.select("c", NUMBER, F.lit(True).alias("new"), F.lit(False).alias("back"))), None
        lists = write_table(_grouped(own, _tile("c"), _around(m, seed), LIST), "graph-lists")
        last = edges.groupBy("a").agg(F.max(FAR).alias("far"), F.count(F.lit(1)).alias("n"))
        tau = F.when(F.col("n") >= m, F.col("far")).otherwise(F.lit(float("inf")))
        known = nodes.select(NUMBER, "__v").join(last.select(F.col("a").alias(NUMBER), tau.alias("tau")), NUMBER, "left")
        named = lists.select(TILE, NUMBER).distinct().join(known.withColumn("tau", F.coalesce("tau", F.lit(float("inf")))), NUMBER)
        found = _together(lists, named.withColumn("__right1", F.col(NUMBER)).drop(NUMBER), n, [TILE], _compared(m), EDGE)
        path, folder = folder, scratch_path(spark, "graph-edges")
        _grouped(found.unionByName(edges.withColumn("new", F.lit(False))), _tile(), _merge(m), EDGE).write.parquet(folder)


def _far_links(nodes: DataFrame, seed: int) -> DataFrame:
    """``a, b``: the next items, by another hash, of each random list that an item is dealt to."""
    some = nodes.select(NUMBER, NODE, "__p", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"), "__b")
    some = some.withColumn("__at", F.struct("__p", "deal", F.pmod(F.xxhash64(NODE, "deal", F.lit(seed)), F.col("__b")).alias("b")))
    w = Window.partitionBy("__at").orderBy(F.xxhash64(NODE, F.lit(seed + 1)), NODE)
    far = some.select(F.col(NUMBER).alias("a"), F.array(*[F.lead(NUMBER, i).over(w) for i in range(1, LINKS + 1)]).alias("b"))
    return write_table(far.select("a", F.explode("b").alias("b")).filter(F.col("b").isNotNull()), "graph-far")


def neighbours(vec: DataFrame, keys: Sequence[str], m: int = M, delta: float = DELTA, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """NN-descent: (edges ``a, b, __d`` with the ``m`` nearest found of every node, the random
    links ``a, b``), by node.  ``vec`` is a written table of ``__node, __v``."""
    nodes = numbered(vec, keys, m, seed)
    far = _far_links(nodes, seed)

    def named(df):
        for c in ("a", "b"):
            df = df.join(nodes.select(F.col(NUMBER).alias(c), F.col(NODE).alias(f"__{c}")), c).drop(c).withColumnRenamed(f"__{c}", c)
        return df

    return named(_descent(nodes, far, m, delta, seed)).select("a", "b", FAR), named(far).select("a", "b")


def _links(m: int):
    """An item's list, the ``m`` nearest items that list it, and its random items, each once."""
    def run(t: pa.Table) -> pa.Table:
        a, b, d, kind = _column(t, "a"), _column(t, "b"), _column(t, FAR, float), _column(t, "kind")
        at = np.flatnonzero(kind == 1)
        at = at[np.lexsort((b[at], d[at], a[at]))]
        at = np.r_[np.flatnonzero(kind != 1), at[_place(a[at]) < m]]
        at = at[np.lexsort((b[at], a[at]))]
        a, b = a[at], b[at]
        once = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        a, b = a[once], b[once]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        return pa.table([pa.array(a[first]), pa.ListArray.from_arrays(pa.array(np.r_[first, len(a)], pa.int32()), pa.array(b))], names=[NUMBER, "links"])
    return run


def build_graph(index: DataFrame, schema: Schema, m: int = M, strategy=None, weights=None, metric: str | None = None,
                restrict_partition: bool = True, delta: float = DELTA, seed: int = 17) -> Graph:
    """The graph of an index under one weight set; with ``restrict_partition`` no link leaves a
    partition.  Items that share id and partition are one node."""
    keys = list(schema.filter_fields) if restrict_partition else []
    vec = write_table(vectors(index, schema, strategy, weights, metric or schema.metric), "graph-vectors")
    nodes = numbered(vec, keys, m, seed)
    far = _far_links(nodes, seed)
    edges = _descent(nodes, far, m, delta, seed)
    rows = edges.select("a", "b", FAR, F.lit(0).alias("kind")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), FAR, F.lit(1).alias("kind")))
    rows = rows.unionByName(far.select("a", "b", F.lit(0.0).alias(FAR), F.lit(2).alias("kind")))
    links = _grouped(rows, _tile(), _links(m), f"{NUMBER} long, links array<long>").join(nodes.select(NUMBER, NODE), NUMBER)
    at = Window.partitionBy("__p").orderBy(F.xxhash64(NODE, F.lit(seed + 2)), NODE)
    start = nodes.select(NUMBER, NODE, "__p").withColumn("__r", F.row_number().over(at)).filter(F.col("__r") <= ENTRIES)
    start = start.groupBy("__p").agg(F.collect_list(NUMBER).alias("links"))
    return Graph(write_table(links, "graph-links"), write_table(start, "graph-entries"), keys, strategy, write_table(nodes.select(NUMBER, NODE), "graph-numbers"))


# ------------------------------------------------------------------ walks
FRONT = "__q long, __tile long, visit boolean, tau double, ids array<long>, far array<double>, open array<boolean>, led array<boolean>"


def _lists_of(values, count, kind):
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(count)], pa.int32()), pa.array(values, kind))


def _flat(t: pa.Table):
    """(row, ids, distances, open, led) of the lists of a table of fronts; an item without a distance is not scored yet."""
    lists = [t.column(c).combine_chunks() for c in ("ids", "far", "open", "led")]
    count = np.asarray(pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False), np.int64) if t.num_rows else np.zeros(0, np.int64)
    return (np.repeat(np.arange(t.num_rows), count), *[np.asarray(x.flatten().to_numpy(zero_copy_only=False), k) for x, k in zip(lists, (np.int64, float, bool, bool))])


def _fronts(q, tile, visit, tau, row, ids, far, opened, led) -> pa.Table:
    """Rows whose lists are cut by ``row`` (sorted)."""
    count = np.bincount(row, minlength=len(q))
    return pa.table([pa.array(q, pa.int64()), pa.array(tile, pa.int64()), pa.array(visit, pa.bool_()), pa.array(tau, pa.float64()), _lists_of(ids, count, pa.int64()),
                     _lists_of(far, count, pa.float64()), _lists_of(opened, count, pa.bool_()), _lists_of(led, count, pa.bool_())], names=["__q", TILE, "visit", "tau", "ids", "far", "open", "led"])


def _shift() -> int:
    """What makes the tile of a walk of an item's number."""
    return 32 + WALKED.bit_length() - 1


def _gathered(ef: int, shift: int):
    """What the tiles found, query by query: the ``ef`` nearest, and the tiles to visit next."""
    def run(t: pa.Table) -> pa.Table:
        row, ids, far, opened, led = _flat(t)
        q = _column(t, "__q")[row]
        # once a query: open if opened anywhere, scored if scored anywhere (no distance sorts last)
        order = np.lexsort((far, ids, q))
        q, ids, far, opened, led = (x[order] for x in (q, ids, far, opened, led))
        first = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1])])
        opened, led = (np.logical_or.reduceat(x, first) for x in (opened, led))
        q, ids, far = q[first], ids[first], far[first]
        order = np.lexsort((ids, far, q))
        q, ids, far, opened, led = (x[order] for x in (q, ids, far, opened, led))
        place, scored = _place(q), ~np.isnan(far)
        keep = ~scored | (place < ef)
        names, at = np.unique(q, return_inverse=True)
        tau = np.full(len(names), np.inf)
        last = scored & (place == ef - 1)
        tau[at[last]] = far[last]
        ask, nearest = ~scored, np.zeros(len(q), bool)
        wait = np.flatnonzero(scored & keep & ~opened)
        nearest[wait[_place(q[wait]) < max(1, ef // 2)]] = True
        visit = ask | nearest | (scored & keep & opened & ~led)
        at, ids, far, opened, led, visit = (x[keep] for x in (at, ids, far, opened, led, visit))
        tile = ids >> shift
        order = np.lexsort((ids, tile, at))
        at, ids, far, opened, led, visit, tile = (x[order] for x in (at, ids, far, opened, led, visit, tile))
        new = np.r_[True, (at[1:] != at[:-1]) | (tile[1:] != tile[:-1])]
        first = np.flatnonzero(new)
        return _fronts(names[at[first]], tile[first], np.logical_or.reduceat(visit, first), tau[at[first]], np.cumsum(new) - 1, ids, far, opened, led)
    return run


def _walked(sp, ef: int, follow: bool):
    """Queries at a tile: scores what they ask for, opens what is near enough, best first, as long as
    that leads to nearer items of the tile; with ``follow`` also tells where the links lead out."""
    from . import tiles

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _fronts([], [], [], [], np.zeros(0, int), [], [], [], [])
        right = right.sort_by(NUMBER)
        it, ids = tiles.Items(right, sp), _column(right, NUMBER)
        inn = tiles._item_norms(it, sp, 0) if sp.metric == "cosine" else None
        links = right.column("links").combine_chunks()
        count = np.asarray(pc.fill_null(pc.list_value_length(links), 0).to_numpy(zero_copy_only=False), np.int64)
        to = np.asarray(links.flatten().to_numpy(zero_copy_only=False), np.int64)
        begin = np.cumsum(count) - count
        inside = np.searchsorted(ids, to)
        inside[inside == len(ids)] = 0
        inside = np.where(ids[inside] == to, inside, -1)
        return pa.concat_tables([one(left.slice(lo, ASKED), it, ids, inn, begin, count, to, inside) for lo in range(0, left.num_rows, ASKED)])

    def one(t, it, ids, inn, begin, count, to, inside):
        q = tiles.Queries(t, sp)
        qn = q.norms(sp, 0) if sp.metric == "cosine" else None
        tau = _column(t, "tau", float)
        row, who, far, opened, led = _flat(t)
        at, far = np.searchsorted(ids, who), far.copy()
        ask = np.flatnonzero(np.isnan(far))
        far[ask] = tiles._pairs(q, it, sp, 0, row[ask], at[ask], qn, inn)
        seen = np.zeros((q.n, it.n), bool)
        seen[row, at] = True
        while True:
            order = np.lexsort((far, row))
            row, at, far, opened, led = (x[order] for x in (row, at, far, opened, led))
            place = _place(row)
            bound = tau.copy()
            last = place == ef - 1
            bound[row[last]] = np.minimum(bound[row[last]], far[last])
            keep = (place < ef) & (far <= bound[row])
            row, at, far, opened, led = (x[keep] for x in (row, at, far, opened, led))
            wait = np.flatnonzero(~opened)
            now = wait[_place(row[wait]) < OPENED]
            if not len(now):
                break
            opened[now] = True
            n = count[at[now]]
            qi, ii = np.repeat(row[now], n), inside[tiles._ragged(begin[at[now]], n)]
            key = np.unique(qi[ii >= 0] * it.n + ii[ii >= 0])
            qi, ii = np.divmod(key, it.n)
            fresh = ~seen[qi, ii]
            qi, ii = qi[fresh], ii[fresh]
            seen[qi, ii] = True
            d = tiles._pairs(q, it, sp, 0, qi, ii, qn, inn)
            near = d <= bound[qi]
            none = np.zeros(near.sum(), bool)
            row, at, far, opened, led = np.r_[row, qi[near]], np.r_[at, ii[near]], np.r_[far, d[near]], np.r_[opened, none], np.r_[led, none]
        who = ids[at]
        if follow:
            out = np.flatnonzero(~led)
            n = count[at[out]]
            edge = tiles._ragged(begin[at[out]], n)
            qi, away = np.repeat(row[out], n), inside[edge] < 0
            qi, b = qi[away], to[edge][away]
            order = np.lexsort((b, qi))
            qi, b = qi[order], b[order]
            once = np.r_[True, (qi[1:] != qi[:-1]) | (b[1:] != b[:-1])] if len(qi) else np.zeros(0, bool)
            qi, b, no = qi[once], b[once], np.zeros(once.sum(), bool)
            row, who, far, opened, led = np.r_[row, qi], np.r_[who, b], np.r_[far, np.full(len(qi), np.nan)], np.r_[opened, no], np.r_[np.ones(len(led), bool), no]
            order = np.argsort(row, kind="stable")
            row, who, far, opened, led = (x[order] for x in (row, who, far, opened, led))
        numbers = _column(t, "__q")
        return _fronts(numbers, np.zeros(q.n, np.int64), np.zeros(q.n, bool), tau, row, who, far, opened, led)

    return run


def placed(index: DataFrame, schema: Schema, graph: Graph) -> DataFrame:
    """The items as walks read them: number, tile, links and codes."""
    from .tiles import _code_columns
    coded = index.select(_node(schema).alias(NODE), CODES).dropDuplicates([NODE])
    items = coded.join(graph.numbers, NODE).join(graph.links.select(NUMBER, "links"), NUMBER, "left")
    tile = F.shiftright(F.col(NUMBER), _shift())
    return write_table(items.select(NUMBER, tile.alias(TILE), F.col(f"{NODE}.{ITEM_ID}").alias(ITEM_ID), "links", *_code_columns(schema)), "graph-items")


def walk(queries: DataFrame, items: DataFrame, schema: Schema, graph: Graph, ef: int, weights=None, metric: str = "l2") -> DataFrame:
    """``query_id, <partition>, __node``: the ``ef`` items that each query's walk ends with.
    ``items`` is what ``placed`` gives."""
    from . import tiles
    from .knn import QUERY_ID
    spark, ask = queries.sparkSession, [QUERY_ID, *graph.keys]
    ship_package(spark)
    sp = tiles.spec(schema, ef, [graph.strategy], weights, metric, None, False, False)
    asked = write_table(queries.select(F.monotonically_increasing_id().alias("__q"), *ask, *tiles._query_columns(schema)), "graph-asked")
    reps = [c for c in asked.columns if c not in ask]
    cores = spark.sparkContext.defaultParallelism
    n = asked.count()
    parts = max(1, items.select(TILE).distinct().count())
    tile = F.shiftright(F.col(NUMBER), _shift())
    start = asked.select("__q", F.struct(*graph.keys, F.lit(0).alias("__any")).alias("__p")).join(graph.entries, "__p")
    start = start.select("__q", F.explode("links").alias(NUMBER)).groupBy("__q", tile.alias(TILE)).agg(F.collect_list(NUMBER).alias("ids"))
    each = lambda v: F.transform("ids", lambda _: F.lit(v))
    start = start.select("__q", TILE, F.lit(True).alias("visit"), F.lit(float("inf")).alias("tau"), "ids", each(float("nan")).alias("far"), each(False).alias("open"), each(False).alias("led"))
    folder, before, first = scratch_path(spark, "graph-front"), None, True
    start.write.parquet(folder)
    while True:
        front = spark.read.schema(FRONT).parquet(folder)
        if before:
            remove_folder(spark, before)
        active = front.filter("visit").select("__q").distinct().count()
        if not active:
            break
        blocks = max(-(-active // tiles.BLOCK), min(-(-active // ASKED), -(-8 * cores // parts)))
        there = items.withColumn(tiles.BLK, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        going = front.filter("visit").join(asked.select(*reps), "__q").withColumn(tiles.BLK, F.pmod(F.xxhash64("__q"), F.lit(blocks)).cast("int"))
        found = tiles._together(going, there, tiles._width(spark, blocks * parts), [TILE, tiles.BLK], _walked(sp, ef, not first), FRONT)
        before, folder, first = folder, scratch_path(spark, "graph-front"), False
        every = found.unionByName(front.filter(~F.col("visit")))
        _grouped(every, F.pmod(F.xxhash64("__q"), F.lit(max(2 * cores, -(-n // 4096)))), _gathered(ef, _shift()), FRONT).write.parquet(folder)
    ends = front.select("__q", F.explode("ids").alias(NUMBER)).join(graph.numbers, NUMBER).join(asked.select("__q", *ask), "__q")
    return ends.select(*ask, NODE)


def graph_pairs(queries: DataFrame, index: DataFrame, schema: Schema, graphs: Sequence[Graph], items: Sequence[DataFrame], ef: int, weights=None,
                metric: str = "l2") -> DataFrame:
    """query x item rows that the walks end with (one walk a graph), each pair once, with the
    columns that scoring reads."""
    from .knn import QUERY_ID
    keys = graphs[0].keys
    ask = [QUERY_ID, *keys]
    if not keys:
        queries = queries.drop(*schema.filter_fields).dropDuplicates([QUERY_ID])
    met = None
    for g, there in zip(graphs, items):
        one = walk(queries, there, schema, g, ef, weights, metric)
        met = one if met is None else met.unionByName(one)
    met = met.distinct().withColumns({c: F.col(f"{NODE}.`{c}`") for c in [*schema.filter_fields, ITEM_ID] if c not in keys})
    return met.drop(NODE).join(index, [*schema.filter_fields, ITEM_ID]).join(queries, ask)


def measured_ef(queries: DataFrame, index: DataFrame, schema: Schema, graphs: Sequence[Graph], items: Sequence[DataFrame], k: int, top, recall: float,
                sample: int, weights=None, metric: str = "l2", exact=None) -> int:
    """The smallest of ``4 k, 8 k, 16 k ...`` whose walks find ``recall`` of the exact hits: on all
    queries if there are at most ``sample``, else on that many (by id hash).  ``top`` ranks pairs,
    ``exact`` gives a query table's exact hits.  Ends at the latest when a walk holds all items."""
    from .knn import QUERY_ID
    few = queries.select(QUERY_ID).distinct().orderBy(F.xxhash64(QUERY_ID), QUERY_ID).limit(sample)
    few = write_table(queries.join(F.broadcast(few), QUERY_ID, "left_semi"), "graph-sampled")
    true = write_table(exact(few), "graph-exact")
    same = [c for c in true.columns if c in (QUERY_ID, "strategy_id", ITEM_ID, *schema.filter_fields)]
    total, most, ef = true.count(), index.count(), 4 * k
    while ef < most:
        found = top(graph_pairs(few, index, schema, graphs, items, ef, weights, metric)).select(*same)
        if found.join(true.select(*same), same, "left_semi").count() >= recall * total:
            break
        ef *= 2
    return ef
