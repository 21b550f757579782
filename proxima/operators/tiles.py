"""Exact search of items in tiles: the pairs of a kNN join, compared inside tasks (JN-1, DST-1..4, TOP-1).

The items of every join key (partition, list or bucket) are dealt into tiles of about ``TILE``
items, the queries that visit a tile into blocks of at most ``BLOCK`` rows.  A block and a tile
meet in one task (a cogroup on key, tile and block), which keeps the ``k`` nearest items of each
query; a pair is never a row.  So neither a hot key nor a large one lands in one task, nothing is
sorted by pairs, and what leaves a task is bounded by queries x k.

Inside a task the tile is cut into pieces of equal codes and near values, the pieces into short
runs.  What bounds a piece or run (codes, value range) gives lower bounds of the distances to all
its items.  The best runs of the best pieces give a k-th distance; after that the runs of the pieces
whose bound does not exceed it are bounded, and the items of those runs compared.  So a query costs
one bound a piece and little more, however many items the tile has, and tiles without vectors are
``WIDE`` times as large.  Of items with equal codes and values only the k smallest ids are looked
at.  Where the bounds tell little apart, and for vectors, everything is compared.  If the distance is
that of one number (l2), a query's nearest items are those beside its place in their order.

With a cell plan (``operators.cells``) tiles are ranges of its coarse cells.  If a partition has
several tiles, a first pass searches each query's best tiles, a second those whose bound is at
most the k-th distance found.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from copy import copy
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import blocks as B
from ..functions.numeric import GRID_OFFSET
from ..schema import Schema
from ..session import ship_package, write_table
from .encode import CODES, ITEM_ID

TILE = 32_768         # items of a tile with vectors
WIDE = 8              # so many times more without
BLOCK = 16_384        # queries of a block
HITS = 2_000_000      # hits that a task returns at most
RUN = 32              # items of a run
PIECE = 32            # runs of a piece
MAX_GROUPS = 4096     # groups of equal codes in a tile
ROWS, COLUMNS = 256, 2048  # queries and items that are compared at once
PAIRS = 1 << 20       # pairs compared in one step
BOUNDS = 1 << 18      # bounds of pieces in one step, few enough for a processor's cache
DENSE = 0.25          # of all pairs: beyond it they are compared without runs
ROUNDING = 1e-9       # relative error that bounds are widened by
GRP, SUB, BLK, RANK = "__grp", "__sub", "__blk2", "__r"


@dataclass
class Feature:
    name: str
    kind: str             # code, numeric, vector
    c2: list[float]       # squared factor under every strategy
    n: int = 0            # codes, or length
    diag: np.ndarray | None = None


@dataclass
class Spec:
    """What a task knows: plain values only."""
    features: list[Feature]
    strategies: list[str]
    metric: str
    k: int
    tie_decimals: int | None
    exclude_self: bool
    explain: bool
    order: list[int]      # coded features, those whose codes lie furthest apart first


def spec(schema: Schema, k: int, sids: Sequence, weights, metric: str, tie_decimals, exclude_self: bool, explain: bool) -> Spec:
    feats, apart = [], []
    for e in schema.encoders:
        c2 = [0.0 if schema.weights(s, weights)[e.field] == 0 else schema.factor(e.field, s, weights) ** 2 for s in sids]
        if e.coded:
            n = B.n_codes(e)
            diag = np.ones(n) if B.identity(e) else np.array(B.gram_diagonal(e), float)
            if e.type == "strict_onehot":
                diag[0] = 0.0
            apart.append((-B.separation(e) * max(c2), len(feats)))
            feats.append(Feature(e.field, "code", c2, n, diag))
        else:
            feats.append(Feature(e.field, "numeric" if e.type == "numeric" else "vector", c2, max(1, e.length)))
    names = [str(s) if s is not None else schema.base_strategy_id for s in sids]
    return Spec(feats, names, metric, k, tie_decimals, exclude_self, explain, [j for _, j in sorted(apart) if max(feats[j].c2) > 0])


# ------------------------------------------------------------------ arrays of a task
def _one(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _floats(a: pa.Array) -> np.ndarray:
    return np.asarray(a.to_numpy(zero_copy_only=False), dtype=float)


def _matrix(a: pa.Array, n: int) -> np.ndarray:
    return np.asarray(a.flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(len(a), n)


def _dense_map(a: pa.Array, n: int) -> np.ndarray:
    out, off = np.zeros((len(a), n)), a.offsets.to_numpy()
    if len(a):
        rows = np.repeat(np.arange(len(a)), np.diff(off))
        out[rows, a.keys.to_numpy()[off[0]:off[-1]]] = a.items.to_numpy()[off[0]:off[-1]]
    return out


class Items:
    """A tile: codes, values and vectors by feature, ids as ranks in their order (nulls first)."""

    def __init__(self, t: pa.Table, sp: Spec):
        self.n = t.num_rows
        self.x = []
        for j, f in enumerate(sp.features):
            a = _one(t, f"__i{j}") if max(f.c2) > 0 else None
            self.x.append(None if a is None else _matrix(a, f.n) if f.kind == "vector" else _floats(a) if f.kind == "numeric" else np.asarray(a.to_numpy(zero_copy_only=False), dtype=np.int64))
        self.ids = _one(t, ITEM_ID)
        at = pc.sort_indices(self.ids, null_placement="at_start").to_numpy() if self.n else np.zeros(0, int)
        ordered = self.ids.take(pa.array(at))
        new = np.ones(self.n, bool)
        if self.n > 1:
            same = pc.equal(ordered.slice(1), ordered.slice(0, self.n - 1))
            both = pc.and_(pc.is_null(ordered.slice(1)), pc.is_null(ordered.slice(0, self.n - 1)))
            new[1:] = ~np.asarray(pc.if_else(both, True, pc.fill_null(same, False)).to_numpy(zero_copy_only=False), bool)
        self.rank = np.empty(self.n, np.int64)
        self.rank[at] = np.cumsum(new) - 1
        self.first = ordered.filter(pa.array(new)) if self.n else ordered

    def slice(self, lo: int, hi: int) -> Items:
        out = Items.__new__(Items)
        out.x, out.rank = [None if x is None else x[lo:hi] for x in self.x], self.rank[lo:hi]
        out.n = len(out.rank)
        return out

    def runs(self, sp: Spec, i: int) -> Runs | None:
        """Pieces of equal codes of the leading features, ordered by the numeric feature that spreads
        most, and their runs of at most ``RUN`` items; None where they cannot tell items apart."""
        fs = [f for f in sp.features if f.c2[i] > 0]
        if self.n <= 2 * RUN or any(f.kind == "vector" for f in fs):
            return None
        combo, told = np.zeros(self.n, np.int64), []
        for j in sp.order:
            f = sp.features[j]
            if f.c2[i] > 0:
                wider = np.unique(combo * f.n + self.x[j], return_inverse=True)
                if len(wider[0]) <= max(min(self.n // 8, MAX_GROUPS), f.n if not told else 0):
                    combo, told = wider[1].astype(np.int64), [*told, j]
        nums = [j for j, f in enumerate(sp.features) if f.kind == "numeric" and f.c2[i] > 0]
        main = max(nums, key=lambda j: sp.features[j].c2[i] * np.ptp(self.x[j]) ** 2, default=None)
        if not told and main is None:
            return None
        values = [self.x[j] for j in nums if j != main] + ([self.x[main]] if main is not None else []) + [combo]
        order = np.lexsort((self.rank, *values))
        if len(told) + len(nums) == len(fs) and not (sp.exclude_self and len(self.first) < self.n):
            new = np.any([np.r_[True, np.diff(v[order]) != 0] for v in values], axis=0)
            start = np.flatnonzero(new)
            order = order[np.arange(self.n) - np.repeat(start, np.diff(np.r_[start, self.n])) < sp.k + sp.exclude_self]
        starts = np.flatnonzero(np.r_[True, np.diff(combo[order]) != 0])
        line = main if len(fs) == 1 and sp.metric == "l2" and not told else None
        pieces, _ = _cut(starts, np.diff(np.r_[starts, len(order)]), RUN * PIECE)
        runs, of = _cut(pieces, np.diff(np.r_[pieces, len(order)]), RUN)
        out = Runs(self, sp, order, runs, told, nums, main)
        out.line = None if line is None else self.x[line][order]
        out.pieces = Runs(self, sp, order, pieces, told, nums, main)
        out.pieces.runs = of
        out.pieces.at = np.cumsum(of) - of  # the first run of a piece
        return out


def _cut(start, size, most: int):
    """(starts of even parts of at most ``most`` items, parts of each)"""
    n = -(-size // most)
    part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(start, n) + part * np.repeat(size, n) // np.repeat(n, n), n


class Runs:
    """Runs (or pieces) of items with equal codes, as ``bounds`` reads them."""

    def __init__(self, it: Items, sp: Spec, order, at, told, nums, main):
        self.order, self.at, self.size, self.main = order, at, np.diff(np.r_[at, len(order)]), main
        self.code = {j: it.x[j][order[at]] for j in told}
        self.present = {j: np.unique(it.x[j]) for j in sp.order if j not in told and it.x[j] is not None}
        self.range = {j: (np.minimum.reduceat(it.x[j][order], at), np.maximum.reduceat(it.x[j][order], at)) for j in nums}
        self.pivot, self.norm = {}, {}

    def off_line(self) -> Runs:
        """The same, but searched by bounds."""
        out = copy(self)
        out.line = None
        return out

    def enough(self, need: int) -> int:
        """So many runs hold ``need`` items, whichever they are."""
        return min(len(self.size), int(np.searchsorted(np.cumsum(np.sort(self.size)), need)) + 1)


class Queries:
    """A chunk of a query block."""

    def __init__(self, t: pa.Table, sp: Spec):
        self.n, self.s, self.x = t.num_rows, [], []
        for j, f in enumerate(sp.features):
            on = max(f.c2) > 0
            self.s.append(_floats(_one(t, f"__s{j}")) if on and f.kind == "code" else None)
            self.x.append(None if not on else _dense_map(_one(t, f"__g{j}"), f.n) if f.kind == "code"
                          else _floats(_one(t, f"__x{j}")) if f.kind == "numeric" else _matrix(_one(t, f"__x{j}"), f.n))
        # components against every code
        self.a = [None if f.kind != "code" or x is None else np.maximum(s[:, None] - 2 * x + f.diag, 0.0) if sp.metric == "l2" else x
                  for f, s, x in zip(sp.features, self.s, self.x)]

    def norms(self, sp: Spec, i: int) -> np.ndarray:
        out = np.zeros(self.n)
        for f, s, x in zip(sp.features, self.s, self.x):
            if f.c2[i] > 0:
                out = out + f.c2[i] * (s if f.kind == "code" else x * x if f.kind == "numeric" else (x * x).sum(axis=1))
        return out


def _item_norms(it: Items, sp: Spec, i: int) -> np.ndarray:
    out = np.zeros(it.n)
    for f, x in zip(sp.features, it.x):
        if f.c2[i] > 0:
            out = out + f.c2[i] * (f.diag[x] if f.kind == "code" else x * x if f.kind == "numeric" else (x * x).sum(axis=1))
    return out


def _finish(total, qn, inn, metric: str):
    if metric == "l2":
        return total
    if metric == "ip":
        return -total
    den = np.sqrt(qn) * np.sqrt(inn)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(den > 0, 1.0 - total / den, 1.0)


def _parts(q: Queries, it: Items, sp: Spec, i: int, qi, ii) -> list[np.ndarray]:
    """Components of pairs, in the order of the features."""
    out = []
    for j, f in enumerate(sp.features):
        c2, x = f.c2[i], it.x[j]
        if c2 == 0:
            out.append(np.zeros(len(qi)))
        elif f.kind == "code":
            out.append(c2 * q.a[j][qi, x[ii]])
        elif f.kind == "numeric":
            a, b = q.x[j][qi], x[ii]
            out.append(c2 * ((a - b) * (a - b)) if sp.metric == "l2" else c2 * a * b)
        else:
            v = np.empty(len(qi))
            for lo in range(0, len(qi), 1 << 15):
                a, b = q.x[j][qi[lo:lo + (1 << 15)]], x[ii[lo:lo + (1 << 15)]]
                v[lo:lo + (1 << 15)] = ((a - b) ** 2).sum(axis=1) if sp.metric == "l2" else (a * b).sum(axis=1)
            out.append(c2 * v)
    return out


def _total(parts):
    t = parts[0]
    for p in parts[1:]:
        t = t + p
    return t


def _pairs(q, it, sp, i, qi, ii, qn, inn) -> np.ndarray:
    t = _total(_parts(q, it, sp, i, qi, ii))
    return t if sp.metric == "l2" else -t if sp.metric == "ip" else _finish(t, qn[qi], inn[ii], "cosine")


def _all_pairs(q: Queries, it: Items, sp: Spec, i: int, qn, inn) -> tuple[np.ndarray, np.ndarray | float]:
    """(queries x items) distances, and by how much products of vectors may be off."""
    total, off = np.zeros((q.n, it.n)), 0.0
    for j, f in enumerate(sp.features):
        c2, x = f.c2[i], it.x[j]
        if c2 == 0:
            continue
        if f.kind == "code":
            total += (c2 * q.a[j])[:, x]
        elif f.kind == "numeric":
            if sp.metric == "l2":
                d = q.x[j][:, None] - x[None, :]
                d *= d
                total += c2 * d
            else:
                total += (c2 * q.x[j])[:, None] * x[None, :]
        else:
            p, a, b = q.x[j] @ x.T, (q.x[j] ** 2).sum(axis=1), (x * x).sum(axis=1)
            if sp.metric == "l2":
                p *= -2
                p += a[:, None]
                p += b[None, :]
            if c2 != 1:
                p *= c2
            total += p
            off = off + c2 * 1e-12 * (a + b.max(initial=0.0))
    if sp.metric == "cosine":
        off = off + 1e-12
    if sp.metric != "cosine":
        return _finish(total, None, None, sp.metric), off
    return _finish(total, qn[:, None], inn[None, :], sp.metric), off


# ------------------------------------------------------------------ bounds
def bounds(q: Queries, c, sp: Spec, i: int, qn, pairs=None) -> np.ndarray:
    """(queries x cells) lower bounds of the distances to all items of a cell or run: ``c.code``
    (codes by feature), ``c.range`` (lo, hi), ``c.pivot`` (pivots, number, radius) and ``c.norm``
    (range of squared norms); what a cell does not tell is bounded over all codes.  ``pairs``: of
    these (queries, cells) only."""
    l2, m = sp.metric == "l2", len(c.size)
    if pairs is None:
        shape, row, col, look = (q.n, m), lambda v: v[:, None], lambda v: v, lambda t, at: np.take(t, at, axis=1)
    else:
        qi, ci = pairs
        shape, row, col, look = qi.shape, lambda v: v[qi], lambda v: v[ci], lambda t, at: t[qi, at[ci]]
    total, size = np.zeros(shape), 0.0 if l2 else np.zeros(shape)
    low, angle = np.zeros(m if pairs is None else shape), sp.metric == "cosine"
    main = c.main if angle else None
    for j, f in enumerate(sp.features):
        c2 = f.c2[i]
        if c2 == 0:
            continue
        if f.kind == "code":
            if j in c.code:
                term, norm = look(c2 * q.a[j], c.code[j]), col(f.diag[c.code[j]])
            else:
                a = q.a[j][:, c.present[j]] if j in c.present else q.a[j]
                term, norm = c2 * row(a.min(axis=1) if l2 else a.max(axis=1)), f.diag.min()
            if angle:
                low = low + c2 * norm
        elif f.kind == "numeric":
            (lo, hi), x = (col(v) for v in c.range[j]), row(q.x[j])
            if j == main:
                continue
            if l2:
                gap = np.maximum(lo - x, x - hi)
                np.maximum(gap, 0.0, out=gap)
                gap *= gap
                gap *= c2
                term = gap
            else:
                term = c2 * np.maximum(x * lo, x * hi)
            if angle:
                low = low + c2 * np.where((lo <= 0) & (hi >= 0), 0.0, np.minimum(lo * lo, hi * hi))
        else:
            pivot = c.pivot.get(j)
            if l2:
                if pivot is None:
                    continue
                d = np.sqrt(np.maximum(_sq(q.x[j], pivot[0]), 0.0))[:, pivot[1]]
                gap = np.maximum(d * (1 - ROUNDING) - pivot[2] * (1 + ROUNDING), 0.0)
                term = c2 * gap * gap
            else:
                lo, hi = c.norm[j]
                own = np.sqrt((q.x[j] ** 2).sum(axis=1))[:, None]
                term = own * np.sqrt(hi)
                if pivot is not None:
                    dot = (q.x[j] @ pivot[0].T)[:, pivot[1]]
                    term = np.minimum(term, dot + own * pivot[2] + np.abs(dot) * ROUNDING)
                term, low = c2 * term, low + c2 * lo
        total += term
        if not l2:
            size += np.abs(term)
    if l2:  # the terms are not negative: their sizes sum to the total
        return total * (1 - ROUNDING)
    if sp.metric == "ip":
        return -(total + size * ROUNDING)
    most = total + size * ROUNDING
    with np.errstate(divide="ignore", invalid="ignore"):
        if main is None:
            near = _ratio(most, np.broadcast_to(low, most.shape))
        else:  # over the range of one numeric feature the bound of the cosine has one extreme
            c2, (lo, hi), x = sp.features[main].c2[i], (col(v) for v in c.range[main]), row(q.x[main])
            top = np.nan_to_num(x * low / most, nan=0.0, posinf=np.inf, neginf=-np.inf)
            near = np.zeros_like(most)
            for v in (lo, hi, np.clip(top, lo, hi)):
                part = c2 * x * v
                near = np.maximum(near, _ratio(most + part + np.abs(part) * ROUNDING, low + c2 * v * v))
        own = row(np.sqrt(qn))
        return np.where(own > 0, 1.0 - np.minimum(near * (1 + ROUNDING) / own, 1.0), 1.0) - ROUNDING


def _ratio(top, norm2):
    return np.where(top <= 0, 0.0, np.where(norm2 > 0, top / np.sqrt(norm2), np.inf))


def _sq(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(p)))
    step = max(1, (1 << 20) // max(1, p.size))
    for lo in range(0, len(x), step):
        out[lo:lo + step] = ((x[lo:lo + step, None, :] - p[None]) ** 2).sum(axis=2)
    return out


# ------------------------------------------------------------------ the search of a task
def _ragged(start, size) -> np.ndarray:
    """start[0], start[0]+1, ... (size[0] numbers), start[1], ..."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - size), size)


def _slack(tau, sp: Spec):
    return tau + np.abs(tau) * ROUNDING + (0.0 if sp.tie_decimals is None else 2.0 * 10.0 ** -sp.tie_decimals)


def _kth(qi, d, n: int, k: int) -> np.ndarray:
    """The k-th smallest distance of every query (inf: fewer)."""
    order = np.lexsort((d, qi))
    count = np.bincount(qi, minlength=n)
    at = np.cumsum(count) - count + k - 1
    out, has = np.full(n, np.inf), count >= k
    out[has] = d[order[at[has]]]
    return out


def _chosen(q: Queries, it: Items, sp: Spec, i: int, runs, uid, tau):
    """(query, item, distance) of the k nearest, by query and rank."""
    inn = _item_norms(it, sp, i) if sp.metric == "cosine" else None
    qn = q.norms(sp, i) if sp.metric == "cosine" else None
    found, todo = [], np.arange(q.n)
    need = sp.k + sp.exclude_self
    if runs is not None and runs.line is not None:
        some, todo = _along(q, it, sp, i, runs, uid, tau)
        out = _ranked(*some, it, sp, q.n)
        if len(todo):
            qi, *rest = _chosen(_rows(q, todo), it, sp, i, runs.off_line(), None if uid is None else uid[todo], tau[todo])
            out = [np.concatenate([a, b]) for a, b in zip(out, (todo[qi], *rest))]
            order = np.lexsort((out[3], out[0]))
            out = [x[order] for x in out]
        return tuple(out)
    if runs is not None and runs.enough(need) * RUN < DENSE * it.n:
        lb = bounds(q, runs.pieces, sp, i, qn)
        enough = runs.pieces.enough(need)
        first = np.argpartition(lb, enough - 1, axis=1)[:, :enough] if enough > 1 else lb.argmin(axis=1)[:, None]
        rq, rr = _runs_of(runs, np.repeat(todo, enough), first.ravel())
        order = np.lexsort((bounds(q, runs, sp, i, qn, (rq, rr)), rq))
        rq, rr = rq[order], rr[order]
        before = np.cumsum(runs.size[rr]) - runs.size[rr]
        best = before - before[np.searchsorted(rq, todo)][rq] < need
        qi, ii, d = _compared(q, it, sp, i, runs, rq[best], rr[best], uid, qn, inn)
        tau = np.minimum(tau, _kth(qi, d, q.n, sp.k))
        lim = _slack(tau, sp)
        pq, pp = np.nonzero(lb <= lim[:, None])
        near = []
        for lo, hi in _steps(runs.pieces.runs[pp]):
            rq, rr = _runs_of(runs, pq[lo:hi], pp[lo:hi])
            some = bounds(q, runs, sp, i, qn, (rq, rr)) <= lim[rq]
            near.append((rq[some], rr[some]))
        rq, rr = (np.concatenate([x[c] for x in near]) if near else np.zeros(0, int) for c in range(2))
        heavy = np.bincount(rq, weights=runs.size[rr], minlength=q.n) > DENSE * it.n
        todo = np.flatnonzero(heavy)
        if len(todo):
            rq, rr = rq[~heavy[rq]], rr[~heavy[rq]]
        for lo, hi in _steps(runs.size[rr]):
            qi, ii, d = _compared(q, it, sp, i, runs, rq[lo:hi], rr[lo:hi], uid, qn, inn)
            keep = d <= lim[qi]
            found.append((qi[keep], ii[keep], d[keep]))
    for lo in range(0, len(todo), ROWS):
        found.append(_block_by_block(q, it, sp, i, todo[lo:lo + ROWS], uid, qn, inn, tau))
    qi, ii, d = (np.concatenate([x[c] for x in found]) if found else np.zeros(0, int) for c in range(3))
    keep = d <= _slack(tau, sp)[qi]
    return _ranked(qi[keep], ii[keep], d[keep], it, sp, q.n)


def _ranked(qi, ii, d, it: Items, sp: Spec, n: int):
    """(query, item, distance, rank) of the k nearest among these pairs."""
    key = d if sp.tie_decimals is None else np.rint(d * float(10 ** sp.tie_decimals) + GRID_OFFSET)
    order = np.lexsort((it.rank[ii], key, qi))
    qi, ii, d = qi[order], ii[order], d[order]
    count = np.bincount(qi, minlength=n)
    rank = np.arange(len(qi)) - np.repeat(np.cumsum(count) - count, count)
    keep = rank < sp.k
    return qi[keep], ii[keep], d[keep], rank[keep] + 1


def _along(q, it, sp, i, runs, uid, tau):
    """One numeric feature under l2: the nearest items stand beside the query's place in the order of
    values.  (query, item, distance) of candidates, and the queries that they may not do for: those
    for which an item beyond them may be as near as the k-th."""
    j = runs.main
    line, x, c2 = runs.line, q.x[j], sp.features[j].c2[i]
    wide = 2 * (sp.k + sp.exclude_self)
    at = np.searchsorted(line, x)[:, None] + np.arange(-wide - 1, wide + 1)[None, :]
    there = (at >= 0) & (at < len(line))
    at = np.clip(at, 0, len(line) - 1)
    gap = x[:, None] - line[at]
    d = np.where(there, c2 * (gap * gap), np.inf)
    beyond = np.minimum(d[:, 0], d[:, -1])
    ii = runs.order[at]
    fit = there & np.isfinite(d)
    fit[:, [0, -1]] = False
    if sp.exclude_self:
        fit &= it.rank[ii] != uid[:, None]
    kth = np.minimum(tau, np.partition(np.where(fit, d, np.inf), sp.k - 1, axis=1)[:, sp.k - 1])
    done = np.where(np.isfinite(kth), beyond > _slack(kth, sp), ~(there[:, 0] | there[:, -1])) & (np.isfinite(d) | ~there).all(axis=1)
    fit &= done[:, None] & (d <= _slack(kth, sp)[:, None])
    qi, col = np.nonzero(fit)
    return (qi, ii[qi, col], d[qi, col]), np.flatnonzero(~done)


def _block_by_block(q, it, sp, i, rows, uid, qn, inn, tau):
    """Everything compared, a block of items at a time: the k-th distance so far says what of the
    next block is looked at again."""
    sub, at, best = _rows(q, rows), np.arange(len(rows)), tau[rows]
    none = np.zeros(0, int)
    qi, ii, d = none, none, np.zeros(0)
    step = max(COLUMNS, 4 * sp.k)
    for lo in range(0, it.n, step):
        part = it.slice(lo, lo + step)
        far, off = _all_pairs(sub, part, sp, i, None if qn is None else qn[rows], None if inn is None else inn[lo:lo + step])
        if sp.exclude_self:
            far[part.rank[None, :] == uid[rows][:, None]] = np.inf
        if part.n > sp.k and not np.isfinite(best).all():
            best = np.minimum(best, np.partition(far, sp.k - 1, axis=1)[:, sp.k - 1] + off)
        near = far <= (_slack(best, sp) + off + np.abs(best) * 1e-12)[:, None]
        if sp.exclude_self:
            near &= far < np.inf
        a, b = np.divmod(np.flatnonzero(near), part.n)
        if len(a):
            b += lo
            qi, ii, d = np.r_[qi, a], np.r_[ii, b], np.r_[d, _pairs(q, it, sp, i, rows[a], b, qn, inn)]
            best = np.minimum(best, _kth(qi, d, len(at), sp.k))
            keep = d <= _slack(best, sp)[qi]
            qi, ii, d = qi[keep], ii[keep], d[keep]
    return rows[qi], ii, d


def _rows(q: Queries, rows) -> Queries:
    out = Queries.__new__(Queries)
    out.n = len(rows)
    out.s, out.x, out.a = ([None if v is None else v[rows] for v in w] for w in (q.s, q.x, q.a))
    return out


def _runs_of(runs, pq, pp):
    """The runs of pieces, with their queries."""
    n = runs.pieces.runs[pp]
    return np.repeat(pq, n), _ragged(runs.pieces.at[pp], n)


def _steps(size):
    """Stretches of about ``PAIRS`` in all."""
    per = np.cumsum(size)
    cuts = np.unique(np.r_[0, np.searchsorted(per, np.arange(PAIRS, per[-1] if len(per) else 0, PAIRS)), len(per)])
    return zip(cuts[:-1], cuts[1:])


def _compared(q, it, sp, i, runs, rq, rc, uid, qn, inn):
    size = runs.size[rc]
    qi, ii = np.repeat(rq, size), runs.order[_ragged(runs.at[rc], size)]
    if sp.exclude_self:
        keep = it.rank[ii] != uid[qi]
        qi, ii = qi[keep], ii[keep]
    return qi, ii, _pairs(q, it, sp, i, qi, ii, qn, inn)


def _kernel(sp: Spec, carried: Sequence[str], schema: pa.Schema) -> Callable:
    from .knn import QUERY_ID

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        it = Items(right, sp)
        runs = [it.runs(sp, i) for i in range(len(sp.strategies))]
        widest = max([1, *(f.n for f in sp.features), *(max(len(r.pieces.size), RUN * r.enough(sp.k + 1), PIECE * r.pieces.enough(sp.k + 1)) for r in runs if r is not None)])
        step, out = max(16, min(4096, BOUNDS // widest)), []
        if all(r is not None and r.line is not None for r in runs):
            step = 4096
        for lo in range(0, left.num_rows, step):
            t = left.slice(lo, step)
            q = Queries(t, sp)
            ids = _one(t, QUERY_ID)
            uid = np.asarray(pc.fill_null(pc.index_in(ids, value_set=it.first, skip_nulls=True), -1).to_numpy(zero_copy_only=False), np.int64) if sp.exclude_self else None
            for i, name in enumerate(sp.strategies):
                tau = _floats(pc.fill_null(_one(t, f"__tau{i}"), np.inf)) if f"__tau{i}" in t.column_names else np.full(q.n, np.inf)
                qi, ii, d, rank = _chosen(q, it, sp, i, runs[i], uid, tau)
                at = pa.array(ii)
                cols = [ids.take(pa.array(qi)), pa.array([name]).take(pa.array(np.zeros(len(qi), int))), *[_one(right, c).take(at) for c in carried],
                        it.ids.take(at), pa.array(d), pa.array(rank.astype(np.int32))]
                if sp.explain:
                    cols += [pa.array(p) for p in _parts(q, it, sp, i, qi, ii)]
                out.append(pa.table([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema))
        return pa.concat_tables(out)

    return run


# ------------------------------------------------------------------ tiles and blocks
def _query_columns(schema: Schema) -> list[Column]:
    from .knn import rep_g, rep_s, rep_x
    out = []
    for j, e in enumerate(schema.encoders):
        if e.coded:
            out += [F.col(rep_s(e.field)).alias(f"__s{j}"), F.col(rep_g(e.field)).alias(f"__g{j}")]
        else:
            out.append(F.col(rep_x(e.field)).cast("double" if e.type == "numeric" else "array<double>").alias(f"__x{j}"))
    return out


def _code_columns(schema: Schema) -> list[Column]:
    kind = lambda e: "int" if e.coded else "double" if e.type == "numeric" else "array<double>"
    return [F.col(f"{CODES}.`{e.field}`").cast(kind(e)).alias(f"__i{j}") for j, e in enumerate(schema.encoders)]


def tile_size(sp: Spec) -> int:
    """Items of a tile: pieces of codes and values are pruned however many items they hold."""
    return TILE if any(f.kind == "vector" and max(f.c2) > 0 for f in sp.features) else WIDE * TILE


def tiled(items: DataFrame, keys: Sequence[str], plan=None, size: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(items with their tile, cells with their tiles, most tiles of a key).  Without a plan a
    key's items are one cell.  A cell of more than ``size`` items (default ``TILE``) is dealt into
    several tiles."""
    from .cells import COARSE, _stats
    by = [COARSE] if plan is not None else []
    aggs = _stats(plan, items) if plan is not None else [F.count(F.lit(1)).alias("n")]
    each, size = items.groupBy(*keys, *by).agg(*aggs), size or TILE
    before = F.lit(0)
    if by:
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = each.withColumn(GRP, F.floor(before / F.lit(size)).cast("int")).withColumn("__parts", F.ceil(F.col("n") / F.lit(size)).cast("int"))
    cells = write_table(cells, "knn-tiles")
    most = cells.groupBy(*keys, GRP).agg(F.max("__parts").alias("__most")).groupBy(*keys).agg(F.sum("__most").alias("__most")).agg(F.max("__most")).first()[0] or 0
    at = cells.select(*keys, *by, GRP, "__parts")
    out = items.join(at, [*keys, *by]) if keys or by else items.crossJoin(at)
    out = out.withColumn(SUB, F.pmod(F.xxhash64(ITEM_ID), F.col("__parts")).cast("int")).drop("__parts")
    return out, cells, int(most)


def largest(index: DataFrame, keys: Sequence[str]) -> int:
    """Items of the largest partition."""
    return (index.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.max("__n")).first()[0] if keys else index.count()) or 0


def tile_list(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*keys, GRP).agg(F.max("__parts").alias("__parts")).select(*keys, GRP, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias(SUB))


def all_tiles(q: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    tiles = tile_list(cells, keys)
    return q.join(tiles, list(keys)) if keys else q.crossJoin(tiles)


def _together(left: DataFrame, right: DataFrame, n: int, by: Sequence[str], run, schema: StructType) -> DataFrame:
    """``run`` over the rows that agree in ``by``, dealt out into so many partitions, which adaptive
    execution does not merge."""
    def side(df, mark):  # own names, as both sides may come from the same table
        names = [f"__{mark}{j}" for j in range(len(by))]
        return df.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(by, names)], *[F.col(f"`{c}`") for c in df.columns if c not in by]).repartition(n, *names).groupBy(*names)

    return side(left, "left").cogroup(side(right, "right")).applyInArrow(run, schema)


def _width(spark, groups: int) -> int:
    cores = spark.sparkContext.defaultParallelism
    return int(max(1, min(2 * groups, max(8 * cores, groups // 8, int(spark.conf.get("spark.sql.shuffle.partitions"))))))


def met(q: DataFrame, items: DataFrame, schema: Schema, sp: Spec, keys: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """The k nearest items within its tiles of every row of ``q`` (queries with the tile they visit):
    ``query_id, strategy_id, <carried>, item_id, distance, __r`` and the components."""
    from .knn import QUERY_ID, STRATEGY_ID
    spark = items.sparkSession
    ship_package(spark)
    where = [*keys, GRP, SUB]
    size = max(64, min(BLOCK, HITS // (sp.k * len(sp.strategies))))
    cores = spark.sparkContext.defaultParallelism
    blocks = q.groupBy(*where).agg(F.count(F.lit(1)).alias("__nq"))
    blocks = write_table(blocks, "knn-blocks")
    tiles, asked = blocks.agg(F.count(F.lit(1)), F.sum("__nq")).first()
    size = min(size, max(256, -(-(asked or 0) // (3 * cores))))  # every core has something to do
    blocks = blocks.withColumn("__nb", F.ceil(F.col("__nq") / F.lit(size)).cast("int")).drop("__nq")
    n = _width(spark, -(-(asked or 0) // size) + (tiles or 0))
    taus = [c for c in q.columns if c.startswith("__tau")]
    left = q.join(blocks, where).withColumn(BLK, F.pmod(F.xxhash64(QUERY_ID, F.lit(7)), F.col("__nb")).cast("int"))
    left = left.select(*where, BLK, QUERY_ID, *taus, *_query_columns(schema))
    right = items.join(blocks, where).withColumn(BLK, F.explode(F.sequence(F.lit(0), F.col("__nb") - 1)))
    right = right.select(*where, BLK, ITEM_ID, *[F.col(f"`{c}`").alias(f"__k{j}") for j, c in enumerate(carried)], *_code_columns(schema))
    by = [*where, BLK]
    kinds = {f.name: f.dataType for f in items.schema.fields}
    fields = [StructField(QUERY_ID, StringType()), StructField(STRATEGY_ID, StringType()), *[StructField(f"__k{j}", kinds[c]) for j, c in enumerate(carried)],
              StructField(ITEM_ID, StringType()), StructField("distance", DoubleType()), StructField(RANK, IntegerType())]
    if sp.explain:
        fields += [StructField(f"__c{j}", DoubleType()) for j in range(len(sp.features))]
    out_schema = StructType(fields)
    from pyspark.sql.pandas.types import to_arrow_schema
    run = _kernel(sp, [f"__k{j}" for j in range(len(carried))], to_arrow_schema(out_schema))
    out = _together(left, right, n, by, run, out_schema)
    names = [QUERY_ID, STRATEGY_ID, *[F.col(f"__k{j}").alias(c) for j, c in enumerate(carried)], ITEM_ID, "distance", RANK]
    if sp.explain:
        names += [F.col(f"__c{j}").alias(f"__c_{f.name}") for j, f in enumerate(sp.features)]
    return out.select(*names)


# ------------------------------------------------------------------ which tiles to visit
def taus(found: DataFrame, by: Sequence[str], sp: Spec, k: int) -> DataFrame:
    """``__tau<i>``: the k-th smallest distance found under each strategy, null if fewer were found."""
    from .knn import STRATEGY_ID
    w = Window.partitionBy(*by, STRATEGY_ID).orderBy("distance")
    kth = found.withColumn("__at", F.row_number().over(w)).filter(F.col("__at") == k)
    return kth.groupBy(*by).agg(*[F.max(F.when(F.col(STRATEGY_ID) == s, F.col("distance"))).alias(f"__tau{i}") for i, s in enumerate(sp.strategies)])


class Cells:
    """Coarse cells of a partition, as ``bounds`` reads them."""

    def __init__(self, t: pa.Table, sp: Spec, dims):
        get = lambda c: _floats(_one(t, c))
        self.size, self.code, self.present, self.range, self.pivot, self.norm = get("n"), {}, {}, {}, {}, {}
        self.main = None
        for j, feature, kind, own, pivots in dims:
            if kind == "numeric":
                self.range[feature] = (get(f"lo{j}"), get(f"hi{j}"))
                self.main = feature if self.main is None else self.main
            elif kind == "code" and own:
                self.code[feature] = get(f"d{j}").astype(np.int64)
            elif kind == "vector":
                if own:
                    self.pivot[feature] = (pivots, get(f"d{j}").astype(np.int64), get(f"r{j}"))
                if sp.metric != "l2":
                    self.norm[feature] = (get(f"norm{feature}_lo"), get(f"norm{feature}_hi"))


def visits(q: DataFrame, cells: DataFrame, schema: Schema, sp: Spec, plan, second: bool) -> DataFrame:
    """Queries with the tiles to visit: those with the smallest bounds that hold k items, or
    (``second``, with ``__tau<i>`` columns) the others whose bound is at most the k-th distance."""
    from . import cells as C
    from .knn import QUERY_ID
    spark, keys = q.sparkSession, list(plan.keys)
    ship_package(spark)
    at = {f.name: j for j, f in enumerate(sp.features)}
    dims = [(j, at[d.e.field], d.kind, j < plan.coarse, d.pivots if d.kind == "vector" else None) for j, d in enumerate(plan.dims)]
    norms = [F.col(f"{name}{end}").alias(f"norm{at[e.field]}_{end}") for name, e in C._vectors(plan) for end in ("lo", "hi")]
    table = cells.select(*[c for c in cells.columns if not any(c.startswith(name) and c[len(name):] in ("lo", "hi") for name, _ in C._vectors(plan))], *norms)
    counted = q.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("__nb")) if keys else None
    if keys:
        counted = write_table(counted, "knn-asked")
        left = q.join(counted, keys)
        right = table.join(counted, keys)
        groups = counted.agg(F.sum("__nb")).first()[0] or 0
    else:
        groups = max(1, -(-q.count() // BLOCK))
        left, right = q.withColumn("__nb", F.lit(groups)), table.withColumn("__nb", F.lit(groups))
    left = left.withColumn(BLK, F.pmod(F.xxhash64(QUERY_ID, F.lit(7)), F.col("__nb")).cast("int")).drop("__nb")
    right = right.withColumn(BLK, F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))).drop("__nb")
    taus = [f"__tau{i}" for i in range(len(sp.strategies))] if second else []
    reps = _query_columns(schema)
    left = left.select(*keys, BLK, QUERY_ID, *taus, *reps)
    need = sp.k + sp.exclude_self
    out_schema = StructType([StructField(QUERY_ID, StringType()), *[StructField(f"__k{j}", f.dataType) for j, f in enumerate(q.select(*keys).schema.fields)],
                             StructField(GRP, IntegerType()), StructField("__all", IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out_schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow.empty_table()
        c = Cells(right, sp, dims)
        grp = np.asarray(_one(right, GRP).to_numpy(), np.int64)
        order = np.argsort(grp, kind="stable")
        names, start = np.unique(grp[order], return_index=True)
        held = np.add.reduceat(c.size[order], start)
        widest = max([len(grp), *(f.n for f in sp.features)])
        step, out = max(16, min(4096, BOUNDS // max(1, widest))), []
        for lo in range(0, left.num_rows, step):
            t = left.slice(lo, step)
            qs = Queries(t, sp)
            some, near = np.zeros((qs.n, len(names)), bool), None
            for i in range(len(sp.strategies)):
                qn = qs.norms(sp, i) if sp.metric == "cosine" else None
                lb = np.minimum.reduceat(bounds(qs, c, sp, i, qn)[:, order], start, axis=1)
                near = lb if near is None else near
                if second:
                    some |= lb <= _slack(_floats(pc.fill_null(_one(t, f"__tau{i}"), np.inf)), sp)[:, None]
            by = np.argsort(near, axis=1, kind="stable")
            so_far = np.cumsum(held[by], axis=1) - held[by]
            first = np.zeros_like(some)
            np.put_along_axis(first, by, so_far < need, axis=1)
            a, b = np.nonzero(some & ~first if second else first)
            cols = [_one(t, QUERY_ID).take(pa.array(a)), *[_one(t, f"__left{j}").take(pa.array(a)) for j in range(len(keys))], pa.array(names[b]), pa.array(np.zeros(len(a), np.int32))]
            out.append(pa.table([x.cast(f.type) for x, f in zip(cols, arrow)], schema=arrow))
        return pa.concat_tables(out)

    by = [*keys, BLK]
    n = _width(spark, groups)
    found = _together(left, right, n, by, run, out_schema)
    found = found.select(QUERY_ID, *[F.col(f"__k{j}").alias(k) for j, k in enumerate(keys)], GRP)
    return found.join(tile_list(cells, keys), [*keys, GRP]).join(q, [QUERY_ID, *keys])
