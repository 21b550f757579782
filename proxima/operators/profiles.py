"""User profiles from item histories and weighted event logs (AGG-1, JN-4/8/10,
SET-2, ENC-19, UDF-2, FLT-7, Q-2/3).

A profile is the weighted mean of the user's item vectors.  It is never built as a dense
vector: per coded feature the user's *code histogram* is enough (``s = hᵀGh``,
``g = Gh``, see ``operators.knn``), numeric features keep a weighted mean and vector
features a mean vector.  The aggregation is one map-side-combined ``groupBy(user,
feature, code)`` (a hot user or item is pre-aggregated before the shuffle) followed by a
``groupBy(user)`` whose collected lists are bounded by the schema (codes per feature,
vector length), never by the history size.
"""

from __future__ import annotations

import math
from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import encoders as X
from ..schema import Schema
from .encode import CODES, ITEM_ID, REJECT, attach_lookups, feature_code, with_codes
from .ingest import explode_filters, filter_reject
from .knn import EMPTY_MAP, QUERY_ID, TORN_ID, rep_g, rep_s, rep_x

USER_ID = "user_id"
TOTAL = "__n"


def history_from_events(events: DataFrame, event_weights: Mapping[str, float] | None = None,
                        user_col: str = "user_id", item_col: Column | str = "item_id",
                        event_col: str = "event_type", default_weight: float = 1.0) -> DataFrame:
    """Event log -> ``user_id, item_id, w`` with per-event-type weights (JN-8, FLT-7)."""
    item = F.col(item_col) if isinstance(item_col, str) else item_col
    if event_weights:
        m = F.create_map(*[x for k, v in event_weights.items() for x in (F.lit(k), F.lit(float(v)))])
        w = F.coalesce(F.element_at(m, F.col(event_col)), F.lit(float(default_weight)))
    else:
        w = F.lit(float(default_weight))
    out = events.select(F.col(user_col).cast("string").alias(USER_ID), item.cast("string").alias(ITEM_ID),
                        w.alias("w"))
    return out.filter(F.col(ITEM_ID).isNotNull())


def _vector_entry(field_name: str, w: Column):
    """(x, i) -> one long row of a vector feature (a two-argument lambda for transform)."""
    def entry(x, i):
        return F.struct(F.lit(field_name).alias("f"), i.alias("c"), w.alias("ws"), (w * x).alias("xs"))
    return entry


def _long_rows(schema: Schema) -> Column:
    """One history row -> array of (feature key, code/pos, weight, weighted value)."""
    parts = []
    w = F.col("w")
    for e in schema.encoders:
        c = F.col(f"{CODES}.`{e.field}`")
        if e.coded:
            parts.append(F.array(F.struct(F.lit(e.field).alias("f"), c.alias("c"), w.alias("ws"),
                                          F.lit(0.0).alias("xs"))))
        elif e.type == "numeric":
            parts.append(F.array(F.struct(F.lit(e.field).alias("f"), F.lit(-1).alias("c"), w.alias("ws"),
                                          (w * c).alias("xs"))))
        else:
            parts.append(F.transform(c, _vector_entry(e.field, w)))
    parts.append(F.array(F.struct(F.lit(TOTAL).alias("f"), F.lit(-1).alias("c"), w.alias("ws"),
                                  F.lit(0.0).alias("xs"))))
    return F.concat(*parts)


def _coded_rep(e, hist: Column, prod: Column, total: Column) -> tuple[Column, Column]:
    """(s, g) of a code histogram ``hist`` and its products with all codes ``prod`` (both
    array<struct<c, ws>>): s = hᵀGh / n², g = Gh / n."""
    h, g = F.map_from_entries(hist), F.map_from_entries(prod)
    s = F.aggregate(F.map_entries(h), F.lit(0.0), lambda acc, x: acc + x["value"] * F.coalesce(F.try_element_at(g, x["key"]), F.lit(0.0)))
    return (F.when(total > 0, s / (total * total)).otherwise(F.lit(0.0)),
            F.when(total > 0, F.transform_values(g, lambda _, v: v / total)).otherwise(EMPTY_MAP()))


def _with_products(agg: DataFrame, schema: Schema) -> DataFrame:
    """``profile_sums`` plus, for each coded feature, the histogram's products with all codes
    (kind ``g``; kind ``h`` are the sums themselves).  One-hot features need none: there the
    product is the histogram.  Others multiply by the sparse Gram rows, one join-free explode
    and one aggregation."""
    plain = agg.select(USER_ID, "f", F.lit("h").alias("kind"), "c", "ws", "xs")
    parts = [plain]
    for e in schema.encoders:
        if e.coded and not B.identity(e):
            row = F.element_at(X.lit_rows(B.gram_rows(e)), F.col("c") + 1)
            x = agg.where(F.col("f") == e.field).select(USER_ID, "f", "ws", F.explode(row).alias("r"))
            x = x.groupBy(USER_ID, "f", F.col("r.c").alias("c")).agg(F.sum(F.col("ws") * F.col("r.v")).alias("ws"))
            parts.append(x.select(USER_ID, "f", F.lit("g").alias("kind"), "c", "ws", F.lit(0.0).alias("xs")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def weighted_rows(history: DataFrame, index: DataFrame, schema: Schema, dedupe: bool = False,
                  cold_start: DataFrame | None = None, cold_start_weight: float = 1.0) -> DataFrame:
    """``user_id, w, codes``: history joined to the indexed items (+ cold-start pseudo-items).

    ``history``: ``user_id, item_id[, w]``.  ``dedupe=True`` counts each item once per
    user with weight 1 (the reference's list form, D10).  ``cold_start`` is a
    ``user_id, <item fields>`` table of pseudo-items (UDF-2: any DataFrame -> DataFrame
    function of the users can produce it), added with ``cold_start_weight`` (SET-2, D11).
    Items are fetched from every partition they are indexed in (D12)."""
    h = history
    if "w" not in h.columns:
        h = h.withColumn("w", F.lit(1.0))
    h = h.select(F.col(USER_ID).cast("string").alias(USER_ID), F.col(ITEM_ID).cast("string").alias(ITEM_ID),
                 F.col("w").cast("double").alias("w")).filter(F.col(ITEM_ID).isNotNull())
    if dedupe:
        h = h.select(USER_ID, ITEM_ID).distinct().withColumn("w", F.lit(1.0))
    elif not h.isStreaming:
        # collapse repeats of (user, item) before the join: a hot user / item shrinks map-side
        h = h.groupBy(USER_ID, ITEM_ID).agg(F.sum("w").alias("w"))
    rows = h.join(index.select(ITEM_ID, CODES), ITEM_ID).select(USER_ID, "w", CODES)
    if cold_start is not None:
        cs = with_codes(cold_start.withColumn("__uid", F.col(USER_ID).cast("string")), schema, keep=["__uid"])
        cs = cs.filter(F.col(REJECT).isNull()).select(F.col("__uid").alias(USER_ID),
                                                      F.lit(float(cold_start_weight)).alias("w"), CODES)
        rows = rows.unionByName(cs)
    return rows


def profile_sums(rows: DataFrame, schema: Schema) -> DataFrame:
    """``user_id, f, c, ws, xs``: per user, feature and code (or vector position) the summed
    weight and weighted value.  Its size is bounded by users x schema, not by history
    length; it is additive, so a stream can maintain it as a running aggregation (STR-4)."""
    long = rows.select(USER_ID, F.explode(_long_rows(schema)).alias("r")).select(USER_ID, "r.*")
    return long.groupBy(USER_ID, "f", "c").agg(F.sum("ws").alias("ws"), F.sum("xs").alias("xs"))


def assemble_profiles(agg: DataFrame, schema: Schema) -> DataFrame:
    """``profile_sums`` -> ``user_id, __n, <reps>`` (one row per user)."""
    aggs = [F.sum(F.when(F.col("f") == TOTAL, F.col("ws"))).alias(TOTAL)]
    for e in schema.encoders:
        is_f = (F.col("f") == e.field) & (F.col("kind") == "h")
        if e.coded:
            known = is_f if e.type != "strict_onehot" else is_f & (F.col("c") > 0)
            aggs.append(F.collect_list(F.when(known, F.struct("c", "ws"))).alias(f"__h_{e.field}"))
            if not B.identity(e):
                is_g = (F.col("f") == e.field) & (F.col("kind") == "g")
                aggs.append(F.collect_list(F.when(is_g, F.struct("c", "ws"))).alias(f"__p_{e.field}"))
        elif e.type == "numeric":
            aggs.append(F.sum(F.when(is_f, F.col("xs"))).alias(f"__h_{e.field}"))
        else:
            aggs.append(F.collect_list(F.when(is_f, F.struct("c", "xs"))).alias(f"__h_{e.field}"))
    per_user = _with_products(agg, schema).groupBy(USER_ID).agg(*aggs)
    total = F.col(TOTAL)
    out = [USER_ID, TOTAL]
    cols = []
    for e in schema.encoders:
        hcol = F.col(f"__h_{e.field}")
        if e.coded:
            s, g = _coded_rep(e, hcol, hcol if B.identity(e) else F.col(f"__p_{e.field}"), total)
            cols += [s.alias(rep_s(e.field)), g.alias(rep_g(e.field))]
        elif e.type == "numeric":
            cols.append(F.when(total > 0, F.coalesce(hcol, F.lit(0.0)) / total).otherwise(0.0).alias(rep_x(e.field)))
        else:
            dense = F.transform(F.array_sort(hcol), lambda p: p["xs"])
            cols.append(F.when(total > 0, F.transform(dense, lambda x: x / total))
                        .otherwise(F.array_repeat(F.lit(0.0), e.length)).alias(rep_x(e.field)))
    return per_user.select(*out, *cols)


MAX_SUMS = 96        # sums of a user that are kept side by side
MAX_PRODUCTS = 1024  # non-zero products of a feature's codes that are written out


def _side_by_side(schema: Schema) -> bool:
    """Do a user's sums fit one row of plain numbers?"""
    wide = sum(B.n_codes(e) if e.coded else max(1, e.length) for e in schema.encoders) + 1
    return wide <= MAX_SUMS and all(B.identity(e) or sum(map(len, B.gram_rows(e))) <= MAX_PRODUCTS for e in schema.encoders if e.coded)


def _sums(schema: Schema) -> list[Column]:
    """A user's summed weight of every code (null: never met), weighted values and weight."""
    w, out = F.col("w"), [F.sum("w").alias(TOTAL)]
    for j, e in enumerate(schema.encoders):
        c = F.col(f"{CODES}.`{e.field}`")
        if e.coded:
            out += [F.sum(F.when(c == i, w)).alias(f"__h{j}_{i}") for i in range(B.n_codes(e))]
        elif e.type == "numeric":
            out.append(F.sum(w * c).alias(f"__h{j}"))
        else:
            out += [F.sum(w * F.get(c, i)).alias(f"__h{j}_{i}") for i in range(e.length)]
    return out


def _sum_of(cols) -> Column:
    out = F.lit(0.0)
    for c in cols:
        out = out + c
    return out


def running_sums(rows: DataFrame, schema: Schema) -> DataFrame:
    """The sums that a user's profile is made of, additive as a stream needs them: a row a user
    where they fit side by side (no row is exploded, and only sums are shuffled), else the long
    ``profile_sums``."""
    return rows.groupBy(USER_ID).agg(*_sums(schema)) if _side_by_side(schema) else profile_sums(rows, schema)


def sums_key(sums: DataFrame) -> list[str]:
    """What a row of ``running_sums`` is about."""
    return [USER_ID] if TOTAL in sums.columns else [USER_ID, "f", "c"]


def profiles_of_sums(per: DataFrame, schema: Schema) -> DataFrame:
    """``running_sums`` -> ``user_id, __n, <reps>`` (one row per user)."""
    if TOTAL not in per.columns:
        return assemble_profiles(per, schema)
    known = {j: range(1 if e.type == "strict_onehot" else 0, B.n_codes(e)) for j, e in enumerate(schema.encoders) if e.coded}
    h = lambda j, i: F.coalesce(F.col(f"__h{j}_{i}"), F.lit(0.0))
    products = []
    for j, e in enumerate(schema.encoders):
        if e.coded:
            rows_of = None if B.identity(e) else B.gram_rows(e)
            for i in known[j]:
                own = h(j, i) if rows_of is None else _sum_of(h(j, b) * F.lit(float(rows_of[b][i])) for b in known[j] if i in rows_of[b])
                products.append(own.alias(f"__p{j}_{i}"))
    per = per.select("*", *products)
    total, cols = F.col(TOTAL), []
    for j, e in enumerate(schema.encoders):
        if e.coded:
            s = _sum_of(h(j, i) * F.col(f"__p{j}_{i}") for i in known[j])
            met = F.filter(F.array(*[F.struct(F.lit(i).alias("c"), (F.col(f"__p{j}_{i}") / total).alias("v")) for i in known[j]]), lambda x: x["v"] != 0)
            cols.append(F.when(total > 0, s / (total * total)).otherwise(F.lit(0.0)).alias(rep_s(e.field)))
            cols.append(F.when(total > 0, F.map_from_entries(met)).otherwise(EMPTY_MAP()).alias(rep_g(e.field)))
        elif e.type == "numeric":
            cols.append(F.when(total > 0, F.coalesce(F.col(f"__h{j}"), F.lit(0.0)) / total).otherwise(0.0).alias(rep_x(e.field)))
        else:
            mean = F.array(*[F.col(f"__h{j}_{i}") / total for i in range(e.length)])
            cols.append(F.when(total > 0, mean).otherwise(F.array_repeat(F.lit(0.0), e.length)).alias(rep_x(e.field)))
    return per.select(USER_ID, TOTAL, *cols)


def profiles(history: DataFrame, index: DataFrame, schema: Schema, dedupe: bool = False,
             cold_start: DataFrame | None = None, cold_start_weight: float = 1.0) -> DataFrame:
    """``user_id, __n, <reps>``: one row per user with matched history or a cold-start item
    (see ``weighted_rows`` for the arguments)."""
    rows = weighted_rows(history, index, schema, dedupe, cold_start, cold_start_weight)
    return profiles_of_sums(running_sums(rows, schema), schema)


def zero_reps(schema: Schema) -> list[Column]:
    """Representation of the zero vector (no history, no cold start: D12)."""
    cols = []
    for e in schema.encoders:
        if e.coded:
            cols += [F.lit(0.0).alias(rep_s(e.field)),
                     EMPTY_MAP().alias(rep_g(e.field))]
        elif e.type == "numeric":
            cols.append(F.lit(0.0).alias(rep_x(e.field)))
        else:
            cols.append(F.array_repeat(F.lit(0.0), e.length).alias(rep_x(e.field)))
    return cols


def user_queries(users: DataFrame, prof: DataFrame, schema: Schema, min_history: float = 0.0,
                 override: bool = True, tables: Mapping | None = None) -> DataFrame:
    """Users (``user_id, <filters>, <override fields>``) + profiles -> kNN query table.

    Users without a profile search with the zero vector unless ``min_history`` > 0.
    ENC-19 / D8: a user column named by a ``user_encoders`` entry replaces that feature's
    averaged part with the user encoder's own block: its values, weight and normaliser, and
    for embeddings and feature tables its lookup table.  A value that cannot be encoded
    leaves the averaged part (``user_rejects`` lists it)."""
    u = users.withColumn(USER_ID, F.col(USER_ID).cast("string"))
    u = explode_filters(u, schema)
    active = [ue for ue in schema.user_encoders if override and _user_fields(ue) & set(users.columns)]
    u = attach_lookups(u, active, tables)
    j = u.join(prof, USER_ID, "left")
    if min_history > 0:
        j = j.filter(F.col(TOTAL) >= F.lit(float(min_history)))
    reps = []
    for e in schema.encoders:
        names = [rep_s(e.field), rep_g(e.field)] if e.coded else [rep_x(e.field)]
        zs = zero_reps(Schema(encoders=(e,)))
        vals = [F.coalesce(F.col(n), z) for n, z in zip(names, zs)]
        ue = schema.user_encoder(e.field)
        if ue in active:
            own = _override_reps(ue, e, u.columns)
            given = _given(ue, users.columns)
            vals = [F.when(given & o.isNotNull(), o).otherwise(v) for o, v in zip(own, vals)]
        reps += [c.alias(n) for c, n in zip(vals, names)]
    return j.select(F.col(USER_ID).alias(QUERY_ID), *schema.filter_fields, *reps)


def _user_fields(ue) -> set:
    return {ue.entity if ue.type == "feature_table" else ue.field}


def _given(ue, columns) -> Column:
    """Did the user give a value for this encoder?"""
    (name,) = _user_fields(ue)
    return F.col(f"`{name}`").isNotNull() if name in columns else F.lit(False)


def _override_reps(ue, e, columns) -> list[Column]:
    """The user encoder's block in units of the item encoder's weight; null where the value
    cannot be encoded."""
    ratio = ue.weight / math.sqrt(B.nonzero_elements(ue)) / ((e.weight or 1.0) / math.sqrt(B.nonzero_elements(e)))
    code, why = feature_code(ue, columns)
    ok = why.isNull() if why is not None else F.lit(True)
    if e.coded:
        diag = F.element_at(X.lit_vector(B.gram_diagonal(ue)), code + 1) * F.lit(ratio * ratio)
        g = X.row_map(X.lit_rows([{c: v * ratio for c, v in r.items()} for r in B.cross_rows(ue, e)]), code)
        return [F.when(ok, diag), F.when(ok, g)]
    x = code * F.lit(ratio) if e.type == "numeric" else F.transform(code, lambda v: v * F.lit(ratio))
    return [F.when(ok, x)]


def user_rejects(users: DataFrame, schema: Schema, tables: Mapping | None = None, restrict_partition: bool = True) -> DataFrame:
    """``user_id, datum, reason``: users whose partition is undeclared, whose override value
    cannot be encoded, or whose rows give different override values (they are not searched)."""
    u = users.withColumn(USER_ID, F.col(USER_ID).cast("string")).withColumn("__datum", F.to_json(F.struct(*[F.col(f"`{c}`") for c in users.columns])))
    u = explode_filters(u, schema)
    active = [ue for ue in schema.user_encoders if _user_fields(ue) & set(users.columns)]
    u = attach_lookups(u, active, tables)
    why = [filter_reject(schema)] if restrict_partition else []
    for ue in active:
        w = feature_code(ue, u.columns)[1]
        if w is not None:
            why.append(F.when(_given(ue, users.columns), w))
    if active:
        own = F.xxhash64(F.to_json(F.struct(*sorted({f for ue in active for f in _user_fields(ue) if f in users.columns}))))
        torn = u.groupBy(F.col(USER_ID).alias("__torn")).agg(F.min(own).alias("a"), F.max(own).alias("b")).filter("a <> b").select("__torn")
        u = u.join(torn, F.col(USER_ID).eqNullSafe(F.col("__torn")), "left")
        why.append(F.when(F.col("__torn").isNotNull(), F.lit(TORN_ID)))
    reason = F.coalesce(*why) if why else F.lit(None).cast("string")
    return u.select(USER_ID, F.col("__datum").alias("datum"), reason.alias("reason")).filter(F.col("reason").isNotNull())


def cold_start_rejects(cold_start: DataFrame, schema: Schema) -> DataFrame:
    """``user_id, reason``: cold-start pseudo-items that cannot be encoded."""
    cs = with_codes(cold_start.withColumn("__uid", F.col(USER_ID).cast("string")), schema, keep=["__uid"])
    return cs.filter(F.col(REJECT).isNotNull()).select(F.col("__uid").alias(USER_ID), F.col(REJECT).alias("reason"))


# ------------------------------------------------------------------ stored vectors
def stored_vector_rows(vectors: DataFrame, schema: Schema, weight: float = 1.0) -> DataFrame:
    """Long form of stored whole-space vectors (``user_id, vec`` in the base strategy's
    weighted coordinates): one row for each feature and slot, in unweighted units."""
    at, parts = 0, []
    offsets = schema.offsets()
    for e in schema.encoders:
        if e.field not in offsets:
            continue
        lo, hi = offsets[e.field]
        f = schema.factor(e.field)
        parts.append(F.transform(F.slice("vec", lo + 1, hi - lo), _slot(e.field, f)))
        at = hi
    v = vectors.filter(X.valid_vector(F.col("vec").cast("array<double>"), at))
    long = v.select(F.col(USER_ID).cast("string").alias(USER_ID), F.explode(F.concat(*parts)).alias("r"))
    return long.select(USER_ID, "r.f", "r.slot", (F.col("r.x") * F.lit(float(weight))).alias("x"))


def _slot(name: str, factor: float):
    def entry(x, i):
        return F.struct(F.lit(name).alias("f"), i.alias("slot"), (x.cast("double") / F.lit(factor)).alias("x"))
    return entry


def profiles_with_vectors(history: DataFrame, index: DataFrame, schema: Schema, vectors: DataFrame, weight: float = 1.0,
                          dedupe: bool = False) -> DataFrame:
    """JN-10: profiles where a user's stored vector over the whole feature space counts as one
    more item of the given weight (D11: a true weighted mean).

    Everything is summed slot by slot in unweighted blocks: a history row adds its codes'
    block rows, a stored vector its slots; a user's sums are bounded by the schema."""
    rows = weighted_rows(history, index, schema, dedupe)
    offsets = schema.offsets()
    if _side_by_side(schema) and all(not e.coded and e.field in offsets for e in schema.encoders):
        return _mean_vectors(rows, schema, vectors, weight)
    sums = profile_sums(rows, schema)
    slots = []
    for e in schema.encoders:
        mine = sums.where(F.col("f") == e.field)
        if e.coded:
            row = F.element_at(X.lit_rows(B.block_rows(e)), F.col("c") + 1)
            slots.append(mine.select(USER_ID, "f", F.explode(row).alias("r"), "ws").select(USER_ID, "f", F.col("r.c").alias("slot"), (F.col("ws") * F.col("r.v")).alias("x")))
        else:
            slots.append(mine.select(USER_ID, "f", F.greatest("c", F.lit(0)).alias("slot"), F.col("xs").alias("x")))
    stored = stored_vector_rows(vectors, schema, weight)
    long = stored
    for s in slots:
        long = long.unionByName(s)
    n = sums.where(F.col("f") == TOTAL).select(USER_ID, F.col("ws").alias("n")).unionByName(
        stored.select(USER_ID).distinct().withColumn("n", F.lit(float(weight))))
    long = long.groupBy(USER_ID, "f", "slot").agg(F.sum("x").alias("x")).unionByName(
        n.groupBy(USER_ID).agg(F.sum("n").alias("x")).select(USER_ID, F.lit(TOTAL).alias("f"), F.lit(0).alias("slot"), "x"))
    aggs = [F.sum(F.when(F.col("f") == TOTAL, F.col("x"))).alias(TOTAL)]
    aggs += [F.map_from_entries(F.collect_list(F.when(F.col("f") == e.field, F.struct("slot", "x")))).alias(f"__s_{e.field}") for e in schema.encoders]
    per = long.groupBy(USER_ID).agg(*aggs)
    total, cols = F.col(TOTAL), []
    for e in schema.encoders:
        m = F.transform_values(F.col(f"__s_{e.field}"), lambda _, v: v / total)
        at = _reader(m)
        if e.coded:
            s = F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, x: acc + x * x)
            if B.identity(e):
                g = F.map_from_entries(F.transform(F.map_entries(m), _shift(1 if e.type == "strict_onehot" else 0)))
            else:
                g = F.map_from_entries(F.transform(X.lit_rows(B.block_rows(e)), _project(at)))
            cols += [s.alias(rep_s(e.field)), g.alias(rep_g(e.field))]
        elif e.type == "numeric":
            cols.append(at(F.lit(0)).alias(rep_x(e.field)))
        else:
            cols.append(F.transform(F.sequence(F.lit(0), F.lit(e.length - 1)), at).alias(rep_x(e.field)))
    return per.select(USER_ID, TOTAL, *cols)


def _mean_vectors(rows: DataFrame, schema: Schema, vectors: DataFrame, weight: float) -> DataFrame:
    """``profiles_with_vectors`` where every feature is a number or a vector: a stored vector is a
    row of weighted codes, and all rows are summed by user at once."""
    offsets, codes = schema.offsets(), []
    for e in schema.encoders:
        lo, hi = offsets[e.field]
        units = F.transform(F.slice(F.col("vec").cast("array<double>"), lo + 1, hi - lo), _unweighted(schema.factor(e.field)))
        codes.append((F.get(units, 0) if e.type == "numeric" else units).alias(e.field))
    v = vectors.filter(X.valid_vector(F.col("vec").cast("array<double>"), max(hi for _, hi in offsets.values())))
    stored = v.select(F.col(USER_ID).cast("string").alias(USER_ID), F.lit(float(weight)).alias("w"), F.struct(*codes).alias(CODES), F.lit(True).alias("__own"))
    same = F.struct(*[F.col(f"{CODES}.`{e.field}`").cast("double" if e.type == "numeric" else "array<double>").alias(e.field) for e in schema.encoders])
    long = rows.select(USER_ID, "w", same.alias(CODES), F.lit(None).cast("boolean").alias("__own")).unionByName(stored)
    n = F.coalesce(F.sum(F.when(F.col("__own").isNull(), F.col("w"))), F.lit(0.0)) + F.coalesce(F.max(F.when(F.col("__own"), F.lit(float(weight)))), F.lit(0.0))
    per = long.groupBy(USER_ID).agg(n.alias(TOTAL), *_sums(schema)[1:])
    total, cols = F.col(TOTAL), []
    mean = lambda name: F.coalesce(F.try_divide(F.col(name), total), F.lit(0.0))
    for j, e in enumerate(schema.encoders):
        x = mean(f"__h{j}") if e.type == "numeric" else F.array(*[mean(f"__h{j}_{i}") for i in range(e.length)])
        cols.append(x.alias(rep_x(e.field)))
    return per.select(USER_ID, TOTAL, *cols)


def _unweighted(factor: float):
    return lambda x: x / F.lit(factor)


def _reader(m: Column):
    return lambda slot: F.coalesce(F.try_element_at(m, slot), F.lit(0.0))


def _shift(by: int):
    return lambda x: F.struct((x["key"] + by).alias("c"), x["value"].alias("v"))


def _project(at):
    def entry(row, code):
        return F.struct(code.alias("c"), F.aggregate(row, F.lit(0.0), lambda acc, r: acc + r["v"] * at(r["c"])).alias("v"))
    return entry
