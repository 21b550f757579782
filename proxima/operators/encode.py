"""Encode item tables: defaults -> per-feature codes (+ reject reasons) -> vectors.

The stored form of an item is its ``codes`` struct (one field per feature: an int code
for coded features, a double for numeric ones, an array<double> for vector features).
Vectors for any strategy are a projection of the codes (ENC-16/17), so re-weighting
never needs a re-index.
"""

from __future__ import annotations

from typing import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import custom
from ..functions import encoders as X
from ..schema import Schema, EncoderSpec

ITEM_ID = "item_id"
CODES = "codes"
REJECT = "reject_reason"


def _vec_tmp(f: str) -> str:
    return f"__vec_{f}"


def _table_for(e: EncoderSpec, spark, tables: Mapping | None) -> DataFrame:
    if tables and e.field in tables:
        return tables[e.field]
    return spark.read.parquet(e.table)


def attach_lookups(df: DataFrame, encoders, tables: Mapping | None = None) -> DataFrame:
    """Left-join the lookup tables of embedding / feature-table encoders (JN-7).

    The lookup table is reduced to one (key, vector) row per key first; a key with differing
    vectors has none.  Spark picks broadcast only when the table's runtime size is under the
    broadcast threshold, otherwise it shuffles on the key.  Unknown keys get a zero vector
    (embedding) or a reject (feature table)."""
    spark = df.sparkSession
    for e in encoders:
        if e.type not in ("embedding", "feature_table"):
            continue
        if e.type == "embedding" and e.table is None and not (tables and e.field in tables):
            continue
        t = _table_for(e, spark, tables)
        key = F.col(f"`{e.key}`").cast("string")
        raw = F.col(f"`{e.vector}`")
        text = e.type == "feature_table" and dict(t.dtypes)[e.vector] == "string"
        vec = X.json_vector_col(raw, e.length) if text else raw.cast("array<double>")
        kname, vname = f"__key_{e.field}", _vec_tmp(e.field)
        lk = t.select(key.alias(kname), vec.alias(vname)).groupBy(kname).agg(
            F.min(vname).alias(vname), F.max(vname).alias("__max"), F.count(vname).alias("__n"), F.count(F.lit(1)).alias("__all"))
        agreed = (F.col("__n") == F.col("__all")) & (F.col(vname) == F.col("__max"))
        lk = lk.select(kname, F.when(agreed, F.col(vname)).otherwise(F.array().cast("array<double>")).alias(vname))
        src = e.entity if e.type == "feature_table" else e.field
        v = X.value_col(EncoderSpec(src, "numeric", default=e.default), df.columns).cast("string")
        df = df.withColumn(f"__lk_{e.field}", v)
        df = df.join(lk, df[f"__lk_{e.field}"] == lk[kname], "left").drop(kname)
    return df


def feature_code(e: EncoderSpec, columns) -> tuple[Column, Column | None]:
    """(code column, reject-reason column or None) of one feature."""
    v = X.value_col(e, columns)
    if e.coded:
        code = X.code_col(e, v)
        if e.type in ("bin", "bin_ordinal"):
            return code, F.when(code.isNull(), F.lit(f"non-numeric value for {e.field}"))
        return code, None
    if e.type == "custom":
        code = custom.code(e, v)
        return code, F.when(custom.bad(e, code), F.lit(f"bad value for {e.field}"))
    if e.type == "numeric":
        x = X.numeric_col(v)
        return x, F.when(x.isNull(), F.lit(f"non-numeric value for {e.field}"))
    if e.type == "json":
        vec = X.json_vector_col(v, e.length)
        return vec, F.when(vec.isNull(), F.lit(f"bad vector for {e.field}"))
    if e.type == "embedding" and _vec_tmp(e.field) not in columns:
        vec = v.cast("array<double>")
        return vec, F.when(~X.valid_vector(vec, e.length), F.lit(f"bad vector for {e.field}"))
    vec = F.col(f"`{_vec_tmp(e.field)}`")
    if e.type == "embedding":
        vec = F.coalesce(vec, F.array_repeat(F.lit(0.0), e.length))
        return vec, F.when(~X.valid_vector(vec, e.length), F.lit(f"bad vector for {e.field}"))
    return vec, F.when(~X.valid_vector(vec, e.length), F.lit(f"missing feature for {e.field}"))


def with_codes(df: DataFrame, schema: Schema, tables: Mapping | None = None,
               strict_unknown: bool = False, keep=()) -> DataFrame:
    """Return ``item_id?, <filters>, <keep>, codes, reject_reason``.

    Filter columns are returned as they are (lists are handled by the caller)."""
    df = attach_lookups(df, schema.encoders, tables)
    cols = df.columns
    fields, reasons = [], []
    for e in schema.encoders:
        code, why = feature_code(e, cols)
        fields.append(code.alias(e.field))
        if why is not None:
            reasons.append(why)
        if strict_unknown and e.coded and e.type not in ("bin", "bin_ordinal"):
            reasons.append(F.when(code == 0, F.lit(f"unknown value for {e.field}")))
    out = []
    if schema.id_col in cols:
        out.append(F.col(f"`{schema.id_col}`").cast("string").alias(ITEM_ID))
    for f in schema.filter_fields:
        out.append(F.col(f"`{f}`") if f in cols else F.lit(None).alias(f))
    out += [F.col(f"`{k}`") for k in keep if k in cols]
    out.append(F.struct(*fields).alias(CODES))
    out.append((F.coalesce(*reasons) if reasons else F.lit(None).cast("string")).alias(REJECT))
    return df.select(*out)


def vector_from_codes(schema: Schema, strategy_id=None, weights=None, codes: str = CODES) -> Column:
    """Concatenated weighted vector of the non-zero-weight features (ENC-12/13/14/17)."""
    w = schema.weights(strategy_id, weights)
    parts = []
    for e in schema.encoders:
        if w[e.field] == 0:
            continue
        parts.append(X.block_col(e, F.col(f"{codes}.`{e.field}`"), schema.factor(e.field, strategy_id, weights)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def encode(df: DataFrame, schema: Schema, strategy_id=None, weights=None, tables=None,
           keep=()) -> DataFrame:
    """ENC-13: item rows -> ``item_id, <filters>, <keep>, vec`` (rejects dropped; use
    ``proxima.operators.ingest.build_index`` to keep them)."""
    coded = with_codes(df, schema, tables, keep=keep).filter(F.col(REJECT).isNull())
    keep_cols = [c for c in coded.columns if c not in (CODES, REJECT)]
    return coded.select(*keep_cols, vector_from_codes(schema, strategy_id, weights).alias("vec"))


def decode(index: DataFrame, schema: Schema, strategy_id=None, weights=None) -> DataFrame:
    """ENC-17: rebuild vectors of an index from its codes for any strategy."""
    keep_cols = [c for c in index.columns if c != CODES]
    return index.select(*keep_cols, vector_from_codes(schema, strategy_id, weights).alias("vec"))


def vector_long(df: DataFrame, id_cols, vec: str = "vec", decimals: int | None = None) -> DataFrame:
    """(ids..., pos, val) long form of a vector column."""
    ids = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    out = df.select(*ids, F.posexplode(vec).alias("pos", "val"))
    if decimals is not None:
        out = out.withColumn("val", F.round("val", decimals))
    return out
