"""Column expressions for every encoder: value -> code -> weighted block.

All expressions are built from ``pyspark.sql.functions`` and literal tables derived from
the schema, so they run JVM-side.  Coded lookups use ``element_at`` over literal arrays;
only the JSON / sparse-vector decoders use higher-order functions.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import EncoderSpec
from . import blocks as B
from .numeric import finite


def lit_json(value, ddl: str) -> Column:
    """A nested literal in one piece: Spark folds the parse into a constant, so planning does
    not create one expression per entry."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def lit_vector(values) -> Column:
    return lit_json([float(x) for x in values], "array<double>")


def lit_matrix(rows) -> Column:
    return lit_json([[float(x) for x in r] for r in rows], "array<array<double>>")


def lit_rows(rows) -> Column:
    """Sparse rows ({index: value} each) as array<array<struct<c: int, v: double>>>."""
    return lit_json([[{"c": int(c), "v": float(v)} for c, v in r.items()] for r in rows], "array<array<struct<c: int, v: double>>>")


def row_map(rows: Column, code: Column) -> Column:
    """Row ``code`` of sparse rows as map<int, double>."""
    return F.map_from_entries(F.element_at(rows, code + 1))


def value_col(e: EncoderSpec, columns) -> Column:
    """The feature's input column with the schema default filled in (ENC-11)."""
    if e.field in columns:
        c = F.col(f"`{e.field}`")
        return c if e.default is None else F.coalesce(c, F.lit(e.default))
    return F.lit(e.default)


def _lookup_key(e: EncoderSpec, v: Column) -> tuple[Column, Column]:
    vals = B.code_values(e)
    if B.numeric_values(e):
        return lit_vector(vals), v.try_cast("double")
    return F.lit([str(x) for x in vals]).cast("array<string>"), v.cast("string")


def code_col(e: EncoderSpec, v: Column) -> Column:
    """Integer code of a coded feature; 0 = unknown (for bins: the first bin)."""
    if e.type in ("bin", "bin_ordinal"):
        x = v.try_cast("double")
        terms = [F.when(x > F.lit(float(b)), 1).otherwise(0) for b in e.values]
        code = F.lit(0)
        for t in terms:
            code = code + t
        return F.when(x.isNull(), F.lit(None)).otherwise(code).cast("int")
    arr, key = _lookup_key(e, v)
    return F.coalesce(F.array_position(arr, key), F.lit(0)).cast("int")


def numeric_col(v: Column) -> Column:
    """The number, or null where it is not a finite one."""
    x = v.try_cast("double")
    return F.when(finite(x), x)


def valid_vector(vec: Column, length: int) -> Column:
    """True for an array of exactly ``length`` finite numbers."""
    return F.coalesce((F.size(vec) == F.lit(length)) & F.forall(vec, finite), F.lit(False))


def json_vector_col(v: Column, length: int) -> Column:
    """Dense list ``[..]`` / ``(..)`` or sparse object ``{"i": x}`` -> array<double> (ENC-9).

    Null where the text does not parse, a slot is not a finite number, or an index is not an
    integer within the length."""
    s = F.translate(F.trim(v.cast("string")), "()", "[]")

    def spread(sparse):
        slots = F.map_keys(sparse)
        in_range = F.forall(slots, lambda k: k.rlike("^(0|[1-9][0-9]{0,8})$") & (F.coalesce(k.try_cast("int"), F.lit(-1)) < F.lit(length)))
        dense = F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                            lambda i: F.coalesce(F.try_element_at(sparse, i.cast("string")), F.lit(0.0)))
        return F.when(in_range & F.forall(F.map_values(sparse), finite), dense)

    parsed = F.when(F.get_json_object(s, "$").isNotNull(), F.from_json(s, "map<string,double>"))
    vec = F.when(s.startswith("{"), once(parsed, spread)).otherwise(F.from_json(s, "array<double>"))
    return once(vec, lambda x: F.when(valid_vector(x, length), x))


def once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated a single time, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def block_col(e: EncoderSpec, code: Column, factor: float) -> Column:
    """Weighted vector block of a feature from its code (array<double>)."""
    if e.coded:
        length = B.encoder_length(e)
        if B.identity(e):
            slot = code - 1 if e.type == "strict_onehot" else code
            return F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                               lambda j: F.when(j == slot, F.lit(float(factor))).otherwise(F.lit(0.0)))
        row = row_map(lit_rows([{c: v * factor for c, v in r.items()} for r in B.block_rows(e)]), code)
        return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.coalesce(F.try_element_at(row, j), F.lit(0.0)))
    if e.type == "numeric":
        return F.array(code * F.lit(float(factor)))
    return F.transform(code, lambda x: x * F.lit(float(factor)))


# ------------------------------------------------------------ vector helpers
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x)


def sqnorm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)
