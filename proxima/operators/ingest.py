"""Index building: validate + code item rows, with a rejects table, load modes and
index statistics (SRC-1/4, SNK-1/6, FLT-1..4, JN-6/9, AGG-2..4, WIN-3/5, SET-1/3).

An *index* is a DataFrame ``item_id STRING, <filter columns>, codes STRUCT``.  An item
whose filter value is a list is placed in every listed partition (D16).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ALL_PARTITION, Schema
from .encode import CODES, ITEM_ID, REJECT, with_codes

MODES = ("append", "skip_existing", "upsert", "overwrite")
SEQ = "__seq"
ORDER = "__order"


@dataclass
class IndexBuild:
    index: DataFrame        # the whole index after this load
    added: DataFrame        # accepted rows of this load
    rejects: DataFrame      # item_id, datum (json), reason
    duplicates: DataFrame   # item_id, reason


def explode_filters(df: DataFrame, schema: Schema) -> DataFrame:
    """List-valued filter columns -> one row per listed value (FLT-3 / D16)."""
    for f in schema.filter_fields:
        if isinstance(df.schema[f].dataType, T.ArrayType):
            df = df.withColumn(f, F.explode_outer(f))
    return df


def filter_reject(schema: Schema):
    """Reason for an undeclared / missing filter value (FLT-2), or null."""
    reasons = []
    for flt in schema.filters:
        c = F.col(f"`{flt.field}`")
        ok = c.isNotNull() & c.isin(list(flt.values))
        reasons.append(F.when(~ok, F.lit(f"undeclared partition value for {flt.field}")))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def _some_partition(df: DataFrame, schema: Schema):
    """Does the row name at least one declared partition?"""
    ok = F.lit(True)
    for flt in schema.filters:
        c, values = F.col(f"`{flt.field}`"), list(flt.values)
        if isinstance(df.schema[flt.field].dataType, T.ArrayType):
            ok = ok & F.exists(c, lambda x, v=values: x.isin(v))
        else:
            ok = ok & c.isin(values)
    return F.coalesce(ok, F.lit(False))


def build_index(df: DataFrame, schema: Schema, mode: str = "append", existing: DataFrame | None = None,
                tables=None, strict_unknown: bool = False, order_col: str | None = None) -> IndexBuild:
    """Code and validate item rows and load them into an index (see ``MODES``).

    Of several rows with one id, ``upsert`` keeps the one with the largest ``order_col`` and
    ``skip_existing`` the one with the smallest; without ``order_col`` the order is that of
    the input files.  The row is chosen by one aggregation over a single evaluation of the
    input."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    raw_cols = df.columns
    src = df.withColumn(SEQ, F.monotonically_increasing_id())
    src = src.withColumn("__datum", F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw_cols])))
    order = F.col(f"`{order_col}`") if order_col else F.lit(0)
    coded = with_codes(src.withColumn(ORDER, order), schema, tables, strict_unknown, keep=[SEQ, ORDER, "__datum"])
    whole = coded
    coded = explode_filters(coded, schema)
    reason = F.coalesce(F.col(REJECT), filter_reject(schema),
                        F.when(F.col(ITEM_ID).isNull(), F.lit(f"missing {schema.id_col}")))
    coded = coded.withColumn(REJECT, reason)
    rejects = coded.filter(F.col(REJECT).isNotNull()).select(ITEM_ID, F.col("__datum").alias("datum"),
                                                             F.col(REJECT).alias("reason"))
    cols = [ITEM_ID] + schema.filter_fields + [CODES]
    new = coded.filter(F.col(REJECT).isNull()).select(*cols, SEQ)

    # duplicates: repeated ids within this load (distinct load rows) or already indexed
    in_load = (new.groupBy(ITEM_ID).agg(F.count_distinct(SEQ).alias("n"))
               .filter("n > 1").select(ITEM_ID, F.lit("duplicate id in load").alias("reason")))
    dups = in_load
    if existing is not None:
        already = (new.select(ITEM_ID).join(existing.select(ITEM_ID).distinct(), ITEM_ID, "left_semi")
                   .distinct().select(ITEM_ID, F.lit("already indexed").alias("reason")))
        dups = dups.unionByName(already)

    if mode == "append" or mode == "overwrite":
        added = new
    else:
        pick = F.max_by if mode == "upsert" else F.min_by
        valid = whole.filter(F.col(REJECT).isNull() & F.col(ITEM_ID).isNotNull() & _some_partition(whole, schema))
        kept = [c for c in cols if c != ITEM_ID]
        one = valid.groupBy(ITEM_ID).agg(pick(F.struct(*kept), F.struct(ORDER, SEQ)).alias("__row"))
        added = explode_filters(one.select(ITEM_ID, "__row.*"), schema)
        added = added.filter(filter_reject(schema).isNull()) if schema.filters else added
        if mode == "skip_existing" and existing is not None:
            added = added.join(existing.select(ITEM_ID), ITEM_ID, "left_anti")
    added = added.select(*cols)

    if existing is None or mode == "overwrite":
        index = added
    elif mode == "upsert":
        index = existing.select(*cols).join(added.select(ITEM_ID), ITEM_ID, "left_anti").unionByName(added)
    else:
        index = existing.select(*cols).unionByName(added)
    return IndexBuild(index, added, rejects, dups)


# ------------------------------------------------------------------ statistics
def declared_partitions(spark, schema: Schema) -> DataFrame:
    """The declared filter-value product as a DataFrame (built by explode, no join)."""
    df = spark.range(1).select()
    if not schema.filters:
        return spark.createDataFrame([(ALL_PARTITION,)], "partition string")
    for flt in schema.filters:
        df = df.withColumn(flt.field, F.explode(F.array(*[F.lit(v) for v in flt.values])))
    return df


def partition_label(schema: Schema):
    """Display label of a partition: the value itself for one filter, a tuple string otherwise."""
    if not schema.filters:
        return F.lit(ALL_PARTITION)
    if len(schema.filters) == 1:
        return F.col(f"`{schema.filter_fields[0]}`").cast("string")
    inner = F.concat_ws(", ", *[F.concat(F.lit("'"), F.col(f"`{f}`").cast("string"), F.lit("'"))
                                for f in schema.filter_fields])
    return F.concat(F.lit("("), inner, F.lit(")"))


def partition_stats(index: DataFrame, schema: Schema) -> DataFrame:
    """AGG-2 + JN-9: element count of every declared partition, empty ones included."""
    spark = index.sparkSession
    decl = declared_partitions(spark, schema)
    if not schema.filters:
        n = index.agg(F.count(F.lit(1)).alias("element_count"))
        return n.select(F.lit(ALL_PARTITION).alias("partition"), "element_count")
    counts = index.groupBy(*schema.filter_fields).agg(F.count(F.lit(1)).alias("element_count"))
    out = decl.join(counts, schema.filter_fields, "left")
    return out.select(partition_label(schema).alias("partition"), *schema.filter_fields,
                      F.coalesce("element_count", F.lit(0)).cast("long").alias("element_count"))


def affected_partitions(added: DataFrame, schema: Schema) -> DataFrame:
    """AGG-4: number of distinct partitions touched by a load."""
    if not schema.filters:
        return added.agg(F.least(F.count(F.lit(1)), F.lit(1)).cast("long").alias("affected_partitions"))
    return added.select(*schema.filter_fields).distinct().agg(F.count(F.lit(1)).alias("affected_partitions"))


def total_items(index: DataFrame) -> DataFrame:
    """AGG-3: number of distinct item ids."""
    return index.agg(F.count_distinct(ITEM_ID).alias("total_items"))
