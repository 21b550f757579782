"""Ingest of JSON and CSV item files (SRC-2, SRC-3).

Every field the schema names is read as text, so a value that its encoder cannot take is
rejected row by row with its reason; records that do not parse go to the rejects as they
stand.  Filter values may be lists in JSON.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import ingest
from ..schema import Schema

CORRUPT = "__corrupt"


def _fields(schema: Schema) -> list[str]:
    names = [schema.id_col, *schema.filter_fields]
    names += [e.entity if e.type == "feature_table" else e.field for e in schema.encoders]
    return list(dict.fromkeys(names))


def _text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])


def read_json(spark: SparkSession, path: str, schema: Schema, multi_line: bool = False) -> DataFrame:
    """Records of JSON files (one a line, or whole files with ``multi_line``), the schema's
    fields as text plus ``__corrupt``: the record where it does not parse."""
    r = spark.read.schema(_text_schema(_fields(schema))).option("mode", "PERMISSIVE")
    df = r.option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).json(path)
    for f in schema.filter_fields:
        listed = F.from_json(F.col(f"`{f}`"), "array<string>")
        df = df.withColumn(f, F.when(F.col(f"`{f}`").startswith("["), listed).otherwise(F.array(f"`{f}`")))
    return _typed_filters(df, schema)


def read_csv(spark: SparkSession, path: str, schema: Schema, sep: str = ",") -> DataFrame:
    """Records of CSV files with a header line, as text plus ``__corrupt``."""
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    r = spark.read.schema(_text_schema(header)).option("header", True).option("sep", sep).option("mode", "PERMISSIVE")
    r = r.option("columnPruning", False)  # all fields are parsed, so that a short line shows
    return _typed_filters(r.option("columnNameOfCorruptRecord", CORRUPT).csv(path), schema)


def _typed_filters(df: DataFrame, schema: Schema) -> DataFrame:
    """Filter values as their declared type (numbers where all declared values are)."""
    for flt in schema.filters:
        if flt.values and all(isinstance(v, int) and not isinstance(v, bool) for v in flt.values):
            c = F.col(f"`{flt.field}`")
            listed = isinstance(df.schema[flt.field].dataType, T.ArrayType)
            df = df.withColumn(flt.field, F.transform(c, lambda x: x.try_cast("long")) if listed else c.try_cast("long"))
    return df


def ingest_records(df: DataFrame, schema: Schema, **kw) -> ingest.IndexBuild:
    """Load a frame of ``read_json`` / ``read_csv``; its rejects also list the records that
    did not parse."""
    # the filters name a second column: Spark does not read the corrupt record alone
    read = F.coalesce(F.length(F.col(f"`{schema.id_col}`")), F.lit(0)) >= 0
    good = df.filter(F.col(CORRUPT).isNull() & read).drop(CORRUPT)
    bad = df.filter(F.col(CORRUPT).isNotNull() & read).select(
        F.col(f"`{schema.id_col}`").cast("string").alias("item_id"), F.col(CORRUPT).alias("datum"), F.lit("malformed record").alias("reason"))
    b = ingest.build_index(good, schema, **kw)
    b.rejects = b.rejects.unionByName(bad)
    return b


def ingest_json(spark: SparkSession, path: str, schema: Schema, multi_line: bool = False, **kw) -> ingest.IndexBuild:
    return ingest_records(read_json(spark, path, schema, multi_line), schema, **kw)


def ingest_csv(spark: SparkSession, path: str, schema: Schema, sep: str = ",", **kw) -> ingest.IndexBuild:
    return ingest_records(read_csv(spark, path, schema, sep), schema, **kw)
