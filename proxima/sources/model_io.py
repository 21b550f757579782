"""Save / load an index with its schema (SNK-2/3, D13/D14).

The codes are the stored form, partitioned on disk by strategy-independent filter
columns, so a load restores everything needed for queries, explanations, fetches and
user profiles for every strategy.  The schema is written as a one-row JSON dataset next
to it, through Spark, so it lands on the same shared storage as the data.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import Schema


def save_model(index: DataFrame, schema: Schema, path: str, mode: str = "overwrite") -> dict:
    """Write index, schema and column types.  With ``mode="append"`` the rows are added and
    the schema and types replace the earlier ones."""
    spark = index.sparkSession
    writer = index.write.mode(mode)
    if schema.filter_fields:
        writer = writer.partitionBy(*schema.filter_fields)
    writer.parquet(f"{path}/index")
    save_types(index, f"{path}/types")
    spark.createDataFrame([(schema.to_json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    return {"status": "OK", "path": path}


def save_types(index: DataFrame, path: str) -> None:
    row = index.sparkSession.createDataFrame([(index.schema.json(),)], "types string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_typed(spark: SparkSession, path: str, types_path: str) -> DataFrame:
    """Read a partitioned table with its saved types, so that a folder name such as ``01``
    comes back as the string it was."""
    types = T.StructType.fromJson(json.loads(spark.read.text(types_path).first()[0]))
    return spark.read.schema(types).parquet(path)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, Schema]:
    schema = Schema.from_json(spark.read.text(f"{path}/schema").first()[0])
    index = read_typed(spark, f"{path}/index", f"{path}/types")
    return index.select("item_id", *schema.filter_fields, "codes"), schema
