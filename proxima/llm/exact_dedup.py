"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest.  A batch is grouped by digest,
anti-joined with the index (a sort-merge join that reads the index without shuffling it),
and the new digests are appended, one sorted file for each bucket.  Its folder outlives the
session: opening the same path again registers the existing files.

Every digest carries the id of the batch that brought it.  A batch's own digests do not count
as known, so a batch that is added again after a failure gives the same result and appends
nothing twice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.llm.common import join_groups, write_table

WHITE_SPACE = " \t\n\x0b\x0c\r"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code_points of the original text, digest of the text without white space)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    plain = F.translate(text, WHITE_SPACE, "")
    return docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("code_points"),
                       F.unhex(F.sha2(plain.cast("binary"), 256)).alias("digest"))


class DigestIndex:
    """One row per distinct text seen so far: digest, keep_id (the row that stays),
    code_points (of its text), n_rows (how many equal rows its batch had), batch."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int | None = None):
        self.spark, self.path, self.id_type = spark, path, id_type
        spec = spark.createDataFrame([(int(buckets or spark.conf.get("spark.sql.shuffle.partitions")),)], "buckets int")
        if not self._exists(f"{path}/spec"):
            spec.coalesce(1).write.parquet(f"{path}/spec")
        self.buckets = spark.read.parquet(f"{path}/spec").first().buckets
        self.name = "digest_index_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id {id_type}, code_points BIGINT, n_rows BIGINT, batch STRING) "
                  f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}/digests'")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Append the texts of ``docs`` that the index lacks and return one row for every
        row of ``docs``: ``id_col``, keep_id, group_size, kept, text_sha256.

        Null texts count as empty.  Of equal texts within a batch the one with the most code
        points stays, then the smallest id (null last); of identical rows exactly one is
        kept.  A text the index already holds is never kept: keep_id names the indexed row.
        group_size counts the batch's equal rows plus those of the index entry's own batch.

        ``batch`` names the load; without it the name is made from the rows' ids, lengths and
        digests, so the same rows are the same batch.  Adding a batch again changes nothing in
        the index and returns what the first time returned or should have returned."""
        rows = write_table(digests(docs, id_col, text_col).groupBy("digest", "id", "code_points").agg(F.count("*").alias("copies")), "digests")
        first = F.min(F.struct((-F.col("code_points")).alias("c"), F.col("id").isNull().alias("x"), F.col("id").alias("id")))
        groups = rows.groupBy("digest").agg(first.alias("lead"), F.sum("copies").alias("n_rows"))
        groups = groups.select("digest", F.col("lead.id").alias("lead_id"), (-F.col("lead.c")).alias("lead_points"), "n_rows")
        if batch is None:
            each = F.xxhash64("digest", "id", "code_points", "copies").cast("decimal(38,0)")
            seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(each).alias("h")).first()
            batch = f"rows-{seen.n}-{seen.h or 0}"
        own = F.coalesce("batch", F.lit("")) == batch
        known = self.rows().where(~own).select("digest", F.col("keep_id").alias("old_id"), F.col("n_rows").alias("old_rows"))
        groups = write_table(groups.repartition(self.buckets, "digest").join(known, "digest", "left"), "digest-groups")
        new = groups.where(F.col("old_rows").isNull()).join(self.rows().where(own).select("digest"), "digest", "left_anti")
        new = new.select("digest", F.col("lead_id").cast(self.id_type).alias("keep_id"), F.col("lead_points").alias("code_points"), "n_rows", F.lit(batch).alias("batch"))
        new.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

        total = rows.agg(F.sum("copies")).first()[0] or 0
        out = join_groups(rows, groups, ["digest"], "n_rows", total)
        lead = F.col("old_rows").isNull() & F.col("id").eqNullSafe(F.col("lead_id")) & (F.col("code_points") == F.col("lead_points"))
        out = out.select("*", lead.alias("lead"), F.explode(F.sequence(F.lit(0), ((F.col("copies") - 1) / 1000).cast("long"))).alias("part"))
        out = out.select("*", F.explode(F.sequence(F.col("part") * 1000, F.least(F.col("copies"), F.col("part") * 1000 + 1000) - 1)).alias("copy"))
        keep = F.when(F.col("old_rows").isNull(), F.col("lead_id")).otherwise(F.col("old_id"))
        return out.select(F.col("id").alias(id_col), keep.alias("keep_id"),
                          (F.col("n_rows") + F.coalesce("old_rows", F.lit(0))).alias("group_size"),
                          (F.col("lead") & (F.col("copy") == 0)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def exact_duplicates(docs: DataFrame, index_path: str, id_col: str = "doc_id", text_col: str = "text",
                     buckets: int | None = None, batch: str | None = None) -> DataFrame:
    """``DigestIndex.add`` on the index at ``index_path`` (made there if missing)."""
    id_type = dict(docs.dtypes)[id_col]
    return DigestIndex(docs.sparkSession, index_path, id_type, buckets).add(docs, id_col, text_col, batch)
