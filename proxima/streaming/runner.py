"""Shared plumbing of the streaming operators: file-stream sources, idempotent
per-micro-batch sinks and "latest version wins" reads of those sinks.

Every sink here is fault tolerant the Structured Streaming way: progress lives in the
query's checkpoint location (on the shared storage of ``spark.checkpoint.dir``), and a
``foreachBatch`` body writes batch ``N`` to its own ``batch_id=N`` folder with
``overwrite``, so a batch replayed after a lost executor or driver restart replaces its
own earlier attempt instead of duplicating it.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

BATCH_ID = "batch_id"


def file_stream(spark: SparkSession, path: str, like: DataFrame | str, max_files_per_trigger: int | None = None,
                fmt: str = "parquet") -> DataFrame:
    """A streaming DataFrame over the files arriving in ``path`` (schema taken from a
    DataFrame or a DDL string; file streams need it declared up front)."""
    schema = like.schema if isinstance(like, DataFrame) else like
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(path)


def batch_sink(path: str, partition_by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` body: write the micro-batch to ``path/batch_id=N`` (idempotent)."""
    def write(df: DataFrame, batch_id: int) -> None:
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(f"{path}/{BATCH_ID}={batch_id}")
    return write


def run_available_now(writer: DataStreamWriter, checkpoint: str, timeout_s: float | None = None) -> None:
    """Process everything available now in as many micro-batches as the source's rate
    limit asks for, then stop (the batch-style way to drive a stream; a service would use
    a processing-time trigger on the same writer instead)."""
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError(f"stream did not finish within {timeout_s}s")
    if q.exception() is not None:
        raise q.exception()


def latest(df: DataFrame, keys: Sequence[str], order: str = BATCH_ID) -> DataFrame:
    """Newest version of every key: ``max_by`` is a partial (map-side) aggregate, so a key
    written in many batches is reduced before the shuffle."""
    vals = [c for c in df.columns if c not in keys and c != order]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*vals), F.col(order)).alias("__v"))
    return top.select(*keys, *[F.col(f"__v.`{c}`").alias(c) for c in vals])


def appended_in_order(df: DataFrame, path: str, order_col: str, chunks: int) -> Iterator[int]:
    """Append ``df`` to ``path`` as ``chunks`` successive writes ordered by ``order_col`` (a
    numeric or timestamp column), and hand over after each, so that a file stream that is run
    there (``run_available_now`` with one checkpoint) takes a chunk as one micro-batch, however
    many files it has.  Were a chunk's files taken one by one, a micro-batch would be as small as
    a file, and the first would move the watermark past the events of the others.  Used to replay
    a table as a stream in tests and registered checks; each append is a distributed write."""
    x = F.col(order_col)
    if dict(df.dtypes)[order_col].startswith("timestamp"):
        x = x.cast("timestamp").cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        df.limit(0).write.mode("append").parquet(path)
        yield 0
        return
    span = (hi - lo) or 1.0
    bucket = F.least(F.floor((x - F.lit(lo)) / F.lit(span) * chunks), F.lit(chunks - 1))
    for i in range(chunks):
        df.filter(bucket == i).write.mode("append").parquet(path)
        yield i
