"""Embedding matrix files (SRC-5): a numpy ``.npy`` matrix and a text file of ids, row i of one
belonging to line i of the other.

``spark.read.format("npy_matrix")`` reads matrices (option ``paths``, a JSON list) as ``file STRING,
row LONG, vector ARRAY<DOUBLE>``.  The header tells where each row stands, so a partition is a range
of rows, read by seek on whatever file system Spark's workers reach through pyarrow; no task and no
driver holds a matrix.  Row ranges hold about ``rowBytes`` bytes (option, 16 MB).

``embedding_table`` pairs a matrix with its ids and gives the keyed table that embedding encoders
look up.  The ids are read by Spark as text; blank lines are no ids.  ``write_matrix`` writes a table
as matrix files, one an Arrow batch, and returns which key stands in which row.
"""

from __future__ import annotations

import ast
import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package, write_table

ROW_BYTES = 16 * 1024 * 1024
BLOCK_ROWS = 4096  # rows that a task holds at once, at most
# fixed values of the .npy format: magic string; size of the length field by major version
MAGIC = b"\x93NUMPY"
LENGTH_FORMAT = {1: "<H", 2: "<I", 3: "<I"}


def _opened(path: str, mode: str = "r"):
    from pyarrow import fs
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if mode == "r":
        return system.open_input_file(name)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(name)


def read_header(path: str) -> tuple[str, int, int, int]:
    """(dtype, rows, columns, offset of the first row) of a two-dimensional ``.npy`` file in
    row order with float or integer values; anything else is an error."""
    with _opened(path) as f:
        head = f.read(8)
        if len(head) < 8 or head[:6] != MAGIC or head[6] not in LENGTH_FORMAT:
            raise ValueError(f"{path} is no .npy file")
        field = LENGTH_FORMAT[head[6]]
        n = struct.unpack(field, f.read(struct.calcsize(field)))[0]
        info = ast.literal_eval(f.read(n).decode("utf-8" if head[6] == 3 else "latin1"))
        at = f.tell()
    kind, shape = info["descr"], info["shape"]
    if not isinstance(kind, str) or kind[1] not in "fiu":
        raise ValueError(f"{path} holds {kind}, not numbers")
    if len(shape) != 2 or (info["fortran_order"] and min(shape) > 1):
        raise ValueError(f"{path} is no matrix in row order")
    return kind, int(shape[0]), int(shape[1]), at


class RowRange(InputPartition):
    def __init__(self, file: int, first: int, last: int):
        self.file, self.first, self.last = file, first, last


class MatrixReader(DataSourceReader):
    def __init__(self, options):
        self.paths = json.loads(options["paths"])
        self.heads = [read_header(p) for p in self.paths]
        self.row_bytes = int(options.get("rowBytes", ROW_BYTES))

    def partitions(self):
        out = []
        for i, (kind, rows, columns, _) in enumerate(self.heads):
            step = max(1, self.row_bytes // max(1, columns * int(kind[2:])))
            out += [RowRange(i, j, min(j + step, rows)) for j in range(0, rows, step)]
        return out or [RowRange(0, 0, 0)]

    def read(self, part: RowRange) -> Iterator:
        import numpy as np
        import pyarrow as pa
        if part.first == part.last:
            return
        path, (kind, rows, columns, at) = self.paths[part.file], self.heads[part.file]
        width = columns * int(kind[2:])
        with _opened(path) as f:
            for i in range(part.first, part.last, BLOCK_ROWS):
                n = min(BLOCK_ROWS, part.last - i)
                f.seek(at + i * width)
                raw = f.read(n * width)
                if len(raw) < n * width:
                    raise ValueError(f"{path} ends before row {i + n} of {rows}")
                x = np.frombuffer(raw, dtype=kind).astype(np.float64)
                ends = pa.array(np.arange(n + 1, dtype=np.int32) * columns)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(np.arange(i, i + n, dtype=np.int64)),
                                                  pa.ListArray.from_arrays(ends, pa.array(x))], names=["file", "row", "vector"])


class MatrixSource(DataSource):
    @classmethod
    def name(cls):
        return "npy_matrix"

    def schema(self):
        return "file string, row long, vector array<double>"

    def reader(self, schema):
        return MatrixReader(self.options)


def read_matrix(spark: SparkSession, paths: str | list[str], row_bytes: int = ROW_BYTES) -> DataFrame:
    """``file, row, vector`` of one or more ``.npy`` matrices."""
    ship_package(spark)
    spark.dataSource.register(MatrixSource)
    paths = json.dumps([paths] if isinstance(paths, str) else list(paths))
    return spark.read.format("npy_matrix").option("paths", paths).option("rowBytes", row_bytes).load()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row, key``: the trimmed lines of a text file that are not blank, numbered from 0 in file
    order.  A line's number is its place in its split plus the lines of the splits before; a row
    for each split is broadcast.  Lines are numbered from a written table, so that a lost executor
    cannot change them."""
    lines = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("key"), F.col("_metadata.file_block_start").alias("at"))
    lines = write_table(lines.filter("key <> ''").withColumn("i", F.monotonically_increasing_id()), "matrix-ids")
    splits = lines.groupBy("at").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("at", (before - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(splits), "at").select((F.col("i") + F.col("shift")).alias("row"), "key")


def embedding_table(spark: SparkSession, matrix: str | list[str], ids: str | DataFrame, row_bytes: int = ROW_BYTES) -> DataFrame:
    """``key, vector``: matrix rows under their ids: a text file of one matrix, or a table ``file,
    row, key`` such as ``write_matrix`` gives.

    As many ids as rows, else an error.  The result is the lookup table of an ``embedding``
    encoder (``tables={field: ...}`` with ``key="key"``, ``vector="vector"``); an id that stands
    for several rows with the same vector is one, with differing vectors it has none."""
    files = [matrix] if isinstance(matrix, str) else list(matrix)
    if isinstance(ids, str):
        if len(files) != 1:
            raise ValueError("a text file of ids belongs to one matrix")
        ids = numbered_lines(spark, ids).withColumn("file", F.lit(files[0]))
    n, rows = ids.count(), sum(read_header(p)[1] for p in files)
    if n != rows:
        raise ValueError(f"{n} ids for {rows} matrix rows")
    return read_matrix(spark, files, row_bytes).join(ids, ["file", "row"]).select("key", "vector")


def write_matrix(df: DataFrame, folder: str, key: str, vector: str) -> DataFrame:
    """Write ``vector`` as float64 matrices in ``folder``; ``file, row, key`` tells where each row
    went, as a written table.  Each Arrow batch (64 MB at most) is one file with a name of its
    own, so a task that runs again leaves files that nothing names.  Rows whose vector is null, holds a
    null or has another length than the first are an error."""
    ship_package(df.sparkSession)

    def run(batches):
        import uuid
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            keys, vec = batch.column(0), batch.column(1)
            if not len(keys):
                continue
            sizes = np.asarray(vec.value_lengths())
            if vec.null_count or vec.flatten().null_count or (sizes != sizes[0]).any():
                raise ValueError("vectors of one length without nulls make a matrix")
            x = np.ascontiguousarray(np.asarray(vec.flatten(), dtype=np.float64).reshape(len(keys), -1))
            name = f"{folder}/{uuid.uuid4().hex}.npy"
            with _opened(name, "w") as f:
                np.lib.format.write_array_header_1_0(f, np.lib.format.header_data_from_array_1_0(x))
                f.write(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(np.arange(len(keys), dtype=np.int64)), keys],
                                             names=["file", "row", "key"])

    out = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return write_table(out.mapInArrow(run, "file string, row long, key string"), "matrix-rows")
