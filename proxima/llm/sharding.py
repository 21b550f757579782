"""Sharding by a minimax contiguous partition of ordered atomic groups.

Equal texts form one group; groups are ordered by a 64-bit hash of their text.  The
smallest feasible shard capacity is found by binary search with a greedy check, and the
order is cut there.  The search runs over a summary of the order: at most ``CELLS`` cells
with their byte sums.  Cells hold several groups at first; those that a cut could fall into
at any capacity still in question are split into finer cells by one Spark aggregation, until
all such cells are single groups and the capacity is exact.  The driver thus holds a few
times ``CELLS`` numbers, whatever the number of groups.

A group larger than an even share fills a shard of its own; the other shards share the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proxima.llm.common import free_name, write_table

SHARDS = 24
ROW_BYTES = 8
CELLS = 1 << 16
RUN_ROWS = 2000  # rows numbered together


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def group_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


@dataclass
class Cells:
    """A summary of the ordered groups: first key, bytes and number of groups of each cell,
    and how many low key bits it spans."""

    low: np.ndarray
    size: np.ndarray
    groups: np.ndarray
    bits: np.ndarray

    def __post_init__(self):
        self.upto = np.concatenate(([0], np.cumsum(self.size)))


def greedy(c: Cells, shards: int, cap: int, divisible: bool) -> list[float] | None:
    """Cut positions (in bytes) when each shard is filled as far as ``cap`` allows; None if
    the shards don't suffice.  ``divisible``: cells of several groups may be cut anywhere."""
    total, x, cuts = c.upto[-1], 0, []
    for _ in range(shards):
        if total - x <= cap:
            return cuts
        j = int(np.searchsorted(c.upto, x + cap, "right")) - 1
        x_next = x + cap if divisible and c.groups[j] > 1 else c.upto[j]
        if x_next <= x:
            return None
        x = x_next
        cuts.append(x)
    return None


def capacity(c: Cells, shards: int, divisible: bool, low: int = 0) -> int:
    """Binary search for the smallest capacity at which ``greedy`` succeeds."""
    single = c.size[c.groups == 1] if divisible else c.size
    lo, hi = max(low, -(-int(c.upto[-1]) // shards), int(single.max(initial=0))), int(c.upto[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(c, shards, mid, divisible) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def open_cells(c: Cells, shards: int) -> np.ndarray:
    """Cells of several groups that a greedy cut could fall into at any capacity that may
    still be the smallest."""
    lo, hi = capacity(c, shards, True), capacity(c, shards, False)
    several = (c.groups > 1) & (c.bits > 0)
    if lo == hi or not several.any():
        return np.zeros(0, int)
    last = greedy(c, shards, hi, True) or []
    first, x = [], 0.0  # earliest possible cuts: whole cells only, one cell less where a cell is cut
    for _ in range(shards):
        j = int(np.searchsorted(c.upto, x + lo, "right")) - 1
        x = max(x, c.upto[max(0, min(j, len(c.size)))])
        first.append(x)
    hit = np.zeros(len(c.size), bool)
    for i in range(shards):
        a = first[i]
        z = last[i] if i < len(last) else c.upto[-1]
        hit |= (c.upto[1:] > a) & (c.upto[:-1] <= z)
    return np.flatnonzero(hit & several)


def cut_keys(c: Cells, shards: int) -> list[int]:
    """First keys of shards 2, 3, ...: within the smallest capacity, as near to even as the
    groups allow."""
    cap, n, upto = capacity(c, shards, False), len(c.size), c.upto
    latest, x = [], 0
    for _ in range(shards - 1):
        x = int(np.searchsorted(upto, upto[x] + cap, "right")) - 1
        latest.append(x)
    earliest, x = [0] * (shards - 1), n
    for i in reversed(range(shards - 1)):
        x = int(np.searchsorted(upto, upto[x] - cap, "left"))
        earliest[i] = max(0, x)
    cuts, at = [], 0
    for i in range(shards - 1):
        reach = int(np.searchsorted(upto, upto[at] + cap, "right")) - 1
        lo, hi = max(at, earliest[i]), min(reach, latest[i])
        goal = upto[at] + (upto[-1] - upto[at]) / (shards - i)
        j = int(np.searchsorted(upto, goal))
        j = j - 1 if j and (j > n or goal - upto[j - 1] < upto[j] - goal) else j
        at = min(max(j, lo), hi)
        cuts.append(at)
    return [int(c.low[i]) if i < n else None for i in cuts]


@dataclass
class Layout:
    """Which shard a group goes to."""

    own: dict[int, int]  # key of a large group -> its shard
    cuts: list[int | None]  # first keys of the later shards; None: empty from here on
    first: int  # shard of the first range

    def shard(self, key: Column) -> Column:
        out = F.lit(self.first)
        for k in self.cuts:
            if k is not None:
                out = out + (key >= F.lit(k)).cast("int")
        # equal cuts leave a shard empty between them: every cut counts
        for k, s in self.own.items():
            out = F.when(key == F.lit(k), F.lit(s)).otherwise(out)
        return out.cast("int")


def layout(groups: DataFrame, shards: int = SHARDS, cells: int = CELLS) -> Layout:
    """The minimax layout of ``groups`` (key, bytes; a written table, one row a group)."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    own, left = {}, shards
    for r in groups.orderBy(F.col("bytes").desc(), "key").limit(shards).collect():
        if left > 1 and r.bytes * left > total:
            own[r.key] = shards - left
            total -= r.bytes
            left -= 1
        else:
            break
    rest = groups.where(~F.col("key").isin(list(own))) if own else groups
    c = _cells(_summary(rest, 64 - (cells.bit_length() - 1)))
    while len(split := open_cells(c, left)):
        coarse = int(c.bits[split].max())
        split = split[c.bits[split] == coarse]
        keys = spark.createDataFrame([(int(c.low[i]) >> coarse,) for i in split], "_cell long")  # at most ``cells``
        inside = rest.join(F.broadcast(keys), F.shiftright("key", coarse) == F.col("_cell"), "left_semi")
        fine = _summary(inside, max(0, coarse - max(1, (cells // len(split)).bit_length() - 1)))
        keep = np.setdiff1d(np.arange(len(c.size)), split)
        c = _cells([(int(c.low[i]), int(c.size[i]), int(c.groups[i]), int(c.bits[i])) for i in keep] + fine)
    return Layout(own, cut_keys(c, left) if len(c.size) else [None] * (left - 1), len(own))


def _summary(groups: DataFrame, bits: int) -> list[tuple[int, int, int, int]]:
    cell = F.shiftright("key", bits) if bits else F.col("key")
    return [(r.cell << bits, r.bytes, r.n, bits) for r in groups.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")).collect()]


def _cells(rows: list[tuple[int, int, int, int]]) -> Cells:
    rows = sorted(rows)
    return Cells(*(np.array([r[i] for r in rows], np.int64) for i in range(4)))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, cells: int = CELLS,
          run_rows: int = RUN_ROWS) -> DataFrame:
    """Per document: ``id_col``, size (UTF-8 bytes plus 8), text_crc32, law ("bytes"), shard,
    slot (0, 1, ... without gaps within the shard), grown_shard (null under this law).

    Equal texts share a shard; null counts as the empty text.  Repeated rows have slots of
    their own; null ids come first in their run.  Other columns are ignored.  With fewer
    groups than shards some shards stay empty; an empty table gives no rows."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), size_of(text).alias("size"),
                       F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("crc"), group_key(text).alias("key"))
    rows = write_table(rows, "shard-rows")
    groups = write_table(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    placed = rows.withColumn("shard", layout(groups, shards, cells).shard(F.col("key")))
    runs = max(1, rows.count() // (shards * run_rows))
    placed = placed.withColumn("run", F.pmod(F.xxhash64("key", "id"), F.lit(runs)).cast("int"))
    counts = placed.groupBy("shard", "run").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("shard", "run", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "run").orderBy("id", "key", "size"))
    out = placed.join(counts, ["shard", "run"]).withColumn("slot", F.col("before") + place - 1)
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, text_col: str = "text", shards: int = SHARDS, cells: int = CELLS,
                 files_per_shard: int = 8) -> None:
    """Write ``docs`` as Parquet folders shard=0, shard=1, ... under ``path``."""
    text = F.col(text_col).cast("string")
    groups = write_table(docs.groupBy(group_key(text).alias("key")).agg(F.sum(size_of(text)).alias("bytes")), "shard-groups")
    s = free_name(docs, "shard")
    placed = docs.withColumn(s, layout(groups, shards, cells).shard(group_key(text)))
    placed.repartition(F.col(s), F.pmod(F.xxhash64(*docs.columns), F.lit(files_per_shard))).write.partitionBy(s).parquet(path)
