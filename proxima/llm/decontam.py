"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, a scan of all
document windows, verified hits, and removal of spans or documents.

A window is ``WINDOW`` consecutive normalised words of a benchmark item, or the whole item
if it has fewer.  Words become small integers (the benchmark's vocabulary), so a document
is one integer array; a rolling hash over it finds candidate windows by a sorted lookup,
and each candidate's integers are then compared with the window itself.

The benchmark is packed into slices of at most ``SLICE_WINDOWS`` windows.  One slice is
broadcast at a time, so what a task holds is bounded however large the benchmark is; with
more slices the scan runs once for each and adds to the marks.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import arrow_column, block_words, free_name, lossless_bytes, write_table

WINDOW = 13
SLICE_WINDOWS = 1 << 20
SHARE = 20  # contaminated from one hit word in so many

#: every byte that is no word character becomes a space, A-Z become a-z
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_NOT_WORD = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_BASE = np.uint64(0x9E3779B97F4A7C15)

RESULT = "struct<n_words: bigint, n_hit: bigint, n_items: bigint, items_sha256: string, contaminated: boolean>"
MARKS = "struct<n_words: bigint, starts: array<bigint>, ends: array<bigint>, items: array<string>>"


def words_of(b: bytes) -> list[bytes]:
    return b.translate(_WORD_BYTES).split()


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for j in range(n):
        h = h * _BASE + ids[j:len(ids) - n + 1 + j]
    return h


@dataclass
class WindowIndex:
    """The hash set of one slice: per window length the sorted hashes, the windows' word
    ids (for verifying) and the items each window occurs in."""

    vocab: dict[bytes, int] = field(default_factory=dict)
    lengths: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[int, ...]]]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)

    @classmethod
    def build(cls, windows: list[tuple[str, bytes]]) -> WindowIndex:
        """From (item id, space-joined window) pairs."""
        out, names, found = cls(), {}, {}
        for item, window in windows:
            ids = tuple(out.vocab.setdefault(w, len(out.vocab) + 1) for w in window.split(b" "))
            found.setdefault(len(ids), {}).setdefault(ids, set()).add(names.setdefault(item, len(names)))
        out.names = list(names)
        for n, by_ids in found.items():
            grams = np.array(list(by_ids), np.uint64).reshape(-1, n)
            hashes = np.concatenate([_rolling(g, n) for g in grams])
            order = np.argsort(hashes, kind="stable")
            items = [tuple(sorted(x)) for x in by_ids.values()]
            out.lengths[n] = hashes[order], grams[order], [items[i] for i in order]
        return out

    def scan(self, ids: np.ndarray):
        """Verified occurrences in a document's word ids (0: not in the vocabulary):
        (start, length, item numbers)."""
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for n, (hashes, grams, items) in self.lengths.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(known[n:] - known[:-n] == n)  # windows of known words only
            if not len(at):
                continue
            h = _rolling(ids, n)[at]
            lo, hi = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for i in np.flatnonzero(lo < hi):
                for k in range(lo[i], hi[i]):
                    if np.array_equal(ids[at[i]:at[i] + n], grams[k]):
                        yield int(at[i]), n, items[k]

    def marks(self, text: bytes | None):
        """(number of words, merged hit spans as starts and ends, item ids)."""
        spans, items, n, ids = [], set(), 0, np.zeros(0, np.uint64)
        keep = max(self.lengths, default=1) - 1
        get = self.vocab.get
        for piece in block_words(text or b"", sep=_NOT_WORD):
            found = [get(w, 0) for w in words_of(piece)]
            n += len(found)
            ids = np.concatenate([ids[len(ids) - min(keep, len(ids)):], np.array(found, np.uint64)])
            first = n - len(ids)
            for at, length, numbers in self.scan(ids):
                spans.append((first + at, first + at + length))
                items.update(numbers)
        return n, merge_spans(spans), {self.names[i] for i in items}


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (item string, window string) of a benchmark.  Items without words have no
    window; a null item id reads as the empty string."""
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))
    b = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words.alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    grams = F.transform(starts, lambda i: F.array_join(F.slice("w", i, F.lit(window)), " "))
    return b.where(F.size("w") > 0).select("item", F.explode(grams).alias("window")).distinct()


def slices(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW,
           limit: int = SLICE_WINDOWS):
    """Broadcast indexes that cover the benchmark, at most about ``limit`` windows each."""
    spark = benchmark.sparkSession
    w = write_table(benchmark_windows(benchmark, item_col, text_col, window), "benchmark-windows")
    parts = max(1, -(-w.count() // limit))
    for p in range(parts):
        rows = w.where(F.pmod(F.xxhash64("item", "window"), F.lit(parts)) == p).collect()  # bounded by ``limit``
        yield spark.sparkContext.broadcast(WindowIndex.build([(r.item, r.window.encode()) for r in rows]))


def _mark_column(spark, index):
    def batches(it):
        ix = index.value
        for texts in it:
            n, starts, ends, items = [], [], [], []
            for t in texts:
                k, spans, names = ix.marks(t.as_py())
                n.append(k)
                starts.append([a for a, _ in spans])
                ends.append([z for _, z in spans])
                items.append(sorted(names))
            big = pa.list_(pa.int64())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(starts, big), pa.array(ends, big),
                                              pa.array(items, pa.list_(pa.string()))], names=["n_words", "starts", "ends", "items"])

    return arrow_column(spark, batches, MARKS)


def with_marks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "marks", item_col: str = "item_id",
               bench_text_col: str = "text", window: int = WINDOW, limit: int = SLICE_WINDOWS) -> DataFrame:
    """``docs`` plus struct ``out``: n_words, hit spans (word positions, merged per slice),
    items.  One narrow pass for each benchmark slice, written between passes."""
    spark = docs.sparkSession
    done = None
    for index in slices(benchmark, item_col, bench_text_col, window, limit):
        fn = _mark_column(spark, index)
        if done is None:
            done = docs.withColumn(out, fn(lossless_bytes(F.col(text_col))))
            continue
        more = free_name(done, "_more")
        done = write_table(done, "decontam-marks").withColumn(more, fn(lossless_bytes(F.col(text_col))))
        both = {c: F.concat(f"{out}.{c}", f"{more}.{c}") for c in ("starts", "ends", "items")}
        done = done.withColumn(out, F.struct(F.col(f"{out}.n_words").alias("n_words"), *[v.alias(c) for c, v in both.items()])).drop(more)
    return done


def _verdict_column(spark):
    """n_hit, n_items, items_sha256, contaminated from the marks (spans of several slices
    may overlap)."""
    def batches(it):
        for m in it:
            rows = m.to_pylist()
            hit = [sum(z - a for a, z in merge_spans(list(zip(r["starts"], r["ends"])))) for r in rows]
            items = [sorted(set(r["items"])) for r in rows]
            n = [r["n_words"] for r in rows]
            yield pa.StructArray.from_arrays([
                pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]),
                pa.array([h > 0 and SHARE * h >= k for h, k in zip(hit, n)], pa.bool_())],
                names=["n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return arrow_column(spark, batches, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", bench_text_col: str = "text", window: int = WINDOW,
                  limit: int = SLICE_WINDOWS) -> DataFrame:
    """Per document: ``id_col``, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and is clean (its items digest is that of the empty
    string).  Repeated rows stay; null ids stay.  An empty benchmark hits nothing.  A
    repeated item id counts once; other columns are ignored."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marked = with_marks(src, benchmark, "text", "m", item_col, bench_text_col, window, limit).select("id", "m")
    return marked.select(F.col("id").alias(id_col), _verdict_column(docs.sparkSession)("m").alias("v")).select(id_col, "v.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the contaminated rows; all columns and clean rows stay."""
    m = free_name(docs, "_marks")
    marked = with_marks(docs, benchmark, text_col, m, **kw)
    return marked.withColumn(m, _verdict_column(docs.sparkSession)(m)).where(~F.col(f"{m}.contaminated")).drop(m)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with every hit word and the separators inside hit spans cut out of the text;
    what stands before and after a cut span is joined by one space."""
    spark = docs.sparkSession
    m = free_name(docs, "_marks")

    def cut(text: bytes | None, starts, ends):
        if text is None or not starts:
            return text
        at = [(w.start(), w.end()) for w in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", text)]
        out, pos = [], 0
        for a, z in merge_spans(list(zip(starts, ends))):
            out.append(text[pos:at[a][0]].rstrip())
            pos = at[z - 1][1]
        return b" ".join(x for x in [*out, text[pos:].lstrip()] if x)

    def batches(it):
        for s in it:
            rows = s.to_pylist()
            yield pa.array([None if (c := cut(r["t"], r["s"], r["e"])) is None else c.decode() for r in rows], pa.string())

    fn = arrow_column(spark, batches, "string")
    marked = with_marks(docs, benchmark, text_col, m, **kw)
    new = fn(F.struct(lossless_bytes(F.col(text_col)).alias("t"), F.col(f"{m}.starts").alias("s"), F.col(f"{m}.ends").alias("e")))
    return marked.withColumn(text_col, new).drop(m)
