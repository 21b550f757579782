"""Helpers shared by the training-data operators.

Python column functions here are Arrow functions: Spark sends only the text column to the
worker, batch by batch, and keeps every other column on the JVM side.  They are marked
non-deterministic so that the optimiser neither runs them twice nor moves them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proxima.session import ship_package, write_table

__all__ = ["arrow_column", "block_words", "columns_of", "fit_logistic", "free_name", "join_groups", "labelled_sample", "lossless_bytes", "remainder",
           "segments_of", "table", "write_table"]

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def lossless_bytes(text: Column) -> Column:
    """The UTF-8 bytes of a text column; Python functions over it never decode."""
    return text.cast("string").cast("binary")


def arrow_column(spark: SparkSession, batch_function, schema: str):
    """``batch_function(iterator of Arrow arrays) -> iterator of Arrow arrays`` as a column
    function whose result has the SQL type ``schema``."""
    ship_package(spark)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from batch_function(it)

    return F.arrow_udf(run, schema).asNondeterministic()


def block_words(b: bytes, block: int = 1 << 20, sep: re.Pattern = _SPACE) -> Iterator[bytes]:
    """Cut ``b`` into consecutive pieces of about ``block`` bytes, only at separators, so
    that the pieces' words are the text's words.  A word longer than a block stays whole."""
    n = len(b)
    if n <= block:
        yield b
        return
    start = 0
    while start < n:
        m = sep.search(b, start + block) if start + block < n else None
        end = m.start() if m else n
        yield b[start:end]
        start = end


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int, hot: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row per group, null keys meeting each other.  Groups
    of more than 1/``hot`` of all ``total`` rows (at most ``hot`` of them, so they can be
    broadcast) are joined without moving their rows; the others by a shuffle on the keys."""
    groups = groups.select(*[F.col(c).alias(f"_g_{c}") if c in keys else F.col(c) for c in groups.columns])
    is_hot = F.col(n) * hot > total
    on = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    drop = [f"_g_{k}" for k in keys]
    few = F.broadcast(groups.where(is_hot))
    cold = rows.join(F.broadcast(groups.where(is_hot).select(*drop)), on, "left_anti")
    return rows.join(few, on).drop(*drop).unionByName(cold.join(groups.where(~is_hot), on).drop(*drop))


def remainder(id_col: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def segments_of(text: Column, seed: Column, size: int, most: int) -> Column:
    """At most ``most`` stretches of ``size`` characters, spread evenly over a text from a
    seeded offset; all of a text that has no more."""
    n = F.greatest(F.ceil(F.char_length(text) / size), F.lit(1))
    k = F.least(n, F.lit(most))
    u = F.pmod(seed, F.lit(1024)) / 1024.0
    return F.transform(F.sequence(F.lit(0), (k - 1).cast("int")),
                       lambda i: F.substring(text, (F.floor((i + u) * n / k) * size + 1).cast("int"), F.lit(size)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text", size: int = 512, most: int = 8):
    """A bounded sample for fitting a classifier on the driver: for each value 0 and 1 of
    ``label`` at most ``per_class`` distinct texts (by seeded hash of the id), each as at most
    ``most`` segments of ``size`` characters.  Ids with contradicting labels are left out.

    Returns (list of (label, segments) in hash order, {label: number of labelled ids})."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")) \
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("_m")).where("label = _m").drop("_m")
    known = write_table(known.where(train(F.col("id"))).withColumn("h", F.xxhash64(F.lit(seed), "id")), "labelled")
    totals = {r.label: r["count"] for r in known.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    chosen = None
    for value in totals:
        top = known.where(F.col("label") == value).orderBy("h", "id").limit(per_class)
        chosen = top if chosen is None else chosen.unionByName(top)
    if chosen is None:
        return [], {}
    ids = write_table(chosen, "sampled-ids")  # at most 2 * per_class rows
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    met = text.join(F.broadcast(ids), "id").select("label", "h", segments_of(F.coalesce("text", F.lit("")), F.col("h"), size, most).alias("parts"))
    rows = met.groupBy("label", "h").agg(F.min("parts").alias("parts")).groupBy("label", "parts").agg(F.min("h").alias("h")).collect()
    return [(r.label, list(r.parts)) for r in sorted(rows, key=lambda r: (r.h, r.label))], totals


def fit_logistic(x, y, weight, ridge: float = 1e-3, rounds: int = 60):
    """Weighted logistic regression by Newton steps on standardised features: (coefficients
    for the raw features, intercept)."""
    mean, sd = np.average(x, axis=0, weights=weight), np.sqrt(np.average((x - np.average(x, axis=0, weights=weight)) ** 2, axis=0, weights=weight)) + 1e-12
    z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
    w, total = np.zeros(z.shape[1]), weight.sum()
    prior = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    w[-1] = np.log(prior / (1 - prior))
    pen = np.full(len(w), ridge)
    pen[-1] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        g = z.T @ (weight * (y - p)) / total - pen * w
        h = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z / total + np.diag(pen + 1e-9)
        step = np.linalg.solve(h, g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    coef = w[:-1] / sd
    return coef, float(w[-1] - coef @ mean)
