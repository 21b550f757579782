"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length.  A source's target is met by whole
copies of the source plus a rest; the rest is dealt over the lengths in proportion, and a
bounded-knapsack dynamic programme over the lengths' spare documents fills what remains of
the budget.  Within a length, documents are selected by a seeded hash of their id.
"""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proxima.llm.common import columns_of, free_name, join_groups, write_table
from proxima.session import ship_package

WEIGHTS = (3, 1, 2)  # by the source's place, repeating
SHARE = Fraction(3, 2)  # of all tokens
MOST = 2  # copies of a document
SEED = 42
DP_BUDGET = 1 << 15  # tokens that the dynamic programme fits exactly
RANK_ROWS = 2048  # documents ranked together


def token_count(text):
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: Fraction = SHARE, most: int = MOST) -> list[float]:
    """Tokens of each source: ``share`` of all, by weight; no source above ``most`` times its
    size, the excess shared again by weight among the others."""
    left, out = share * sum(sizes), [Fraction(0)] * len(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    open_ = list(range(len(sizes)))
    while open_:
        unit = left / sum(weight[i] for i in open_)
        full = [i for i in open_ if unit * weight[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weight[i]
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return [float(x) for x in out]


def knapsack(lengths: list[int], spare: list[int], budget: int) -> list[int]:
    """How many of each length (at most ``spare``) to take so that their sum is as close
    below ``budget`` as can be.  The reachable sums are the bits of one integer."""
    reach, states, limit = 1, [], (1 << (budget + 1)) - 1
    for i, (size, n) in enumerate(zip(lengths, spare)):
        n, part = min(n, budget // size) if size else 0, 1
        while n > 0 and not reach >> budget & 1:
            part = min(part, n)
            states.append((i, part, reach))
            reach |= reach << (size * part) & limit
            n, part = n - part, part * 2
        if reach >> budget & 1:
            break
    at, take = reach.bit_length() - 1, [0] * len(lengths)
    for i, part, before in reversed(states):
        if not before >> at & 1:
            take[i] += part
            at -= lengths[i] * part
    return take


def fit(lengths: list[int], counts: list[int], budget: int, dp_budget: int = DP_BUDGET) -> list[int]:
    """How many documents of each length to select so that their lengths sum to about
    ``budget``: the proportional share, the largest remainders, then the knapsack."""
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    take = [min(n, n * budget // total) for n in counts]
    rest = [(n * budget % total, i) for i, n in enumerate(counts)]
    left = budget - sum(a * b for a, b in zip(lengths, take))
    for _, i in sorted(rest, key=lambda x: (-x[0], lengths[x[1]])):
        if left <= dp_budget:
            break
        if take[i] < counts[i] and lengths[i] <= left - dp_budget // 2:
            take[i] += 1
            left -= lengths[i]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left <= dp_budget:
            break
        if lengths[i]:
            more = min(counts[i] - take[i], left // lengths[i])
            take[i] += more
            left -= more * lengths[i]
    if 0 < left <= dp_budget:
        order = sorted((i for i in range(len(lengths)) if 0 < lengths[i] <= left and take[i] < counts[i]), key=lambda i: -lengths[i])
        for i, n in zip(order, knapsack([lengths[i] for i in order], [counts[i] - take[i] for i in order], left)):
            take[i] += n
    return take


def _fit_source(dp_budget: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
        size, target = int(pdf.source_size[0]), float(pdf.target[0])
        whole = min(MOST, int(target // size)) if size else 0
        pdf["whole"] = whole
        pdf["chosen"] = fit(pdf["size"].tolist(), pdf["n"].tolist(), round(target - whole * size), dp_budget)
        return pdf[["source", "size", "n", "source_size", "target", "whole", "chosen"]]

    return run


def mix_plan(rows: DataFrame, weights=WEIGHTS, share: Fraction = SHARE, dp_budget: int = DP_BUDGET) -> DataFrame:
    """(source, size, n, source_size, target, whole, chosen) from rows (source, size): every
    document of the class is taken ``whole`` times, ``chosen`` of its ``n`` once more."""
    spark = rows.sparkSession
    ship_package(spark)
    hist = write_table(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-lengths")
    sums = [(r.source, r.tokens) for r in hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("tokens")).collect()]
    sums.sort(key=lambda x: (x[0] is None, x[0] or ""))  # one row a source, as the weights are given
    goal = targets([n for _, n in sums], weights, share)
    t = spark.createDataFrame([(s, int(n), g) for (s, n), g in zip(sums, goal)], "_s string, source_size long, target double")
    return hist.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").groupBy("source").applyInPandas(
        _fit_source(dp_budget), "source string, size long, n long, source_size long, target double, whole int, chosen long")


def decide(rows: DataFrame, seed: int = SEED, weights=WEIGHTS, share: Fraction = SHARE, dp_budget: int = DP_BUDGET,
           rank_rows: int = RANK_ROWS) -> DataFrame:
    """``rows`` (id, source, size; a written table) plus source_size, target, copies.

    A class's documents are dealt by their seeded hash into runs of about ``rank_rows``; runs
    below the wanted number are taken whole, and only the run it falls into is ranked."""
    total = rows.count()
    plan = write_table(mix_plan(rows, weights, share, dp_budget), "mix-plan")
    runs = F.ceil(F.col("n") / rank_rows)
    h = F.xxhash64(F.lit(seed), "id")
    run = F.floor(F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53)) * runs).cast("long")
    joined = join_groups(rows, plan, ["source", "size"], "n", total).withColumns({"h": h, "run": run})
    joined = joined.withColumn("partly", (F.col("chosen") > 0) & (F.col("chosen") < F.col("n")))
    joined = write_table(joined, "mix-rows")
    whole = joined.where(~F.col("partly")).withColumn("copies", F.col("whole") + F.when(F.col("chosen") > 0, 1).otherwise(0))
    part = joined.where("partly")
    cls = F.struct(F.col("source"), F.col("size"))
    sizes = part.groupBy("source", "size", "run").agg(F.count("*").alias("here"), F.first("chosen").alias("c"))
    before = F.sum("here").over(Window.partitionBy("source", "size").orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(cls.alias("_cls"), F.col("run").alias("_run"), (F.col("c") - F.coalesce(before, F.lit(0))).alias("want"))
    part = part.join(sizes, cls.eqNullSafe(F.col("_cls")) & (F.col("run") == F.col("_run")))
    place = F.row_number().over(Window.partitionBy("source", "size", "run").orderBy(F.shiftrightunsigned("h", 11), "h", "id"))
    part = part.withColumn("copies", F.col("whole") + F.when(place <= F.col("want"), 1).otherwise(0))
    cols = ["id", "source", "size", "source_size", "target", "copies"]
    return whole.select(*cols).unionByName(part.select(*cols))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED,
        weights=WEIGHTS, share: Fraction = SHARE, dp_budget: int = DP_BUDGET) -> DataFrame:
    """Per document: ``id_col``, size (tokens), source_size, target (tokens of its source),
    taken (tokens the mix takes, repeats counted).

    Sources are ordered by code point, a null source is one of its own and last.  Null and
    empty texts have size 0 and add nothing.  Repeated rows are documents of their own; rows
    with the same id, source and size are interchangeable.  Null ids are ranked like any
    other.  Other columns are ignored; an empty table gives none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col)).alias("size"))
    out = decide(write_table(rows, "mix-sizes"), seed, weights, share, dp_budget)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED,
             weights=WEIGHTS, share: Fraction = SHARE, dp_budget: int = DP_BUDGET) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as chosen, all columns kept.
    Documents without words cost nothing; they stay once, but for classes taken twice."""
    c, k, n = free_name(docs, "_copies"), free_name(docs, "_key"), free_name(docs, "_times")
    all_columns = columns_of(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col)).alias("size"))
    decided = decide(write_table(rows, "mix-sizes"), seed, weights, share, dp_budget)
    decided = decided.withColumn("copies", F.when(F.col("size") == 0, F.greatest("copies", F.lit(1))).otherwise(F.col("copies")))
    agreed = decided.groupBy("id", "source", "size").agg(F.count("*").alias("m"), F.sum("copies").alias("s")).where("s > 0")
    agreed = write_table(agreed.select(F.struct("id", "source", "size").alias(k), F.struct("m", "s").alias(c)), "mix-copies")
    # tokens are counted once for each row, before the join sorts by them; a merge join at every size
    counted = docs.withColumn(n, token_count(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(f"{k}.id")) & F.col(source_col).cast("string").eqNullSafe(F.col(f"{k}.source")) & (F.col(n) == F.col(f"{k}.size"))
    met = counted.join(agreed.hint("merge"), same)
    each = F.floor(F.col(f"{c}.s") / F.col(f"{c}.m"))
    even = met.where(F.col(f"{c}.s") % F.col(f"{c}.m") == 0)
    out = even.withColumn(c, F.explode(F.sequence(F.lit(1), each))).select(*all_columns)
    odd = F.col(f"{c}.s") % F.col(f"{c}.m") != 0
    if agreed.where(odd).isEmpty():
        return out
    place = F.row_number().over(Window.partitionBy(k).orderBy(F.xxhash64(text_col)))
    odd = met.where(odd).withColumn(n, each + F.when(place <= F.col(f"{c}.s") % F.col(f"{c}.m"), 1).otherwise(0)).where(F.col(n) > 0)
    return out.unionByName(odd.withColumn(c, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*all_columns))
