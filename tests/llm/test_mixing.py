import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from proxima.llm import mixing as M


def rows(n=500, seed=3):
    rnd = random.Random(seed)
    out = [(i, " \n".join("w" * rnd.randint(1, 4) for _ in range(rnd.choice([0, 1, 5, 5, 5, 30, 200, 999]))), rnd.choice(["a", "a", "b", "C", "é", None]), 1)
           for i in range(n)]
    return out + [(n, None, "a", 1), (None, "x y", "b", 1), (None, "x y", "b", 1), (7, "one two", "b", 1), (8, "\x0b", None, 1)]


def size(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_targets_are_the_water_filling():
    assert M.targets([100, 100, 100]) == [200.0, 250 / 3, 500 / 3]
    assert M.targets([10, 1000]) == [20.0, 1495.0]
    assert M.targets([0, 0]) == [0.0, 0.0]
    assert M.targets([]) == []
    rnd = random.Random(1)
    for _ in range(50):
        s = [rnd.randint(0, 1000) for _ in range(rnd.randint(1, 9))]
        t = M.targets(s)
        assert sum(t) == pytest.approx(1.5 * sum(s)) and all(x <= 2 * y for x, y in zip(t, s))
        unit = [x / [3, 1, 2][i % 3] for i, x in enumerate(t) if x < 2 * s[i]]
        assert not unit or max(unit) == pytest.approx(min(unit))


def test_knapsack_is_optimal():
    rnd = random.Random(2)
    for _ in range(100):
        n = rnd.randint(1, 5)
        lengths, spare = [rnd.randint(1, 30) for _ in range(n)], [rnd.randint(0, 3) for _ in range(n)]
        budget = rnd.randint(1, 90)
        sums = {0}
        for a, k in zip(lengths, spare):
            sums = {x + a * j for x in sums for j in range(k + 1)}
        take = M.knapsack(lengths, spare, budget)
        assert all(0 <= t <= k for t, k in zip(take, spare))
        assert sum(a * t for a, t in zip(lengths, take)) == max(x for x in sums if x <= budget)


@pytest.mark.parametrize("dp", [M.DP_BUDGET, 64])
def test_mix_meets_its_targets(spark, dp):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int")
    out = M.mix(df, dp_budget=dp).collect()
    by, taken, goal = defaultdict(int), defaultdict(int), {}
    assert sorted((str(r.doc_id), r["size"]) for r in out) == sorted((str(d), size(t)) for d, t, _, _ in data)
    for d, t, s, _ in data:
        by[s] += size(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, M.targets([by[s] for s in order])))
    source = {(str(d), size(t)): s for d, t, s, _ in data}
    for r in out:
        s = source[str(r.doc_id), r["size"]]
        assert r.source_size == by[s] and r.target == pytest.approx(want[s]) and r.taken in {0, r["size"], 2 * r["size"]}
        taken[s] += r.taken
        goal[s] = r.target
    for s in goal:
        assert abs(taken[s] - goal[s]) <= 1
    again = M.mix(df.repartition(5), dp_budget=dp).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_runs_of_a_hot_class_are_ranked_apart(spark):
    df = spark.createDataFrame([(i, "five words in every text", "s" if i % 3 else "t") for i in range(900)], "doc_id long, text string, source string")
    from proxima.llm.common import write_table
    r = write_table(df.selectExpr("doc_id id", "source", "5L size"), "t")
    a = M.decide(r, rank_rows=16).collect()
    b = M.decide(r, rank_rows=4096).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert abs(sum(x.copies for x in a) * 5 - 6750) <= 5


def test_take_mix_repeats_rows(spark):
    data = rows(200)
    df = spark.createDataFrame(data + data[-2:], "doc_id long, text string, source string, _copies int").withColumn("_times", F.lit("x")).withColumn("a.b", F.lit(1))
    got = M.take_mix(df)
    assert got.columns == df.columns
    n, want = defaultdict(int), defaultdict(int)
    assert {r["_times"] for r in got.collect()} == {"x"}
    for r in got.collect():
        n[str(r.doc_id), size(r.text)] += max(1, size(r.text))
    for r in M.mix(df).collect():
        want[str(r.doc_id), r["size"]] += r.taken
    assert all(n[k] == v for k, v in want.items() if k[1]) and all(n[k] >= 1 for k in want if not k[1])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(df).collect() == [] and M.take_mix(df).collect() == []
