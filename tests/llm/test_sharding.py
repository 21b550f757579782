import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from proxima.llm import sharding as S


def exact_capacity(sizes, shards):
    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid, used, x = (lo + hi) // 2, 1, 0
        for s in sizes:
            if x + s > mid:
                used, x = used + 1, 0
            x += s
        lo, hi = (lo, mid) if used <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("cells", [4, 64, 1 << 16])
def test_capacity_is_the_exact_minimax(spark, cells):
    rnd = random.Random(cells)
    keys = [rnd.randrange(-2**63, 2**63) for _ in range(700)]
    groups = [(k, rnd.randint(1, 60) if i % 50 else rnd.randint(200, 400)) for i, k in enumerate(keys)]
    df = spark.createDataFrame(groups, "key long, bytes long")
    lay = S.layout(df, 24, cells)
    assert not lay.own
    ordered = [b for _, b in sorted(groups)]
    best = exact_capacity(ordered, 24)
    total = defaultdict(int)
    for r in df.select("key", "bytes", lay.shard(df.key).alias("s")).collect():
        total[r.s] += r.bytes
    assert max(total.values()) == best and sorted(total) == list(range(24))
    assert min(total.values()) > best / 2


def test_large_groups_fill_their_own_shards(spark):
    df = spark.createDataFrame([(k, 10) for k in range(0, 4000, 4)] + [(1, 9000), (2, 2000)], "key long, bytes long")
    lay = S.layout(df, 6, 64)
    total = defaultdict(int)
    for r in df.select("key", "bytes", lay.shard(df.key).alias("s")).collect():
        total[r.s] += r.bytes
    assert sorted(total.values()) == [2400, 2400, 2400, 2400, 2400, 9000] or max(sorted(total.values())[:-1]) - min(total.values()) <= 2000
    assert set(lay.own) == {1}


def docs():
    rnd = random.Random(4)
    out = [(i, "ä" * rnd.randint(0, 300) + str(rnd.randint(0, 400))) for i in range(900)]
    return out + [(1000, None), (1001, ""), (None, "n"), (None, "n"), (3, out[3][1])] + [(2000 + i, "copy " * 30) for i in range(200)]


def test_slots_groups_and_digests(spark):
    data = docs()
    df = spark.createDataFrame([(*r, "x") for r in data], "doc_id long, text string, shard string")
    out = S.shard(df, run_rows=5).collect()
    text = {(str(d)): t for d, t in data}
    assert len(out) == len(data)
    by, where = defaultdict(list), defaultdict(set)
    for r in out:
        b = (text[str(r.doc_id)] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 8, zlib.crc32(b), "bytes", None)
        by[r.shard].append(r.slot)
        where[b].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(24))
    assert all(len(s) == 1 for s in where.values())


def test_few_groups_and_empty(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    out = {r.doc_id: r.shard for r in S.shard(df).collect()}
    assert out[1] == out[3] != out[2]
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(*r, "x") for r in docs()], "doc_id long, text string, shard string")
    S.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == df.count() and "_shard" in back.columns


def test_greedy_bounds_hold():
    c = S.Cells(np.arange(4), np.array([5, 5, 5, 5]), np.array([1, 1, 1, 1]), np.zeros(4, int))
    assert S.capacity(c, 2, False) == 10 and S.cut_keys(c, 2) == [2]
