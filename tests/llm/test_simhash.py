"""SimHash near duplicates against a brute-force version."""

import re
import random

import numpy as np
import xxhash

from proxima.llm import simhash as S


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, radius=4):
    """(id, text) rows -> list of (id, hex fingerprint, component id)."""
    fps = [slow_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        ids = [x for x in (low.get(r), d) if x is not None]
        low[r] = min(ids) if ids else None
    return sorted((d if d is not None else -1, f"{f:016x}", low[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps)))


def corpus(n=160, seed=5):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeäé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    rows, texts = [], []
    for i in range(n):
        if texts and rnd.random() < 0.4:
            w = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 2)):
                if w:
                    w[rnd.randrange(len(w))] = rnd.choice(vocab)
            t = " ".join(w)
        else:
            t = "\t ".join(rnd.choice(vocab) for _ in range(rnd.choice([0, 1, 3, 4, 40, 200, 400])))
        texts.append(t)
        rows.append((i, t.upper() if rnd.random() < 0.1 and t.isascii() else t))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[3][1]), (5, rows[5][1]), (5, rows[6][1]), (1003, "one"), (1004, "x" * 5000)]
    return rows


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = S.near_duplicates(df, **kw).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in out)


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = corpus()
    assert result(spark, rows) == slow_components(rows)


def test_split_keys_lose_no_link(spark):
    rnd = random.Random(9)
    base = rnd.getrandbits(64)
    fps = {base}
    while len(fps) < 700:
        f = rnd.choice(sorted(fps)[:50]) if rnd.random() < 0.8 else rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 6)):
            f ^= 1 << rnd.randrange(64)
        fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    parent = {f: f for f in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(signed[i]), find(signed[j])
                parent[max(a, b)] = min(a, b)
    for tile in (16, 4096):
        comp = {r.node: r.root for r in S.components(S.candidate_forest(nodes, len(fps), 4, tile)).collect()}
        assert {f: comp.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_every_block_plan_finds_the_same_links(spark, monkeypatch):
    rows = corpus(80, 7)
    want = slow_components(rows)
    for blocks in (6, 7):
        monkeypatch.setattr(S, "plan_blocks", lambda n, radius=4, b=blocks: b)
        assert result(spark, rows) == want


def test_bit_sliced_distance_is_exact():
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 2**63, 3, dtype=np.uint64)
    fps = np.array([int(base[i % 3]) ^ sum(1 << int(b) for b in rnd.integers(0, 64, i % 8)) for i in range(300)], np.uint64)
    for radius in (0, 1, 3, 4, 7):
        e = S.link_runs(np.zeros(300, np.int64), np.zeros(300, np.int64), fps, radius)
        parent = np.arange(300)
        for i in range(300):
            for j in range(i):
                if bin(int(fps[i]) ^ int(fps[j])).count("1") <= radius:
                    a, b = parent[i], parent[j]
                    parent[parent == max(a, b)] = min(a, b)
        got = np.arange(300)
        got[e[:, 0]] = e[:, 1]
        assert (got == parent).all()


def test_long_text_is_read_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(30000))
    whole = S.fingerprint(text.encode())
    assert whole == slow_fingerprint(text)
    orig = S.block_words
    monkeypatch.setattr(S, "block_words", lambda b: orig(b, 100))
    assert S.fingerprint(text.encode()) == whole


def test_chain_of_many_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_keep_one_per_group(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, b + " c", "u"), (4, None, "v"), (5, "", "w"), (None, "alone here", "n"), (1, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").withColumnRenamed("fp", "_fp") \
        .selectExpr("*", "1 as lead_fp", "2 as id", "3 as `n.m`", "4 as lead", "5 as component_id")
    out = S.keep_one_per_group(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1, r["_fp"]) for r in out.collect())
    fp = {t: S.fingerprint((t or "").encode()) for _, t, _ in rows}
    near = bin(fp[b] ^ fp[b + " c"]).count("1") <= 4
    assert got == sorted([(-1, "n"), (1, "x"), (2, "z"), (4, "v")] + ([] if near else [(3, "u")]))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, fingerprint string")
    assert S.near_duplicates(df).collect() == []
    assert S.keep_one_per_group(df).collect() == []
