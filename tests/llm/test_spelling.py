"""Spelling variants against a plain comparison of every pair of words."""

import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from proxima.llm import spelling as S


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_words(rows):
    out = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def slow(rows):
    n = slow_words(rows)
    form, count = {}, {}
    for w in n:
        ns = sorted((-n[v], v) for v in n if near(w, v))
        count[w] = len(ns)
        form[w] = ns[0][1] if ns and -ns[0][0] >= 10 * n[w] else None
    out = []
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out.append((w, form[w], r, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out, key=lambda x: x[0])


def seen(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=lambda x: x[0])


def texts(seed, docs=300):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcéÉZ") for _ in range(rnd.randint(7, 9))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab"]

    def word():
        w = base[min(int(rnd.expovariate(0.25)), len(base) - 1)]
        if rnd.random() < 0.15:
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1:], w[:i] + rnd.choice("abc") + w[i:], w[:i] + rnd.choice("abc") + w[i + 1:]])
        return w.upper() if rnd.random() < 0.1 else w

    return [(i, " ".join(word() for _ in range(rnd.randint(0, 40))) + rnd.choice(["", ".", " 12x", "×"])) for i in range(docs)]


@pytest.mark.parametrize("tile", [4096, 3])
def test_equals_every_pair(spark, tile):
    rows = texts(5) + [(None, None), (None, "preface preface"), (3, ""), (4, "a" * 20000), (5, "a" * 19999 + "b"), (6, "a" * 20000), (7, "a" * 19999 + "b"), (8, "same words"), (8, "same words")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n int")
    got, want = seen(S.variants(df, tile=tile)), slow(rows)
    assert got == want
    assert any(r[1] for r in want) and max(r[4] for r in want) > 5


def test_chains_of_forms_end_at_the_last(spark):
    chain = ["variants"] * 2 + ["variantss"] * 20 + ["variantsss"] * 200 + ["variantssss"] * 2000
    words = spark.createDataFrame(list(Counter(chain).items()), "word string, n long")
    forms = S.near_words(words).selectExpr("word", "n", "case when best_n >= 10 * n then best end as form")
    got = dict(S.roots_of(forms, 10, 2000).collect())
    assert got == {w: "variantssss" for w in ("variants", "variantss", "variantsss")}


def test_groups_go_through_batches_of_any_size():
    rnd = random.Random(8)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(4, 6))) for _ in range(80)})
    rows = []
    for w in words:
        for less in (0, 1):
            m = len(w) - less
            rows += [(m, 0, w[:m // 2], 0, 0, 3, w, len(w)), (m, 1, w[len(w) - (m - m // 2):], 0, 0, 3, w, len(w))]
    rows.sort(key=lambda r: (*r[:5], -r[7], r[6]))
    t = pa.Table.from_pylist([dict(zip(("l", "side", "half", "ti", "tq", "role", "word", "n"), r)) for r in rows])
    want = {w: sum(near(w, v) for v in words) for w in words}
    for size in (1, 7, 10000):
        got = Counter()
        for b in S.answers(iter(t.to_batches(max_chunksize=size))):
            for w, k in zip(b.column("word").to_pylist(), b.column("near").to_pylist()):
                got[w] += k
        assert {w: got[w] for w in words} == want


def test_empty(spark):
    out = S.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert out.collect() == [] and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
