"""Decontamination against a brute-force version."""

import hashlib
import random
import re

from proxima.llm import decontam as D

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(t):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(rows, items, window=13):
    grams = {}
    for item, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    out = []
    for d, t in rows:
        w, hit, names = words(t), set(), set()
        for g, who in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    names |= who
        out.append((str(d), len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def corpus():
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(40)] + ["é", "Straße", "x9"]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(i, text(rnd.choice([13, 20, 30]))) for i in range(12)] + [(50, "Only Five words in here"), (51, "..."), (52, None), (2, text(15)),
                                                                       (None, text(14)), (60, "Solo")]
    rows = []
    for i in range(60):
        t = text(rnd.choice([0, 5, 30, 300, 900]))
        if rnd.random() < 0.5:
            w = words(rnd.choice(items[:12])[1])
            a = rnd.randrange(len(w))
            t = f"{t}, {'; '.join(w[a:a + rnd.randint(1, 30)]).upper() if rnd.random() < .5 else ' '.join(w)} {text(3)}"
        rows.append((i, t))
    rows += [(100, None), (101, ""), (102, "only five WORDS in-here, yes"), (103, "solo"), (104, "so lo"), (None, rows[3][1]), (3, rows[4][1])]
    return rows, items


def frames(spark, rows, items):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force_with_one_and_many_slices(spark):
    rows, items = corpus()
    docs, bench = frames(spark, rows, items)
    want = slow(rows, items)
    for limit in (1 << 20, 40):
        out = D.decontaminate(docs, bench, limit=limit).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out) == want


def test_hits_across_pieces_of_a_long_text(monkeypatch):
    rows, items = corpus()
    ix = D.WindowIndex.build([(str(i), " ".join(w[a:a + 13]).encode()) for i, t in items if t and (w := words(t)) for a in range(max(1, len(w) - 12))])
    long = " ".join(t for _, t in rows if t).encode()
    whole = ix.marks(long)
    orig = D.block_words
    monkeypatch.setattr(D, "block_words", lambda b, sep: orig(b, 64, sep))
    assert ix.marks(long) == whole


def test_drop_and_remove(spark):
    item = " ".join(f"k{i}" for i in range(15))
    rows = [(1, f"Before this: {item.upper()}! and after.", 7), (2, "clean", 8), (3, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _marks int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(D.drop_contaminated(docs, bench).collect()) == [(2, "clean", 8), (3, None, 9)]
    assert sorted(D.remove_spans(docs, bench).collect()) == [(1, "Before this: ! and after.", 7), (2, "clean", 8), (3, None, 9)]


def test_empty_tables(spark):
    docs, bench = frames(spark, [(1, "a b c")], [])
    assert [(r.n_words, r.n_hit, r.contaminated) for r in D.decontaminate(docs, bench).collect()] == [(3, 0, False)]
    docs, bench = frames(spark, [], [(1, "a")])
    assert D.decontaminate(docs, bench).collect() == []
