"""Quality, language and toxicity models: held-out accuracy, exact recursions, edge rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proxima.llm import langid as L
from proxima.llm import quality as Q
from proxima.llm import toxicity as T
from proxima.llm.common import table

SF = "/root/testdata/sf0.01"
EDGES = [(None, "no id"), (1, None), (2, ""), (3, " \n"), (4, "123 !!"), (5, "a" * 200000), (6, "twice"), (6, "twice")]


def edges(spark):
    return spark.createDataFrame([(*r, "x", 0.5) for r in EDGES], "doc_id long, text string, lang string, score double")


def labels_of(rows):
    return "doc_id long, quality int, toxic int", rows


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def test_quality_on_held_out_rows(spark, docs, labels):
    m = Q.fit(docs, labels, lambda i: ~Q.held_out(i))
    r = Q.classify(docs, m).join(labels, "doc_id").where(Q.held_out(F.col("doc_id"))).toPandas()
    assert (r.predicted == r.quality).mean() > 0.9
    assert r.score[r.quality == 1].mean() > r.score[r.quality == 0].mean() + 0.4
    out = Q.classify(edges(spark), m).collect()
    assert len(out) == len(EDGES) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in out)
    assert len({x.score for x in out if x.doc_id in (1, 2)}) == 1
    assert Q.keep_good(edges(spark), m).columns == ["doc_id", "text", "lang", "score"]


def test_toxicity_on_held_out_rows(spark, docs, labels):
    m = T.fit(docs, labels, lambda i: ~T.held_out(i))
    r = T.tag(docs, m).join(labels, "doc_id").where(T.held_out(F.col("doc_id"))).toPandas()
    assert r.predicted[r.toxic == 0].mean() <= 0.02 and r.predicted[r.toxic == 1].mean() > 0.6
    out = T.tag(edges(spark), m).collect()
    assert len(out) == len(EDGES) and all(0 <= x.score <= 1 for x in out)
    assert T.drop_toxic(edges(spark), m).count() == len(EDGES)
    word = max(m.weights, key=m.weights.get)[2:]
    text = "Éa ıx. " + word.upper() + " b"
    (one,) = T.tag(spark.createDataFrame([(1, text)], "doc_id long, text string"), m).collect()
    assert all(text[s.start:s.end].lower() == word for s in one.spans)


@pytest.mark.parametrize("fit, label", [(Q.fit, "quality"), (T.fit, "toxic")])
def test_models_without_labels(spark, docs, fit, label):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, None, None), (None, 1, 1), (4, 0, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    run = Q.classify if fit is Q.fit else T.tag
    assert {r.score for r in run(docs, fit(docs, none)).limit(20).collect()} == {0.5}
    assert {r.score for r in run(docs, fit(docs, one)).limit(20).collect()} == {0.75}
    empty = docs.limit(0)
    assert run(empty, fit(empty, one)).collect() == []


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        u, a = rng.normal(size=n), rng.normal(size=(2, 2))
        weight = {s: np.exp(sum(u[t] * s[t] for t in range(n)) + sum(a[s[t], s[t + 1]] for t in range(n - 1))) for s in itertools.product((0, 1), repeat=n)}
        z = sum(weight.values())
        want = [sum(w for s, w in weight.items() if s[t]) / z for t in range(n)]
        unary, real = np.zeros((1, T.CHAIN)), np.zeros((1, T.CHAIN), bool)
        unary[0, :n], real[0, :n] = u, True
        assert np.allclose(T.marginals(unary, real, a)[0, :n], want)
        p, pair = T._pair_marginals(unary, real, a)
        for t in range(n - 1):
            got = [[sum(w for s, w in weight.items() if s[t] == i and s[t + 1] == j) / z for j in (0, 1)] for i in (0, 1)]
            assert np.allclose(pair[0, t], got)


def test_tagging_does_not_depend_on_the_batch():
    m = T.ToxicityModel({"w:bad": 8.0}, -4.0, np.array([[0.0, -0.5], [0.2, 0.7]]), np.array([1.0, 0.5, 1.0]), 0.3)
    texts = ["bad good " * i for i in (0, 1, 64, 65, 500)] + [None, "", "x"]
    together, spans = T.Tagger(m).tag(texts)
    for t, s, sp in zip(texts, together, spans):
        (alone,), (sp1,) = T.Tagger(m).tag([t])
        assert alone == pytest.approx(s) and sp1 == sp


def test_spans_after_letters_that_change_length():
    m = T.ToxicityModel({"w:bad": 12.0}, -6.0)
    for text in ("\u0130x ok bad", "\u0130x bad ok yes", "BAD \u0130 bad", "x " * 70000 + "\u0130 bad " + "y " * 70000 + "bad"):
        _, (spans,) = T.Tagger(m).tag([text])
        assert [text[a:b].lower() for a, b in spans] == ["bad"] * text.lower().count("bad")
        assert len(T.Tagger(m).values_of(text)) == len(T._TOKEN.findall(text))


def test_a_very_long_text_is_tagged_in_bounded_memory():
    import tracemalloc
    text = "some plain words and one bad word among them, " * 100_000  # 4.6 MB, 900,000 tokens
    tracemalloc.start()
    (score,), (spans,) = T.Tagger(T.ToxicityModel({"w:bad": 12.0}, -6.0)).tag([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(spans) == 100_000 and peak < 200e6


# ---------------------------------------------------------------- language

def slow_log_probability(word, prob):
    """Sum over all segmentations of a byte string by plain recursion."""
    total = [1.0] + [0.0] * len(word)
    for e in range(1, len(word) + 1):
        total[e] = sum(total[s] * prob.get(word[s:e], 0.0) for s in range(e))
    return np.log(total[-1])


def small_pieces(seed, langs=2):
    rnd = random.Random(seed)
    by = [sorted({b"a"[0], b"b"[0], b" "[0]})] + [sorted({int.from_bytes(bytes(rnd.choice(b"ab ") for _ in range(k)), "big") for _ in range(4)}) for k in range(2, 9)]
    keys = [np.array(x, np.uint64) for x in by]
    prob = [np.array([[rnd.random() / 20 for _ in range(langs)] for _ in x]) for x in by]
    return L.Pieces(keys, prob)


def test_forward_sums_all_segmentations():
    pieces = small_pieces(1)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.choice([1, 3, 8, 9, 13, 25, 40]))) for _ in range(60)]
    got = pieces.log_words([L.spell(w) for w in words])
    for i in range(2):
        prob = {int(k).to_bytes(n + 1, "big"): float(p[i]) for n, (ks, ps) in enumerate(zip(pieces.keys, pieces.prob)) for k, p in zip(ks, ps)}
        assert np.allclose(got[:, i], [slow_log_probability(L.spell(w), prob) for w in words])


def test_expected_counts_equal_enumeration():
    pieces = small_pieces(3, 1)
    word = b" abab"
    prob = {int(k).to_bytes(n + 1, "big"): float(p[0]) for n, (ks, ps) in enumerate(zip(pieces.keys, pieces.prob)) for k, p in zip(ks, ps)}
    want, z = {}, 0.0
    for cuts in itertools.product((0, 1), repeat=len(word) - 1):
        parts, cur = [], word[:1]
        for c, b in zip(cuts, word[1:]):
            if c:
                parts, cur = parts + [cur], b""
            cur += bytes([b])
        parts.append(cur)
        w = np.prod([prob.get(p, 0.0) for p in parts])
        z += w
        for p in parts:
            want[p] = want.get(p, 0.0) + w
    got = pieces.expected([word], np.array([3.0]), 0)
    flat = {int(k).to_bytes(n + 1, "big"): v for n, (ks, vs) in enumerate(zip(pieces.keys, got)) for k, v in zip(ks, vs) if v}
    assert flat == pytest.approx({p: 3 * v / z for p, v in want.items() if v})


def test_very_long_words_do_not_underflow():
    m = L.LanguageModel(["x", "y"], L.Pieces(L.read_vocabulary(), [np.full((len(k), 2), 1e-5) for k in L.read_vocabulary()]))
    lang, sure = m.scorer()(["a" * 5000, None, "12", "É"])
    assert lang == ["x", "und", "und", "x"] and sure[0] == pytest.approx(0.5) and sure[1] == 0


def test_a_long_word_is_scored_in_bounded_memory():
    import tracemalloc
    pieces, rnd = small_pieces(4), random.Random(9)
    word = L.spell("".join(rnd.choice("ab") for _ in range(300_000)))
    tracemalloc.start()
    (got,) = pieces.log_words([word])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(got).all() and peak < 20e6
    keep, L.WINDOW = L.WINDOW, 16
    try:
        words = [L.spell("".join(rnd.choice("ab") for _ in range(n))) for n in (1, 7, 15, 16, 17, 40, 333)]
        small = pieces.log_words(words)
    finally:
        L.WINDOW = keep
    assert np.allclose(small, pieces.log_words(words), rtol=1e-12)


def test_language_on_held_out_rows(spark, docs):
    m = L.fit(docs, lambda i: ~L.held_out(i), per_language=100)
    r = L.identify(docs, m).join(docs.select("doc_id", "lang"), "doc_id").where(L.held_out(F.col("doc_id"))).toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.95 and r.score.between(0, 1).all()
    out = {r.doc_id: r.lang_pred for r in L.identify(edges(spark), m).collect()}
    assert [out[i] for i in (1, 2, 3, 4)] == ["und"] * 4 and out[6] in m.langs and L.identify(edges(spark), m).count() == len(EDGES)


def test_language_without_training_rows(spark):
    empty = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    m = L.fit(empty)
    assert [tuple(r) for r in L.identify(empty, m).collect()] == [(1, "und", 0.0)]
    assert L.identify(empty.limit(0), m).collect() == []


def test_toxicity_odds_cross_the_chains():
    import numpy as np
    from proxima.llm import toxicity as T
    rng = np.random.default_rng(3)
    model = T.ToxicityModel({f"w:{w}": float(rng.normal(0, 4)) for w in "abcdefgh"}, -1.0, np.array([[1.5, -1.0], [-2.0, 2.5]]))
    docs = [[str(w) for w in rng.choice(list("abcdefgh"), n)] for n in (5, 0, 128, 129, 700, 1, 256, 4000)]
    for d, p in zip(docs, T.Tagger(model).token_probabilities(docs)):
        if d:
            u = np.array([[model.unary(w) for w in d]])
            assert np.abs(p - T.marginals(u, np.ones(u.shape, bool), model.trans)[0]).max() < 1e-9  # the document as one chain
        assert len(p) == len(d)
