"""Toxic spans by a linear-chain conditional random field.

Tokens are lower-case letter runs; their features are the word and its prefixes.  Token
labels for training come from document labels: a token of a toxic document is labelled
toxic if it carries a feature that many toxic and hardly any clean documents have; all
tokens of clean documents are labelled clean.  The field has two states and is trained by
maximum likelihood on chains of ``CHAIN`` tokens; a document is tagged as one whole: it is laid
out in such chains, and the odds are carried over their ends.

Forward-backward marginals give each token's probability.  A document's score is a logistic
function of the expected number and share of toxic tokens, calibrated on labelled documents
that trained no feature; tokens above one half are the offending offsets.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import arrow_column, fit_logistic, free_name, labelled_sample, remainder

CHAIN = 128
PREFIXES = range(3, 9)
PER_CLASS = 2500  # labelled documents that the model is fitted on, of either label
SEGMENT, SEGMENTS = 1500, 8  # characters, and stretches of that many, of each of them
THRESHOLD = 0.7
PLAIN_EVERY = 8  # of the training chains without a telling feature one in so many is used, weighted as many times
CACHED_WORDS, CACHED_LETTERS = 100_000, 64  # words that a worker remembers, and the longest of them
BATCH_TOKENS = 1 << 17  # places in the chains that are tagged together
BLOCK = 1 << 16  # characters that are cut into tokens at a time
ROWS_AT_ONCE = 500

_TOKEN = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")


def blocks_of(text: str):
    """(offset, stretch) of a text, cut only between tokens after about ``BLOCK`` characters."""
    at = 0
    while at < len(text):
        m = _GAP.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = m.start() if m else len(text)
        yield at, text[at:end]
        at = end


def found_in(stretch: str):
    """(the string to match in, whether it is lower case yet).  A capital dotted I becomes two
    characters in lower case and would shift offsets: such a stretch is lowered word by word."""
    low = stretch.lower()
    return (low, True) if len(low) == len(stretch) else (stretch, False)


def tokens_of(stretch: str) -> list[str]:
    """The lower-case letter runs of a stretch, in its order."""
    s, lowered = found_in(stretch)
    words = _TOKEN.findall(s)
    return words if lowered else [w.lower() for w in words]


def features_of(word: str) -> list[str]:
    return [f"w:{word}", *(f"p:{word[:k]}" for k in PREFIXES if len(word) > k)]


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # log weight of state i -> j
    coef: np.ndarray = field(default_factory=lambda: np.zeros(3))
    intercept: float = 0.0

    def unary(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(f, 0.0) for f in features_of(word))

    def scores(self, expected: np.ndarray, peak: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        x = document_features(expected, peak, tokens)
        return 1 / (1 + np.exp(-np.clip(x @ self.coef + self.intercept, -500, 500)))


def document_features(expected, peak, tokens) -> np.ndarray:
    return np.stack([np.log1p(expected), np.log((expected + 0.05) / (tokens + 10.0)), peak], axis=1)


def chains(lengths: np.ndarray, size: int = CHAIN):
    """Rows and columns that lay documents of these token numbers into chains of ``size``."""
    per = (lengths + size - 1) // size
    first = np.cumsum(per) - per
    doc = np.repeat(np.arange(len(lengths)), lengths)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    return first[doc] + pos // size, pos % size, int(per.sum()), doc


def carried(unary: np.ndarray, real: np.ndarray, trans: np.ndarray, first: np.ndarray):
    """Forward odds at the end of the chain before each one (NaN for a document's first) and
    backward odds from the chain after it, where ``first`` marks the chains that start a
    document.  Each chain becomes one 2 x 2 matrix, so documents are walked chain by chain."""
    n, size = unary.shape
    e, a = np.exp(np.clip(unary, -40, 40)), np.exp(trans)
    m = np.tile(np.eye(2), (n, 1, 1))
    for t in range(size):
        step = m @ a
        if t == 0:
            step = np.where(first[:, None, None], m, step)
        step[:, :, 1] *= e[:, t, None]
        m = np.where(real[:, t, None, None], step, m)
        m /= m.sum(axis=(1, 2), keepdims=True)
    start = np.flatnonzero(first)
    number = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    order = np.argsort(number, kind="stable")
    nth = np.split(order, np.searchsorted(number[order], np.arange(1, number.max() + 1)))
    before, after = np.ones(n), np.ones(n)
    for i in nth[1:]:
        r, p = before[i - 1], m[i - 1]
        before[i] = (p[:, 0, 1] + r * p[:, 1, 1]) / (p[:, 0, 0] + r * p[:, 1, 0])
    for i in reversed(nth[1:]):
        q, p = after[i], m[i]
        after[i - 1] = (p[:, 1, 0] + p[:, 1, 1] * q) / (p[:, 0, 0] + p[:, 0, 1] * q)
    return np.where(first, np.nan, before), after


def forward_backward(unary: np.ndarray, real: np.ndarray, trans: np.ndarray, before=np.nan, after=1.0):
    """Odds form of the two-state recursions, one step for all chains at once: forward odds
    r, backward odds q; the marginal odds of a token are r * q.  ``before`` and ``after`` are
    what ``carried`` brings from the neighbouring chains."""
    n, size = unary.shape
    e = np.exp(np.clip(unary, -40, 40))
    (a00, a01), (a10, a11) = np.exp(trans)
    r, q = np.empty_like(e), np.ones_like(e)
    r[:, 0] = np.where(np.isnan(before), e[:, 0], e[:, 0] * (a01 + before * a11) / (a00 + before * a10))
    q[:, -1] = after
    for t in range(1, size):
        r[:, t] = e[:, t] * (a01 + r[:, t - 1] * a11) / (a00 + r[:, t - 1] * a10)
    for t in range(size - 2, -1, -1):
        x = e[:, t + 1] * q[:, t + 1]
        q[:, t] = np.where(real[:, t + 1], (a10 + a11 * x) / (a00 + a01 * x), 1.0)
    return e, r, q


def marginals(unary: np.ndarray, real: np.ndarray, trans: np.ndarray, before=np.nan, after=1.0) -> np.ndarray:
    _, r, q = forward_backward(unary, real, trans, before, after)
    odds = r * q
    return np.where(real, odds / (1 + odds), 0.0)


def _pair_marginals(unary, real, trans):
    """Marginals of tokens and of neighbouring states (n, size - 1, 2, 2)."""
    e, r, q = forward_backward(unary, real, trans)
    odds = r * q
    a = np.exp(trans)
    left = np.stack([np.ones_like(r[:, :-1]), r[:, :-1]], axis=-1)
    right = np.stack([np.ones_like(q[:, 1:]), e[:, 1:] * q[:, 1:]], axis=-1)
    pair = left[..., :, None] * a * right[..., None, :]
    pair /= pair.sum(axis=(-1, -2), keepdims=True)
    return np.where(real, odds / (1 + odds), 0.0), pair * real[:, 1:, None, None]


def telling_features(docs: list[tuple[int, list[list[str]]]], support: int = 3, ratio: float = 8.0) -> set[str]:
    """Features that at least ``support`` toxic documents have, ``ratio`` times as often a
    token as in clean documents, by a clear margin (a log-likelihood ratio above 12)."""
    seen = {0: Counter(), 1: Counter()}
    tokens = {0: 0, 1: 0}
    for y, parts in docs:
        words = {w for p in parts for w in p}
        seen[y].update({f for w in words for f in features_of(w)})
        tokens[y] += sum(map(len, parts))
    n1, n0 = max(1, sum(y for y, _ in docs)), max(1, sum(1 - y for y, _ in docs))
    out = set()
    for f, t in seen[1].items():
        c = seen[0][f]
        if t < support or t / n1 < ratio * (c + 0.5) / (n0 + 1):
            continue
        p, p1, p0 = (t + c) / (n1 + n0), t / n1, max(c / n0, 1e-9)
        ll = lambda k, n, q: (k * math.log(q) if k else 0) + ((n - k) * math.log1p(-q) if k < n else 0)
        if 2 * (ll(t, n1, p1) + ll(c, n0, min(p0, 1 - 1e-9)) - ll(t, n1, p) - ll(c, n0, p)) > 12:
            out.add(f)
    return out


def train_field(docs: list[tuple[int, list[list[str]]]], telling: set[str], rounds: int = 120, rate: float = 0.2, ridge: float = 1e-4,
                plain_every: int = PLAIN_EVERY):
    """Maximum likelihood (Adam on the mean log-likelihood of a token) of the field's weights.
    Of the chains without a telling feature, which differ only in length, one in
    ``plain_every`` is used and counts that many times (1: all of them)."""
    index = {f: i for i, f in enumerate(sorted(telling))}
    seqs = [(y, p[i:i + CHAIN]) for y, parts in docs for p in parts for i in range(0, len(p), CHAIN)]
    ids: dict[str, list[int]] = {}
    for _, s in seqs:
        for w in s:
            if w not in ids:
                ids[w] = [index[f] for f in features_of(w) if f in index]
    telling_seq = [any(ids[w] for w in s) for _, s in seqs]
    kept = [i for i in range(len(seqs)) if telling_seq[i] or i % plain_every == 0]
    weight = np.array([1.0 if telling_seq[i] else float(plain_every) for i in kept])
    seqs = [seqs[i] for i in kept]
    lengths = np.array([len(s) for _, s in seqs])
    real = np.arange(CHAIN)[None, :] < lengths[:, None]
    gold = np.zeros(real.shape)
    row, col, feat = [], [], []
    for i, (y, s) in enumerate(seqs):
        for j, w in enumerate(s):
            fs = ids[w]
            if fs:
                row += [i] * len(fs)
                col += [j] * len(fs)
                feat += fs
                gold[i, j] = y
    row, col, feat = np.array(row, int), np.array(col, int), np.array(feat, int)
    k = len(index)
    w = np.zeros(k + 5)
    w[k] = -5.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    g1, g0 = gold[:, :-1], gold[:, 1:]
    both = real[:, 1:] * weight[:, None]
    gold_pair = np.array([[((1 - g1) * (1 - g0) * both).sum(), ((1 - g1) * g0 * both).sum()], [(g1 * (1 - g0) * both).sum(), (g1 * g0 * both).sum()]])
    scale = max(1.0, float((gold * weight[:, None]).sum()))
    blocks = [(i, min(i + 1024, len(kept))) for i in range(0, len(kept), 1024)]  # bounds the arrays of a step
    cut = np.searchsorted(row, [i for i, _ in blocks] + [len(kept)])
    for t in range(1, rounds + 1):
        grad = np.zeros_like(w)
        grad[k + 1:] = gold_pair.ravel()
        for n, (i, j) in enumerate(blocks):
            at = slice(cut[n], cut[n + 1])
            r, c, f = row[at] - i, col[at], feat[at]
            unary = np.full((j - i, CHAIN), w[k])
            np.add.at(unary, (r, c), w[f])
            p, pair = _pair_marginals(unary, real[i:j], w[k + 1:].reshape(2, 2))
            diff = (gold[i:j] - p) * real[i:j] * weight[i:j, None]
            grad[:k] += np.bincount(f, diff[r, c], k)
            grad[k] += diff.sum()
            grad[k + 1:] -= np.einsum("ijab,i->ab", pair, weight[i:j]).ravel()
        grad = grad / scale - ridge * w * (np.arange(len(w)) != k)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w += rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8) * (0.5 if t > rounds // 2 else 1)
    return {f: float(w[i]) for f, i in index.items()}, float(w[k]), w[k + 1:].reshape(2, 2).copy()


class Tagger:
    """Scores batches of texts with a model; remembers words it has met, up to a bound."""

    def __init__(self, model: ToxicityModel):
        self.model, self.cache = model, {}

    def _values(self, words: list[str]) -> np.ndarray:
        cache = self.cache
        try:
            out = [cache[w] for w in words]
        except KeyError:
            if len(cache) > CACHED_WORDS:
                cache.clear()
            new = {w: self.model.unary(w) for w in set(words) if w not in cache}
            cache.update((w, x) for w, x in new.items() if len(w) <= CACHED_LETTERS)
            out = [new[w] if w in new else cache[w] for w in words]
        return np.array(out, float)

    def values_of(self, text: str | None) -> np.ndarray:
        """One number for each token of a text; its words are not kept."""
        parts = [self._values(tokens_of(s)) for _, s in blocks_of(text or "")]
        return np.concatenate(parts) if parts else np.zeros(0)

    def token_probabilities(self, docs: list[list[str]]) -> list[np.ndarray]:
        return self._probabilities([self._values(d) for d in docs])

    def _probabilities(self, docs: list[np.ndarray]) -> list[np.ndarray]:
        lengths = np.array([len(d) for d in docs], int)
        if not lengths.sum():
            return [np.zeros(0) for _ in docs]
        row, col, n, _ = chains(lengths)
        unary, real = np.zeros((n, CHAIN)), np.zeros((n, CHAIN), bool)
        unary[row, col] = np.concatenate(docs)
        real[row, col] = True
        first = np.zeros(n, bool)
        first[row[(np.cumsum(lengths) - lengths)[lengths > 0]]] = True
        before, after = np.full(n, np.nan), np.ones(n)
        long = ~(first & np.append(first[1:], True))  # chains of documents that have several
        if long.any():
            before[long], after[long] = carried(unary[long], real[long], self.model.trans, first[long])
        p = marginals(unary, real, self.model.trans, before, after)[row, col]
        return np.split(p, np.cumsum(lengths)[:-1])

    def spans_of(self, text: str, bad: np.ndarray) -> list[tuple[int, int]]:
        """Code point offsets in the text of the tokens that ``bad`` marks."""
        out, j = [], 0
        for at, stretch in blocks_of(text):
            for m in _TOKEN.finditer(found_in(stretch)[0]):
                if bad[j]:
                    out.append((at + m.start(), at + m.end()))
                j += 1
        return out

    def tag(self, texts: list[str | None]):
        """(scores, offending spans as code point offsets) of whole texts."""
        scores, spans = np.zeros(len(texts)), [[] for _ in texts]
        at = 0
        while at < len(texts):
            docs, size, end = [], 0, at
            while end < len(texts) and (size < BATCH_TOKENS or end == at):
                docs.append(self.values_of(texts[end]))
                size += -(-len(docs[-1]) // CHAIN) * CHAIN
                end += 1
            probs = self._probabilities(docs)
            expected = np.array([p.sum() for p in probs])
            peak = np.array([p.max(initial=0.0) for p in probs])
            scores[at:end] = self.model.scores(expected, peak, np.array([len(p) for p in probs], float))
            for i, p in enumerate(probs):
                if peak[i] >= 0.5:
                    spans[at + i] = self.spans_of(texts[at + i], p >= 0.5)
            at = end
        return scores, spans


def fit(docs: DataFrame, labels: DataFrame, train=lambda i: F.lit(True), label: str = "toxic", per_class: int = PER_CLASS,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text", plain_every: int = PLAIN_EVERY) -> ToxicityModel:
    """Fit on a sample bounded by ``per_class`` documents of either label and ``SEGMENTS``
    stretches of ``SEGMENT`` characters each: two thirds train the field, one third
    calibrates the document score.  The field uses one in ``plain_every`` of the chains
    without a telling feature, weighted so many times.  Without labels of both kinds scores
    are constant."""
    rows, totals = labelled_sample(docs, labels, label, train, per_class, seed, id_col, text_col, SEGMENT, SEGMENTS)
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(intercept=float(np.log((n1 + 1) / (n0 + 1))))
    same: dict[str, str] = {}  # one object for each distinct word
    docs_ = [(y, [[same.setdefault(w, w) for w in tokens_of(p)] for p in parts]) for y, parts in rows]
    del rows
    build = [d for i, d in enumerate(docs_) if i % 3 < 2]
    hold = [d for i, d in enumerate(docs_) if i % 3 == 2] or docs_
    telling = telling_features(build)
    model = ToxicityModel(*train_field(build, telling, plain_every=plain_every)) if telling else ToxicityModel()
    probs = Tagger(model).token_probabilities([[w for p in parts for w in p] for _, parts in hold])
    x = document_features(np.array([p.sum() for p in probs]), np.array([p.max(initial=0.0) for p in probs]), np.array([len(p) for p in probs], float))
    y = np.array([y for y, _ in hold], float)
    seen = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    model.coef, model.intercept = fit_logistic(x, y, np.where(y == 1, n1 / seen[1], n0 / seen[0]), ridge=1e-2)
    return model


RESULT = "struct<score: double, spans: array<struct<start: int, end: int>>>"


def tag_column(docs: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """Struct of score (0 to 1) and the offending spans of a text column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def batches(it):
        tagger = Tagger(shared.value)
        for texts in it:
            done = []
            for i in range(0, len(texts), ROWS_AT_ONCE):  # bounds the texts held as Python strings
                scores, spans = tagger.tag(texts.slice(i, ROWS_AT_ONCE).to_pylist())
                listed = pa.array([[{"start": a, "end": z} for a, z in s] for s in spans], kind)
                done.append(pa.StructArray.from_arrays([pa.array(scores, pa.float64()), listed], names=["score", "spans"]))
            yield pa.concat_arrays(done) if done else pa.StructArray.from_arrays([pa.array([], pa.float64()), pa.array([], kind)], names=["score", "spans"])

    return arrow_column(docs.sparkSession, batches, RESULT)(text.cast("string"))


def tag(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, score, predicted (1 from ``threshold``), spans (code point
    offsets of toxic tokens).  Null and empty texts have no tokens and the score of that;
    repeated rows and null ids stay; other columns are ignored; an empty table gives none."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.select("id", tag_column(docs, model, F.col("text")).alias("r"))
    return out.select(F.col("id").alias(id_col), "r.score", (F.col("r.score") >= threshold).cast("int").alias("predicted"), "r.spans")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` below the threshold, all columns kept."""
    s = free_name(docs, "_tags")
    return docs.withColumn(s, tag_column(docs, model, F.col(text_col))).where(F.col(f"{s}.score") < threshold).drop(s)


def held_out(id_col: Column) -> Column:
    return remainder(id_col, 3) == 1
