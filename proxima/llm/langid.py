"""Language identification by segmentation-marginalised unigrams.

The vocabulary is a fixed public one (the byte-level pieces of a tokenizer file; its path
is a parameter).  Each language has a probability for every piece.  The probability of a
word is the sum over all its segmentations into pieces, by the forward algorithm; a text's
is the product over its words.  Piece probabilities are learned from word counts by a few
rounds of expectation-maximisation, whose expectation step is a Spark job over the words.

Words are lower-case letter runs, scored as a space and their UTF-8 bytes.  Pieces longer
than eight bytes are not used, so that a piece is one 64-bit integer and a lookup is exact;
all single bytes are pieces, so that every word has a segmentation.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import arrow_column, remainder, segments_of, write_table
from proxima.session import ship_package

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
LONGEST = 8
PER_LANGUAGE = 2000  # documents that the model is fitted on, of either language
SEGMENT, SEGMENTS = 2000, 4  # characters, and stretches of that many, of each of them
LONGEST_WORD = 63  # bytes of a word that the model is fitted on
ROUNDS = 3
SMOOTHING = 0.1
CACHED_WORDS, CACHED_LETTERS = 200_000, 256  # words that a worker remembers, and the longest of them
ROWS_AT_ONCE = 500
WINDOW = 2048  # bytes of a word whose pieces are looked up together
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    """Lower-case letter runs and their counts."""
    return Counter(_WORD.findall((text or "").lower()))


def read_vocabulary(path: str = VOCABULARY) -> list[np.ndarray]:
    """The file's pieces of 1 to ``LONGEST`` bytes: for each length the sorted pieces as
    big-endian integers."""
    pieces = {bytes([b]) for b in range(256)}
    with open(path, "rb") as f:
        pieces |= {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    by = [[] for _ in range(LONGEST)]
    for p in pieces:
        if 0 < len(p) <= LONGEST:
            by[len(p) - 1].append(int.from_bytes(p, "big"))
    return [np.array(sorted(x), np.uint64) for x in by]


@dataclass
class Pieces:
    """The vocabulary with a probability for each piece and language."""

    keys: list[np.ndarray]
    prob: list[np.ndarray]  # for each length (pieces, languages)

    def _matches(self, letters: np.ndarray):
        """For a (words, bytes) block: per length k the piece numbers at each start, -1: none."""
        m, n = letters.shape
        letters = letters.astype(np.uint64)
        h, out = np.zeros((m, n + 1), np.uint64), []
        for k in range(1, min(LONGEST, n) + 1):
            h = (h[:, :n - k + 1] << np.uint64(8)) | letters[:, k - 1:]
            if not len(self.keys[k - 1]):
                out.append(np.full(h.shape, -1))
                continue
            at = np.minimum(np.searchsorted(self.keys[k - 1], h), len(self.keys[k - 1]) - 1)
            out.append(np.where(self.keys[k - 1][at] == h, at, -1))
        return out

    def _probabilities(self, found):
        return [np.where((at >= 0)[..., None], self.prob[k][at], 0.0) for k, at in enumerate(found)]

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """log probability of each word in each language.  Of a long word only the pieces of
        ``WINDOW`` bytes and the last ``LONGEST`` sums are held."""
        langs = self.prob[0].shape[1]
        out = np.empty((len(words), langs))
        for ix, block in _blocks(words):
            m, n = block.shape
            log = np.zeros((m, langs))
            alpha = {0: np.ones((m, langs))}  # sums up to each of the last few places, scaled by exp(-log)
            for start in range(0, n, WINDOW):
                base, stop = max(0, start - LONGEST + 1), min(n, start + WINDOW)
                p = self._probabilities(self._matches(block[:, base:stop]))
                for e in range(start + 1, stop + 1):
                    a = np.zeros((m, langs))
                    for k in range(1, min(LONGEST, e) + 1):
                        a += alpha[e - k] * p[k - 1][:, e - k - base]
                    if e % 12 == 0:  # rescale the last few, against underflow in long words
                        log = log + np.log(a)
                        for b in range(max(0, e - LONGEST + 1), e):
                            alpha[b] = alpha[b] / a
                        a = np.ones_like(a)
                    alpha[e] = a
                    alpha.pop(e - LONGEST, None)
            out[ix] = np.log(alpha[n]) + log
        return out

    def expected(self, words: list[bytes], counts: np.ndarray, lang: int) -> list[np.ndarray]:
        """Expected piece counts of the words (at most 64 bytes each) under one language."""
        one = Pieces(self.keys, [x[:, lang:lang + 1] for x in self.prob])
        total = [np.zeros(len(k)) for k in self.keys]
        for ix, block in _blocks(words):
            m, n = block.shape
            found = one._matches(block)
            p = one._probabilities(found)
            alpha = [np.ones((m, 1))]
            for e in range(1, n + 1):
                alpha.append(sum(alpha[e - k] * p[k - 1][:, e - k] for k in range(1, min(LONGEST, e) + 1)))
            beta = [None] * n + [np.ones((m, 1))]
            for b in range(n - 1, -1, -1):
                beta[b] = sum(p[k - 1][:, b] * beta[b + k] for k in range(1, min(LONGEST, n - b) + 1))
            w = counts[ix] / np.maximum(alpha[n][:, 0], 1e-300)
            for k, at in enumerate(found):
                for b in range(at.shape[1]):
                    use = at[:, b] >= 0
                    add = alpha[b][:, 0] * p[k][:, b, 0] * beta[b + k + 1][:, 0] * w
                    total[k] += np.bincount(at[use, b], add[use], len(total[k]))
        return total


def _blocks(words: list[bytes], most: int = 1 << 14):
    """(positions, (words, bytes) matrix) of words of the same length."""
    lengths = np.fromiter(map(len, words), int, len(words))
    for n in np.unique(lengths):
        ix = np.flatnonzero(lengths == n)
        size = max(1, min(most, (most * 16) // int(n)))
        for i in range(0, len(ix), size):
            part = ix[i:i + size]
            yield part, np.frombuffer(b"".join(words[j] for j in part), np.uint8).reshape(-1, n)


def spell(word: str) -> bytes:
    return b" " + word.encode("utf-8", "surrogatepass")


@dataclass
class LanguageModel:
    langs: list[str]
    pieces: Pieces

    def scorer(self):
        """texts -> (language, score); keeps the words it has met, up to a bound."""
        cache: dict[str, int] = {}
        table = np.zeros((1024, max(1, len(self.langs))))

        def score(texts: list[str | None]):
            nonlocal table
            counts = [words_of(t) for t in texts]
            if len(cache) > CACHED_WORDS:
                cache.clear()
            new = list({w for c in counts for w in c if w not in cache})
            if self.langs:  # longer words are not remembered: a cache of them has no bound
                long = {w: x for w in new if len(w) > CACHED_LETTERS for x in self.pieces.log_words([spell(w)])}
                new = [w for w in new if len(w) <= CACHED_LETTERS]
            if new and self.langs:
                while len(cache) + len(new) > len(table):
                    table = np.vstack([table, np.zeros_like(table)])
                at = len(cache)
                table[at:at + len(new)] = self.pieces.log_words([spell(w) for w in new])
                cache.update(zip(new, range(at, at + len(new))))
            lang, sure = [], np.zeros(len(texts))
            for i, c in enumerate(counts):
                if not self.langs or not any(ch.isalpha() for w in c for ch in w):
                    lang.append(UNKNOWN)
                    continue
                ll = sum((n * long[w] for w, n in c.items() if w in long), np.zeros(len(self.langs)))
                short = [w for w in c if w not in long] if long else c
                ll = ll + np.fromiter((c[w] for w in short), float, len(short)) @ table[[cache[w] for w in short]]
                best = int(ll.argmax())
                lang.append(self.langs[best])
                sure[i] = 1 / np.exp(np.clip(ll - ll[best], -700, 0)).sum()
            return lang, sure

        return score


def _sample(docs: DataFrame, train, per_language: int, seed: int, id_col: str, text_col: str, lang_col: str, segment: int = SEGMENT,
            segments: int = SEGMENTS) -> DataFrame:
    """About ``per_language`` documents of each language, by seeded hash of the id."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    known = known.where(train(F.col("id")))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    h = F.xxhash64(F.lit(seed), "id")
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    u = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    return known.where(u < share[F.col("lang")]).select("lang", segments_of(F.col("text"), h, segment, segments).alias("parts"))


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, n) over the sampled stretches; words of up to ``LONGEST_WORD`` bytes."""
    words = F.regexp_extract_all(F.lower(F.array_join("parts", " ")), F.lit(r"((?U)[\p{L}]+)"), F.lit(1))
    return sample.select("lang", F.explode(words).alias("word")).where(F.octet_length("word") <= LONGEST_WORD).groupBy("lang", "word").agg(F.count("*").alias("n"))


def fit(docs: DataFrame, train=lambda i: F.lit(True), vocabulary: str = VOCABULARY, per_language: int = PER_LANGUAGE, seed: int = 42,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rounds: int = ROUNDS, segment: int = SEGMENT,
        segments: int = SEGMENTS) -> LanguageModel:
    """Learn piece probabilities from a sample bounded by ``per_language`` documents a
    language and, of each, ``segments`` stretches of ``segment`` characters; words of more than
    ``LONGEST_WORD`` bytes are not learned from (they are scored).  What reaches the driver is one number for each language and piece.  Without
    labelled documents the model knows no language and answers ``und``."""
    spark = docs.sparkSession
    ship_package(spark)
    counts = write_table(word_counts(_sample(docs, train, per_language, seed, id_col, text_col, lang_col, segment, segments)).repartition("lang", "word"), "language-words")
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    keys = read_vocabulary(vocabulary)
    size = sum(map(len, keys))
    model = Pieces(keys, [np.full((len(k), len(langs)), 1.0 / size) for k in keys])
    edge = np.cumsum([0, *map(len, keys)])
    for _ in range(rounds if langs else 0):
        shared = spark.sparkContext.broadcast((langs, model))

        def expect(it, shared=shared):
            langs, model = shared.value
            for b in it:
                lang, word, n = (b.column(i).to_pylist() for i in range(3))
                for i, name in enumerate(langs):
                    ix = [j for j, x in enumerate(lang) if x == name]
                    if ix:
                        got = np.concatenate(model.expected([spell(word[j]) for j in ix], np.array([n[j] for j in ix], float), i))
                        at = np.flatnonzero(got)
                        yield pa.record_batch([pa.array(np.full(len(at), i)), pa.array(at), pa.array(got[at])], names=["lang", "piece", "n"])

        rows = counts.mapInArrow(expect, "lang bigint, piece bigint, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        n = np.full((size, len(langs)), SMOOTHING)
        n[rows.piece.to_numpy(int), rows.lang.to_numpy(int)] += rows.n.to_numpy(float)
        n /= n.sum(axis=0)
        model = Pieces(keys, [n[edge[k]:edge[k + 1]] for k in range(len(keys))])
    return LanguageModel(langs, model)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, lang_pred (``und`` for texts without letters, null and empty
    ones), score (posterior probability of lang_pred under equal priors; 0 for ``und``).
    Ties go to the first language by name; repeated rows and null ids stay; other columns
    are ignored; an empty table gives none."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.select("id", identify_column(docs, model, F.col("text")).alias("r"))
    return out.select(F.col("id").alias(id_col), "r.lang_pred", "r.score")


def identify_column(docs: DataFrame, model: LanguageModel, text: Column) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        score = shared.value.scorer()
        for texts in it:
            lang, sure = [], []
            for i in range(0, len(texts), ROWS_AT_ONCE):  # bounds the word counts held at a time
                more, p = score(texts.slice(i, ROWS_AT_ONCE).to_pylist())
                lang += more
                sure += p.tolist()
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(sure, pa.float64())], names=["lang_pred", "score"])

    return arrow_column(docs.sparkSession, batches, "struct<lang_pred: string, score: double>")(text.cast("string"))


def held_out(id_col: Column) -> Column:
    return remainder(id_col, 4) == 2
