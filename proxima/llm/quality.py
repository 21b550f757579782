"""Quality classifier by compression: zstandard dictionaries built from good and from bad
labelled text, and the normalised difference of the compressed sizes as a calibrated score.

A text is cut into pieces of ``PIECE`` bytes, so its whole length counts and memory stays
bounded.  Each piece is compressed with either dictionary;
``(size with bad - size with good) / length`` is high where the good dictionary helps more.
A logistic curve turns it into the probability of label 1, together with the size with the
good dictionary itself where that falls below what good texts need (text that repeats
itself shrinks with any dictionary).  The curve is fitted on labelled texts that built no
dictionary, both labels weighing the same.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proxima.llm.common import arrow_column, fit_logistic, free_name, labelled_sample, lossless_bytes, remainder

PIECE = 512
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
PER_CLASS = 2000  # labelled texts that the model is fitted on, of either label
SEGMENTS = 8  # pieces of each of them
THRESHOLD = 0.3


def _dictionary(pieces: list[bytes], size: int) -> bytes:
    """A trained dictionary, or where there is too little to train on the pieces themselves."""
    try:
        return zstandard.train_dictionary(size, pieces, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    kw = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, **kw)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, **kw)


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    usual: float  # compressed share below which a text counts as repeating itself
    coef: np.ndarray
    intercept: float

    def measure(self):
        """text bytes -> (normalised size difference, compressed share up to ``usual``); an
        empty text has no difference and the usual share."""
        good, bad = _compressor(self.good).compress, _compressor(self.bad).compress

        def sizes(text: bytes) -> tuple[float, float]:
            if not text:
                return 0.0, self.usual
            with_good = with_bad = 0
            for i in range(0, len(text), PIECE):
                piece = text[i:i + PIECE]
                with_good += len(good(piece))
                with_bad += len(bad(piece))
            return (with_bad - with_good) / len(text), min(with_good / len(text), self.usual)

        return sizes

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coef + self.intercept, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, train=lambda i: F.lit(True), label: str = "quality", per_class: int = PER_CLASS,
        seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    """Fit on a sample bounded by ``per_class`` texts of either label and ``SEGMENTS`` pieces
    of each: three fifths build the dictionaries, two fifths calibrate.

    Without labels every score is 0.5; with one label only, scores are near its value."""
    rows, totals = labelled_sample(docs, labels, label, train, per_class, seed, id_col, text_col, PIECE, SEGMENTS)
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return QualityModel(b"", b"", 1.0, np.zeros(2), float(np.log((n1 + 1) / (n0 + 1))))
    build = [r for i, r in enumerate(rows) if i % 5 < 3]
    hold = [r for i, r in enumerate(rows) if i % 5 >= 3] or rows
    pieces = {y: [p.encode() for label_, parts in build if label_ == y for p in parts if p] for y in (0, 1)}
    model = QualityModel(_dictionary(pieces[1], DICTIONARY_BYTES), _dictionary(pieces[0], DICTIONARY_BYTES), 1e9, np.zeros(2), 0.0)
    measure = model.measure()
    y = np.array([label_ for label_, _ in hold], float)
    x = np.array([measure("".join(parts).encode()) for _, parts in hold])
    good = x[(y == 1) & (x[:, 1] < 1e9), 1]
    model.usual = 0.75 * float(np.median(good)) if len(good) else 1.0
    x[:, 1] = np.minimum(x[:, 1], model.usual)
    model.coef, model.intercept = fit_logistic(x, y, np.where(y == 1, 1 / max(1, (y == 1).sum()), 1 / max(1, (y == 0).sum())))
    return model


def score_column(docs: DataFrame, model: QualityModel, text: Column) -> Column:
    """The score of a text column, 0 to 1; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batches(it):
        m = shared.value
        measure = m.measure()
        for texts in it:
            yield pa.array(m.score(np.array([measure(t.as_py() or b"") for t in texts], float).reshape(-1, 2)), pa.float64())

    return arrow_column(docs.sparkSession, batches, "double")(lossless_bytes(text))


def classify(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Per document: ``id_col``, score, predicted (1 from ``threshold``).  Null and empty texts
    get the score of no difference and the usual share; repeated rows and null ids stay; other columns are
    ignored; an empty table gives none."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.select("id", score_column(docs, model, F.col("text")).alias("score"))
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` whose score reaches the threshold, all columns kept."""
    s = free_name(docs, "_score")
    return docs.withColumn(s, score_column(docs, model, F.col(text_col))).where(F.col(s) >= threshold).drop(s)


def held_out(id_col: Column) -> Column:
    return remainder(id_col, 5) == 0
