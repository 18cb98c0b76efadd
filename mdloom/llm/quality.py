"""Quality classifier: regularised quadratic discriminant over document statistics.

A document becomes a few statistics of its whole text: shares of byte classes, lengths, repetition of words,
each through a logarithm. Per class the labelled rows give a mean and a covariance, shrunk towards its
diagonal and the pooled covariance; both are gathered as sums, so every labelled row counts and only p by p
matrices reach the driver. The score is the logistic of the difference of the two Gaussian log densities,
each from a cached Cholesky factor, plus the log prior odds, tempered because statistics of long texts are
not independent.

Defined cases: null or empty text has the statistics of zero counts and is scored like any other; without
labelled rows of class 0 every score is 1, without rows of class 1 (but some of class 0) it is 0; labels
that are null or neither 0 nor 1 are ignored; repeated label rows count as often as they appear; repeated
documents are each scored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import Hasher, discard, portions, stored, table, tidy, utf8

THRESHOLD = 0.7
SHRINK_DIAGONAL = 0.1
SHRINK_POOLED = 0.2
TEMPER = 0.5
SUB_BATCH = 1 << 20

# Byte classes; a byte belongs to the first that lists it. Bytes of non-ASCII characters count as lower case.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)) + bytes(range(128, 256)),
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".,;:?'\"-()",
    "bang": b"!",
    "bar": b"|",
    "mark": b"$%&#*@^~_=+<>/\\`{}[]",
}
NAMES = (*CLASSES, "other", "words", "distinct_words", "long_words", "short_words", "word_marks", "twins", "lines", "bytes")
# Shares that prose usually has; counts are smoothed towards them, so that short texts look ordinary until they show otherwise.
USUAL = np.array([0.02, 0.78, 0.005, 0.15, 0.005, 0.03, 0.001, 0.001, 0.002, 0.001])
USUAL_WORDS = np.array([0.85, 0.12, 0.35, 0.005, 0.01])
BYTES_WEIGHT, WORDS_WEIGHT = 40, 8


def _lut() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.uint8)
    for k, members in reversed(list(enumerate(CLASSES.values()))):
        out[list(members)] = k
    return out


_whole = Hasher()


def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Raw counts, one row per document, in the order of NAMES."""
    n, k = len(offsets) - 1, len(CLASSES) + 1
    out = np.zeros((n, len(NAMES)))
    if not n:
        return out
    size = np.diff(offsets)
    out[:, k + 7] = size
    if not len(data):
        return out
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    cls = _lut()[data]
    out[:, :k] = np.bincount(doc * k + cls, minlength=n * k).reshape(n, k)
    blank = (cls == 3) | (cls == 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[:-1][size > 0]] = True
    start = ~blank
    start[1:] &= blank[:-1] | edge[1:-1]
    first = np.flatnonzero(start)
    if len(first):
        stop = ~blank
        stop[:-1] &= blank[1:] | edge[1:-1]
        last = np.flatnonzero(stop)
        home, length = doc[first], last - first + 1
        add = lambda column, rows: np.add(out[:, column], np.bincount(rows, minlength=n), out=out[:, column])
        add(k, home)
        add(k + 2, home[length > 9])
        add(k + 3, home[length < 4])
        add(k + 4, home[(cls[last] >= 6) & (cls[last] <= 8)])
        word = _whole(data, first, length)
        twin = np.flatnonzero((word[1:] == word[:-1]) & (home[1:] == home[:-1]))
        add(k + 5, home[twin])
        own = np.unique(np.stack([home.astype(np.uint64), word]).T.copy().view("u8,u8").ravel())
        add(k + 1, own["f0"].astype(np.int64))
    out[:, k + 6] = out[:, 4] + 1
    return out


def statistics(raw: np.ndarray) -> np.ndarray:
    """Counts to features: logarithms of smoothed shares, and of lengths."""
    k = len(CLASSES) + 1
    size, words = raw[:, k + 7 :], raw[:, k : k + 1]
    shares = np.log((raw[:, :k] + BYTES_WEIGHT * USUAL) / (size + BYTES_WEIGHT))
    of_words = np.log((raw[:, k + 1 : k + 6] + WORDS_WEIGHT * USUAL_WORDS) / (words + WORDS_WEIGHT))
    length = np.log((size + BYTES_WEIGHT) / (words + BYTES_WEIGHT / 6))
    return np.hstack([shares, of_words, length, np.log((raw[:, k + 6 : k + 7] + 1) / (words + 2 * WORDS_WEIGHT)), np.log1p(size)])


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every whole text."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for lo, hi in portions(offsets, SUB_BATCH):
                own = offsets[lo : hi + 1]
                x = statistics(counts(data[own[0] : own[-1]], own - own[0]))
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1])
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), flat.cast(pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, x array<double>")


@dataclass
class Model:
    """Means and Cholesky factors of the two classes; ``constant`` is set where a class has no rows."""

    means: tuple[np.ndarray, np.ndarray] | None = None
    factors: tuple[np.ndarray, np.ndarray] | None = None
    log_odds: float = 0.0
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (x - mean).T)
            density.append(-0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(TEMPER * (density[1] - density[0]) + self.log_odds, -700, 700)))


def fit(labelled: DataFrame) -> Model:
    """From (x, quality): sums of every row, by task, then small matrices."""

    def run(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            y = np.asarray(batch.column(1))
            x = np.asarray(batch.column(0).flatten()).reshape(len(y), -1)
            for c in (0, 1):
                own = x[y == c]
                if len(own):
                    s = sums.setdefault(c, [0, 0, 0])
                    s[0], s[1], s[2] = s[0] + len(own), s[1] + own.sum(0), s[2] + own.T @ own
        for c, (n, s, q) in sums.items():
            yield pa.record_batch([pa.array([c]), pa.array([n]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], ["c", "n", "s", "q"])

    sums = labelled.select("x", F.col("quality").cast("long")).mapInArrow(tidy(run), "c long, n long, s array<double>, q array<double>")
    # one row per class and task, added up on the executors before two rows reach the driver
    added = sums.select("c", "n", F.posexplode(F.concat("s", "q")).alias("i", "v")).groupBy("c", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    by: dict[int, dict[int, float]] = {0: {}, 1: {}}
    n = {0: 0, 1: 0}
    for r in added.collect():
        by[r.c][r.i] = r.v
        n[r.c] = r.n
    if not n[0]:
        return Model(constant=1.0)
    if not n[1]:
        return Model(constant=0.0)
    p = len(NAMES)
    means, covs = [], []
    for c in (0, 1):
        flat = np.array([by[c][i] for i in range(p + p * p)])
        means.append(flat[:p] / n[c])
        covs.append(flat[p:].reshape(p, p) / n[c] - np.outer(means[-1], means[-1]))
    pooled = (covs[0] * n[0] + covs[1] * n[1]) / (n[0] + n[1])
    factors = []
    for s in covs:
        s = (1 - SHRINK_POOLED) * s + SHRINK_POOLED * pooled
        s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + 1e-3 * np.eye(p)
        factors.append(np.linalg.cholesky(s))
    return Model(tuple(means), tuple(factors), float(np.log(n[1] / n[0])))


def apply(model: Model, xs: DataFrame) -> DataFrame:
    """(doc_id, score) of every row of (doc_id, x)."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                x = np.asarray(batch.column(1).flatten()).reshape(n, -1)
                yield pa.record_batch([batch.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return xs.mapInArrow(tidy(run), "doc_id long, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model of all labelled rows that are not held out, and the features of every document."""
    xs = stored(features(docs), "quality-features")
    known = labels.where(F.col("quality").isin(0, 1)).where(~held_out()).select("doc_id", "quality")
    return fit(xs.join(known, "doc_id")), xs


def filtered(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold."""
    model, xs = train(docs, labels)
    discard(docs.sparkSession, xs)

    @F.arrow_udf(DoubleType())
    def score(texts: pa.Array) -> pa.Array:
        data, offsets = utf8(texts)
        out = [np.zeros(0)]
        for lo, hi in portions(offsets, SUB_BATCH):
            own = offsets[lo : hi + 1]
            out.append(model.score(statistics(counts(data[own[0] : own[-1]], own - own[0]))))
        return pa.array(np.concatenate(out))

    return docs.where(score("text") >= THRESHOLD)  # texts go to Python, only scores come back


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; held-out rows teach nothing."""
    model, xs = train(docs, labels)
    return apply(model, xs).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def op5_quadratic_discriminant_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
