"""Quality classifier by positive-unlabelled learning.

The model is linear in densities of a text (words, letters, symbols, repeats) and in the frequencies of its word
shapes. It is fitted by minimising the non-negative unbiased risk of trusted positives (label 1), unlabelled web text
and an estimated class prior; negatives take no part. The loss is the squared one, so the risk over any number of rows
follows from the second moments of both sets: all unlabelled rows count, in one pass, and the minimum is exact.

The prior is estimated from positives and unlabelled text alone: above any score, the unlabelled share is at least the
prior times the positives' share, so the least quotient of the two, each taken at its two standard deviations, bounds
it; only scores that at least half of the positives reach are looked at, as the tail is fitted to them. The ranking by
score doesn't depend on the prior that it is computed from.

Positives for fitting are bounded by `sample`, picked by a hash of doc_id. Scores cover all rows and whole texts.

Defined cases: null and empty texts are scored as texts without words; very long texts are read whole, one at a time
beyond 4 MB; documents with a null doc_id are scored, unlabelled and not held out; repeated rows count each; repeated
label rows of one doc_id count once (the lowest label, so a tie of 0 and 1 is no positive), null labels not at all;
without positives or rows every score is 0.5; equal texts have equal scores; an empty table gives no rows; columns
called like a result are replaced, others come along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, SYMBOLS, crc_of_id, pieces, staged, text_bytes, trim, word_hashes
from .quality_rules import lines_of, repeated_words

SHAPES = 256
BINS = 4096
#: Letters to a and A, digits to 0, bytes of other scripts to a; the rest stays.
CLASSES = bytes(
    ord("a") if 97 <= i <= 122 or i >= 128 else ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57 else i
    for i in range(256)
)
COUNTED = (b"!", b"|", b",.;:", b"0123456789", b"@/\\_=~^", SYMBOLS, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"()[]{}\"'")
PLAIN = 8 + len(COUNTED)


def shapes_of(text: bytes) -> np.ndarray:
    """Bucket of each word's shape: its bytes by class, runs of one class cut to two."""
    a = np.frombuffer(text.translate(CLASSES), np.uint8)
    keep = np.ones(len(a), bool)
    keep[2:] = (a[2:] != a[1:-1]) | (a[2:] != a[:-2])
    return (word_hashes(a[keep].tobytes()) % np.uint64(SHAPES)).astype(np.int64)


def features(texts: list[bytes]) -> np.ndarray:
    """Rows of half-precision numbers: as a staged table holds them."""
    out = np.zeros((len(texts), PLAIN + SHAPES), np.float32)
    for i, text in enumerate(texts):
        h = word_hashes(text)
        n = len(h)
        if not n:
            out[i, 0] = -1
            continue
        lines = lines_of(text)
        size = len(text.translate(None, SPACES))
        out[i, :4] = (np.log1p(n), np.log1p(size / n), len(np.unique(h)) / n**0.8, 1 - len(set(lines)) / len(lines))
        foreign = len(text.translate(None, bytes(range(128))))
        out[i, 4:8] = (repeated_words(h) / n, len(lines) / n, foreign / size, (h[1:] == h[:-1]).sum() / n)
        out[i, 8:PLAIN] = [(len(text) - len(text.translate(None, x))) / size for x in COUNTED]
        out[i, PLAIN:] = np.sqrt(np.bincount(shapes_of(text), minlength=SHAPES) / n)
    return out.astype(np.float16)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Near (1 + margin) / 2, the chance of label 1 that the squared loss aims at, and always between 0 and 1."""
        return 1 / (1 + np.exp(-np.clip(2 * self.margins(x), -30, 30)))


class Risk:
    """Non-negative unbiased risk of weights w (the last one for the constant) under the squared loss (1 - y z)**2 / 4.

    positives, unlabelled: mean of x x' over each set, where x ends in 1.
    """

    def __init__(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float):
        self.p, self.u, self.prior = positives, unlabelled, prior

    @staticmethod
    def loss(moments: np.ndarray, w: np.ndarray, y: int) -> float:
        return float(1 - 2 * y * w @ moments[-1] + w @ moments @ w) / 4

    def of_positives(self, w: np.ndarray) -> float:
        return self.prior * self.loss(self.p, w, 1)

    def of_negatives(self, w: np.ndarray) -> float:
        """Unbiased, so it can fall below nought where the fit is too close."""
        return self.loss(self.u, w, -1) - self.prior * self.loss(self.p, w, -1)

    def value(self, w: np.ndarray) -> float:
        return self.of_positives(w) + max(0.0, self.of_negatives(w))

    def weighed(self, part: float, ridge: np.ndarray) -> np.ndarray:
        """Minimum of the positives' risk and `part` of the negatives', with a ridge."""
        matrix = self.prior * (1 - part) * self.p + part * self.u
        return np.linalg.solve(matrix / 2 + ridge, (self.prior * (1 + part) * self.p[-1] - part * self.u[-1]) / 2)

    def minimum(self, ridge: np.ndarray) -> np.ndarray:
        """Where the negatives' risk would fall below nought, its part shrinks until it is nought."""
        w, low, high = self.weighed(1.0, ridge), 0.0, 1.0
        if self.of_negatives(w) < 0:
            for _ in range(40):
                part = (low + high) / 2
                w = self.weighed(part, ridge)
                low, high = (part, high) if self.of_negatives(w) > 0 else (low, part)
        return w


def fit(positives: np.ndarray, unlabelled: np.ndarray, prior: float, l2: float = 1e-3) -> Model:
    """From the mean of x x' of both sets; features are scaled by the unlabelled rows."""
    mean = unlabelled[-1, :-1]
    sd = np.sqrt(np.maximum(0, np.diag(unlabelled)[:-1] - mean**2)) + 1e-3
    scale = np.diag(np.append(1 / sd, 1.0))
    scale[:-1, -1] = -mean / sd
    ridge = np.diag(np.append(np.full(len(mean), l2), 1e-9))
    w = Risk(scale @ positives @ scale.T, scale @ unlabelled @ scale.T, prior).minimum(ridge)
    return Model(w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum()), prior)


def prior_of(positives: np.ndarray, unlabelled: np.ndarray) -> float:
    """From the numbers of rows of both sets by bin of score, ascending."""
    p, u = (np.cumsum(x[::-1])[::-1] / x.sum() for x in (positives, unlabelled))
    seen = p >= 0.5
    p, u = p[seen], u[seen]
    low = p - 2 * np.sqrt(p * (1 - p) / positives.sum())
    high = u + 2 * np.sqrt(u * (1 - u) / unlabelled.sum())
    return float(np.clip((high / np.maximum(low, 1e-9)).min(), 0.01, 0.99))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


def picked(doc_id: Column, seed: int, share: float) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))


def vectors(raw: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(raw.to_pylist()), np.float16).reshape(-1, PLAIN + SHAPES)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the features, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            x = features(text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, x binary")


def train_on(rows: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Fits on all rows (doc_id, x) that aren't held out, as unlabelled, and on about `sample` positives among them."""
    good = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1")
    n = good.count()
    # The picked labels are about `sample` numbers, whatever the size of the tables.
    good = good.where(picked(F.col("doc_id"), 1, min(1.0, sample / max(1, n)))).select("doc_id", F.lit(True).alias("positive"))
    rows = rows.where(~held_out(F.col("doc_id"))).join(F.broadcast(good), "doc_id", "left")
    rows = rows.select(F.coalesce("positive", F.lit(False)).alias("positive"), "x")
    size = PLAIN + SHAPES + 1

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, size, size))
        for b in batches:
            x = np.ones((b.num_rows, size))
            x[:, :-1] = vectors(b.column(1))
            total[0] += x.T @ x
            x = x[b.column(0).to_numpy(zero_copy_only=False)]
            total[1] += x.T @ x
        keys = [(k, i) for k in (0, 1) for i in range(size)]
        values = pa.array([total[k, i, i:].tolist() for k, i in keys], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*keys, strict=True)] + [values], names=["kind", "i", "values"])
        trim()

    parts = rows.mapInArrow(moments, "kind int, i int, values array<double>").select("kind", "i", F.posexplode("values").alias("j", "value"))
    t = parts.groupBy("kind", "i", "j").agg(F.sum("value").alias("value")).toArrow()  # as many rows as pairs of features
    sums = np.zeros((2, size, size))
    kind, i, j, value = (t.column(c).to_numpy() for c in ("kind", "i", "j", "value"))
    sums[kind, i, i + j] = value
    sums[kind, i + j, i] = value
    if not sums[0, -1, -1] or not sums[1, -1, -1]:
        return Model(np.zeros(size - 1), 0.0, 0.5)
    unlabelled, positives = (m / m[-1, -1] for m in sums)
    ranking = fit(positives, unlabelled, 0.5)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), np.int64)
        for b in batches:
            at = (ranking.scores(vectors(b.column(1))) * BINS).astype(np.int64).clip(0, BINS - 1)
            good = b.column(0).to_numpy(zero_copy_only=False)
            counts += [np.bincount(at, minlength=BINS), np.bincount(at[good], minlength=BINS)]
        kind, place = np.nonzero(counts)
        columns = [pa.array(kind, pa.int32()), pa.array(place, pa.int32()), pa.array(counts[kind, place])]
        yield pa.RecordBatch.from_arrays(columns, names=["kind", "bin", "n"])

    t = rows.mapInArrow(bins, "kind int, bin int, n long").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, BINS))
    counts[t.column("kind").to_numpy(), t.column("bin").to_numpy()] = t.column("n").to_numpy()
    return fit(positives, unlabelled, prior_of(counts[1], counts[0]))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    return train_on(staged(measured(docs), "quality-features"), labels, sample)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs, all columns, with quality_score and quality_kept; columns of these names are replaced."""
    docs = docs.drop("quality_score", "quality_kept")
    schema = T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType()), T.StructField("quality_kept", T.BooleanType())])
    place = [f.name for f in docs.schema.fields].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, place):
            s = model.scores(features(text_bytes(b.column(place))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(s >= threshold)], names=[*b.schema.names, "quality_score", "quality_kept"])

    return docs.mapInArrow(run, schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(measured(spark.read.parquet(f"{sf_dir}/documents.parquet")), "quality-features")
    model = train_on(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(vectors(b.column(1))), pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
