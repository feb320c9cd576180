"""Embedding whitening from an exact integer scatter.

Entries are read on a grid: x = floor(scale * c) + shift. Each task subtracts the shift again and adds up n, sums and
cross-products of its rows as integers of any size: products of a batch are exact in the type that holds them (floats
below 2**53, then 64 bits, then Python's integers), and what a task holds is one number a pair of dimensions. Tasks hand
them over in digits of 2**30, which Spark sums by cell without overflow, so the driver sees dimension * dimension / 2
numbers and no rows. There n * X'X - SS' is formed exactly; its quotient by n * n is the covariance, rounded once to
double, and decomposed by eigh. A shift changes neither that matrix nor n * x - S, so both come from small numbers.

A second pass projects: n * x - S exactly, then to double, over n, on each component and over the root of its eigenvalue.
A third one over the same rows measures the covariance of what was written, centred by part and merged.

Defined cases: a null vector, or one with a null or non-finite entry or one whose x is beyond 64 bits, is dropped; of
vectors of several lengths the commonest counts (of equally common ones the longest) and the others are dropped, as they
have no covariance with it, and so are empty ones; repeated rows and a null vec_id count like others; fewer dimensions than
components give as many components as dimensions; a component without variance (eigenvalue within rounding of 0) has
null in `whitened`, and the error is measured over the others; ties of eigenvalues are in eigh's order; the largest
coordinate of a component is positive; a deviation beyond 38 digits is null (the query's, beyond 64 bits); an empty table
gives no rows; other columns are ignored, whatever their names. A vector is one row, held with its batch only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

DIGIT = 30
#: Rows whose products are taken at once.
ROWS = 4096


def usable(vectors: DataFrame, scale: int, shift: int) -> DataFrame:
    """vec_id and v (array of double) of the rows that can be fitted."""
    v = F.col("embedding").cast("array<double>")
    limit = float(2**63 - 2**11 - abs(shift)) / scale
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < limit), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & good & (F.size("v") > 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("v") == (sizes.d if sizes else 0))


def on_grid(column: pa.Array, scale: int) -> np.ndarray:
    """floor(scale * c) of a batch of vectors: x without its shift."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(flat * scale).astype(np.int64)


def cross_products(x: np.ndarray) -> np.ndarray:
    """x'x exactly, as Python integers."""
    most = max(int(x.max()), -int(x.min()))
    bound = most * most * len(x)
    if bound < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x if bound < 1 << 63 else x.astype(object)
    return (y.T @ y).astype(object)


def sums_of(x: np.ndarray) -> np.ndarray:
    most = max(int(x.max()), -int(x.min()))
    return (x if most * len(x) < 1 << 63 else x.astype(object)).sum(0).astype(object)


def digits(value: int) -> list[int]:
    """Signed digits of 2**DIGIT, the lowest first."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << DIGIT) - 1)))
        value >>= DIGIT
    return out


@dataclass
class Scatter:
    """n, sums and cross-products of the x without shift, as integers of any size."""

    n: int
    sums: np.ndarray
    products: np.ndarray

    def scaled_covariance(self) -> np.ndarray:
        """n * X'X - SS', exactly."""
        return self.n * self.products - np.outer(self.sums, self.sums)

    def covariance(self) -> np.ndarray:
        """Rounded once: the quotient of two integers is the nearest double."""
        square = self.n * self.n
        return np.array([[v / square for v in row] for row in self.scaled_covariance()], float)


def scatter(rows: DataFrame, scale: int) -> Scatter | None:
    """Of the rows of usable(); None if there are none. Cell 0 is n, then the sums, then the upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = on_grid(batch.column(0).slice(at, ROWS), scale)
                n, sums, products = n + len(x), sums + sums_of(x), products + cross_products(x)
        if n:
            values = [n, *sums, *products[np.triu_indices(len(sums))]]
            found = [(cell, place, d) for cell, value in enumerate(values) for place, d in enumerate(digits(int(value)))]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], names=["cell", "place", "digit"])

    cells = rows.select("v").mapInArrow(run, "cell long, place long, digit long").groupBy("cell", "place").agg(F.sum("digit").alias("digit")).collect()
    if not cells:
        return None
    values: dict[int, int] = {}
    for r in cells:
        values[r.cell] = values.get(r.cell, 0) + (r.digit << (DIGIT * r.place))
    d = len(rows.select("v").first().v)
    flat = [values.get(i, 0) for i in range(1 + d + d * (d + 1) // 2)]
    products = np.empty((d, d), object)
    i, j = np.triu_indices(d)
    products[i, j] = products[j, i] = np.array(flat[1 + d :], object)
    return Scatter(flat[0], np.array(flat[1 : 1 + d], object), products)


@dataclass
class Whitener:
    """What a vector is projected with. values and vectors: of all components, by falling eigenvalue."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray

    @property
    def flat(self) -> np.ndarray:
        """Which components have no variance but rounding's."""
        return self.values <= len(self.values) * np.finfo(float).eps * max(self.values.max(), 0.0)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: 64 bits where they hold it."""
        most = max(int(x.max()), -int(x.min()))
        if self.n * most + max(map(abs, self.sums)) < 1 << 63:
            return x * np.int64(self.n) - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def squares(self, deviations: np.ndarray) -> list[int]:
        """Sum of the squares of each row, exactly."""
        most = max(map(abs, (int(deviations.max()), int(deviations.min()))))
        if deviations.dtype != object and most * most * deviations.shape[1] < 1 << 63:
            return (deviations * deviations).sum(1).tolist()
        return [sum(v * v for v in row) for row in deviations.astype(object)]

    def whitened(self, deviations: np.ndarray, components: int) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (deviations.astype(float) / self.n) @ self.vectors[:, :components] / np.sqrt(self.values[:components])
        out[:, self.flat[:components]] = np.nan
        return out


def whitener(s: Scatter) -> Whitener:
    v = s.covariance()
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    trace = np.trace(v)
    return Whitener(s.n, s.sums, values, vectors * signs, values / trace if trace > 0 else np.zeros(len(values)))


def identity_error(rows: DataFrame, w: Whitener, scale: int, components: int) -> float | None:
    """Largest entry of the whitened rows' covariance less the identity, over components with variance.

    Each batch is centred by its own mean before it is multiplied, and Spark adds up the parts with what lies between
    their means: sum of M2 + sum of n * m * m' - N * mean * mean'.
    """
    kept = [k for k in range(components) if not w.flat[k]]
    pairs = [(a, b) for a in range(len(kept)) for b in range(a, len(kept))]
    if not kept:
        return None
    schema = "n double, " + ", ".join([f"m{k} double" for k in range(len(kept))] + [f"p{a}_{b} double" for a, b in pairs])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = w.whitened(w.deviations(on_grid(batch.column(0), scale)), components)[:, kept] if batch.num_rows else np.empty((0, len(kept)))
            if len(y):
                mean = y.mean(0)
                c = y - mean
                m2 = c.T @ c + len(y) * np.outer(mean, mean)
                row = [len(y), *(len(y) * mean), *(m2[a, b] for a, b in pairs)]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.float64()) for v in row], names=names)

    r = rows.select("v").mapInArrow(run, schema).agg(*(F.sum(c).alias(c) for c in names)).first()
    mean = [r[f"m{k}"] / r.n for k in range(len(kept))]
    return max(abs(r[f"p{a}_{b}"] / r.n - mean[a] * mean[b] - (a == b)) for a, b in pairs)


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """A row for each remaining vector and component, numbered from 1."""
    spark = vectors.sparkSession
    rows = staged(usable(vectors, scale, shift), "vectors")
    s = scatter(rows, scale)
    if s is None:
        return spark.createDataFrame([], WHITENED)
    w = whitener(s)
    components = min(components, len(s.sums))
    error = identity_error(rows, w, scale, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                deviations = w.deviations(on_grid(part.column(1), scale))
                y, k = w.whitened(deviations, components), part.num_rows
                square = [Decimal(v) if v < 10**38 else None for v in w.squares(deviations)]
                each = pa.array(np.repeat(np.arange(k), components))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(each), pa.array(np.tile(np.arange(1, components + 1, dtype=np.int32), k)), pa.array(np.full(k * components, w.n, np.int64)),
                        pa.array(square, pa.decimal128(38, 0)).take(each), pa.array(y.ravel(), from_pandas=True), pa.array(np.tile(w.explained[:components], k)), pa.array([error] * (k * components), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, WHITENED)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as long)"))
