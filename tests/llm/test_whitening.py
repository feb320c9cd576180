import math
from fractions import Fraction

import numpy as np
import pytest

from lumenquad.llm import whitening
from lumenquad.llm.whitening import cross_products, digits, op12_embedding_whitening, scatter, usable, whiten, whitener

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component int, v string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 9, 9, "clash") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def grid(vectors):
    return [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]


def random_vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) @ r.normal(size=(d, d)) * 0.3 + r.normal(size=d)).tolist()


def test_equals_fractions(spark):
    good = random_vectors(90, 10)
    bad = [None, [None] * 10, [float("nan")] + [0.0] * 9, [0.0] * 9 + [float("-inf")], [1.0, 2.0], []]
    rows = whiten(table(spark, good + bad + good[:3])).collect()
    x = grid(good + good[:3])
    n = len(x)
    sums = [sum(c) for c in zip(*x, strict=True)]
    cov = [[Fraction(sum(r[i] * r[j] for r in x) * n - sums[i] * sums[j], n * n) for j in range(10)] for i in range(10)]
    v = np.array([[float(c) for c in row] for row in cov])
    ids = [*range(90), *range(96, 99)]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == n * 8 == len(got) and {i for i, _ in got} == set(ids)
    y = np.array([[got[i, k].whitened for k in range(1, 9)] for i in ids])
    assert all(int(got[i, 1].deviation) == sum((n * c - s) ** 2 for c, s in zip(x[a], sums, strict=True)) and got[i, 1].n == n for a, i in enumerate(ids))
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert np.allclose([got[0, k].explained for k in range(1, 9)], values[:8] / np.trace(v), rtol=1e-9)
    c = y - y.mean(0)
    assert np.abs(c.T @ c / n - np.eye(8)).max() < 1e-9 and rows[0].identity_error < 1e-9
    # The projections are those on eigenvectors: unwhitened, they give back the covariance with each coordinate.
    centred = np.array([[float(Fraction(a * n - s, n)) for a, s in zip(r, sums, strict=True)] for r in x])
    axes = centred.T @ y / n / np.sqrt(values[:8])
    assert np.allclose(v @ axes, axes * values[:8], atol=1e-7 * values[0]) and np.allclose((axes**2).sum(0), 1)


def test_sums_of_any_size(spark):
    big = [[float(np.float32(1e15 * (i % 7 - 3))), float(i % 5), 0.5] for i in range(40)]
    s = scatter(usable(table(spark, big), 1024, 100_000), 1024)
    x = [[math.floor(1024 * float(np.float32(c))) for c in v] for v in big]
    assert s.n == 40 and s.sums.tolist() == [sum(c) for c in zip(*x, strict=True)]
    assert s.products.tolist() == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]
    # A constant dimension: exactly no variance.
    assert s.scaled_covariance()[2].tolist() == [0, 0, 0] and whitener(s).flat.tolist()[2]
    rows = whiten(table(spark, big)).collect()
    assert len(rows) == 120 and all((r.whitened is None) == (r.component >= 2) for r in rows)


def test_beyond_the_range_is_dropped(spark):
    rows = whiten(table(spark, [[1e30, 1.0], [1.0, 2.0], [2.0, 1.0], [2.0, 3.0]])).collect()
    assert {r.vec_id for r in rows} == {1, 2, 3} and {r.component for r in rows} == {1, 2} and rows[0].identity_error < 1e-9


@pytest.mark.parametrize("vectors", [[], [None], [[None, 1.0]], [[]]])
def test_nothing_to_fit(spark, vectors):
    assert whiten(table(spark, vectors)).count() == 0


def test_one_vector_has_no_variance(spark):
    rows = whiten(table(spark, [[1.0, 2.0]] * 3)).collect()
    assert len(rows) == 6 and all((r.whitened, r.explained, r.deviation, r.identity_error) == (None, 0.0, 0, None) for r in rows)


@pytest.mark.parametrize("value", [0, 1, -1, 2**30, -(2**30) - 5, 3**80, -(7**70)])
def test_digits(value):
    assert sum(d << (whitening.DIGIT * k) for k, d in enumerate(digits(value))) == value and all(abs(d) < 1 << 30 for d in digits(value))


@pytest.mark.parametrize("size", [10, 2**25, 2**40])
def test_products_are_exact(size):
    x = np.random.default_rng(1).integers(-size, size, (50, 4))
    assert cross_products(x).tolist() == [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(4)] for i in range(4)]


def test_query(spark, tmp_path):
    table(spark, random_vectors(50, 6, 2)).write.parquet(str(tmp_path / "embeddings.parquet"))
    df = op12_embedding_whitening(spark, str(tmp_path))
    assert df.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")] and df.count() == 300
