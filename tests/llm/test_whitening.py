import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritable.llm import whitening


def plain(rows, count=4):
    """The same by numpy's own eigensolver."""
    kept = [(k, [math.floor(256 * float(np.float32(c))) for c in v]) for k, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n = len(distinct)
    sums = [sum(c) for c in zip(*distinct)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in distinct], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = values.sum()
    out = []
    for key, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = np.array([c - s / n for c, s in zip(x, sums)])
        for j in range(min(count, (values > 1e-9 * trace).sum())):
            out.append((key, j + 1, n, deviation, y @ vectors[:, j] / math.sqrt(values[j]), values[j] / trace))
    return out


def same(got, want):
    got, want = sorted(got, key=repr), sorted(want, key=repr)
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    a, b = np.array([r["whitened"] for r in got]), np.array([r[4] for r in want])
    component = np.array([r["component"] for r in got])
    for j in set(component.tolist()):
        i = component == j
        sign = np.sign(a[i] @ b[i])
        np.testing.assert_allclose(a[i] * sign, b[i], rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose([r["explained"] for r in got], [r[5] for r in want], rtol=1e-10)
    assert all(r["identity_error"] < 1e-9 for r in got)


def random_rows(seed, n, d):
    draw = np.random.default_rng(seed)
    mix = draw.standard_normal((d, d)) * np.linspace(2, 0.2, d)
    return [(i, [float(x) for x in row]) for i, row in enumerate((draw.standard_normal((n, d)) @ mix + draw.standard_normal(d)).astype(np.float32))]


def test_against_numpy(spark):
    rows = random_rows(1, 300, 12)
    rows += [(1000, rows[0][1]), (1000, rows[0][1]), (None, rows[1][1]), (1001, None), (1002, rows[2][1][:11] + [None]), (1003, rows[2][1][:11] + [math.nan]), (1004, rows[2][1][:11] + [math.inf])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"key": F.lit(1), "x": F.lit("y"), "n": F.lit(None), "length": F.lit(0)})
    same(whitening.whiten(df.repartition(5)).collect(), plain(rows))


@pytest.mark.parametrize("values", [[3.0, 3.0, 3.0, 1.0, 1.0], [5.0, 5.0 - 1e-12, 1.0], [4.0, 0.0, 0.0], [1.0], [1e-9, 1e-12, 1e-13]])
def test_repeated_and_close_eigenvalues(values):
    draw = np.random.default_rng(3)
    q, _ = np.linalg.qr(draw.standard_normal((len(values), len(values))))
    matrix = q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found = whitening.leading(matrix, 4)
    assert len(found) == min(4, sum(v > 1e-13 * max(values) for v in values))
    for (value, vector), want in zip(found, sorted(values, reverse=True)):
        assert abs(value - want) < 1e-13 * max(values) * len(values)
        assert np.linalg.norm(matrix @ vector - value * vector) < 1e-13 * max(values) * len(values)
    basis = np.array([v for _, v in found])
    np.testing.assert_allclose(basis @ basis.T, np.eye(len(found)), atol=1e-12)


@pytest.mark.parametrize("size", [1, 2, 3, 8, 40])
def test_counts_are_those_of_the_eigenvalues(size):
    draw = np.random.default_rng(size)
    for kind in range(6):
        a = draw.integers(-3, 4, (size, size)).astype(float) if kind % 2 else draw.standard_normal((size, size))
        matrix = a + a.T
        if kind > 3:
            np.fill_diagonal(matrix, 0.0)
        values = np.linalg.eigvalsh(matrix)
        for shift in draw.uniform(values[0] - 1, values[-1] + 1, 8):
            assert whitening.above(matrix, shift) == (values > shift).sum()


def test_lengths_are_spaces_of_their_own(spark):
    a, b = random_rows(4, 60, 5), [(i + 500, v) for i, v in random_rows(5, 40, 3)]
    got = whitening.whiten(spark.createDataFrame(a + b + [(9999, [])], "vec_id long, embedding array<float>")).collect()
    same([r for r in got if r["vec_id"] < 500], plain(a))
    same([r for r in got if r["vec_id"] >= 500], plain(b, 3))


def test_long_vectors_large_values_and_empty(spark):
    wide = random_rows(6, 30, 300)
    same(whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<float>")).collect(), plain(wide))
    big = [(i, [c * 1e9 for c in v]) for i, v in random_rows(7, 50, 3)]
    got = whitening.whiten(spark.createDataFrame(big, "vec_id long, embedding array<float>")).collect()
    want = {(r[0], r[1]): r[3] for r in plain(big)}
    assert all(r["deviation"] == (d if (d := want[r["vec_id"], r["component"]]) < 1 << 63 else None) for r in got) and len(got) == len(want)
    one = spark.createDataFrame([(1, [0.5, 0.25]), (2, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert whitening.whiten(one).count() == 0
    assert whitening.whiten(one.limit(0)).count() == 0
