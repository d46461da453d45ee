"""Spectrum slicing and whitening against numpy's dense solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotledger.llm import spectrum, whitening


@pytest.mark.parametrize("values", [[9, 5, 3, 2, 1, 0.5], [4, 4, 4, 1, 0, 0], [7, 7, 2, 2, 2, 1], [1, 0, 0, 0, 0, 0], [5, 5 - 1e-9, 1, 1e-3, 1e-6, 0]])
def test_leading_pairs(values):
    turn = np.linalg.qr(np.random.default_rng(3).normal(size=(6, 6)))[0]
    matrix = turn @ np.diag(values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = spectrum.leading(matrix, 4)
    want = [v for v in values if v > 0][:4]
    assert np.allclose(found, want, rtol=1e-10, atol=1e-12)
    assert np.allclose(vectors.T @ vectors, np.eye(len(want)), atol=1e-10)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-11


def test_counts_equal_eigenvalues():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 20):
        a = rng.normal(size=(n, n))
        a = a + a.T - np.diag(np.diagonal(a)) * (n % 2)  # zero diagonals as well
        values = np.linalg.eigvalsh(a)
        for shift in rng.normal(size=40) * n:
            assert spectrum.count_above(a, shift) == (values > shift).sum()
    assert spectrum.count_above(np.zeros((3, 3)), 0.0) == 0


def brute(rows):
    usable = [(i, [float(np.floor(256 * float(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.unique(np.array([x for _, x in usable]), axis=0)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    centred = fit - np.array(total) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    out = {}
    for i, x in usable:
        w = (np.array(x) - np.array(total) / n) @ vectors / np.sqrt(values)
        out.setdefault(i, []).append((n, sum((n * int(v) - s) ** 2 for v, s in zip(x, total, strict=True)), w))
    return out, values / np.trace(centred.T @ centred / n)


def compare(got, rows):
    want, explained = brute(rows)
    assert {r.vec_id for r in got} == set(want) and len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        options = want[r.vec_id]
        assert any(r.n == n and r.deviation == d for n, d, _ in options)
        sign = signs.setdefault(r.component, np.sign(r.whitened) * np.sign(options[0][2][r.component - 1]))
        assert any(abs(r.whitened - sign * w[r.component - 1]) < 1e-6 for _, _, w in options)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    compare(whitening.query(spark, sf).collect(), [(r.vec_id, r.embedding) for r in df.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).round(3).tolist()) for i in range(40)]
    rows += [(40, None), (41, [1.0, None, 0.0, 0.0, 0.0]), (42, [float("nan")] * 5), (43, [1.0, float("-inf"), 0.0, 0.0, 0.0]), (3, rows[3][1]), (44, rows[3][1]), (None, rows[5][1]), (45, [-0.0] * 5)]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, x double, n int")
    compare(whitening.whiten(df.repartition(5)).collect(), rows)


def test_degenerate_tables(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0
    assert whitening.whiten(make([(1, None)])).count() == 0
    assert whitening.whiten(make([(1, [0.5, 1.0]), (2, [0.5, 1.0])])).count() == 0
    assert whitening.whiten(make([(1, []), (2, [])])).count() == 0
    assert [r.component for r in whitening.whiten(make([(1, [0.5, 1.0]), (2, [0.5, 2.0]), (3, [1.0])])).collect()] == [1, 1]
    huge = whitening.whiten(make([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [1.0, 2.0])])).agg(F.count("*"), F.count("deviation")).first()
    assert huge[0] >= 3 and huge[1] < huge[0]
