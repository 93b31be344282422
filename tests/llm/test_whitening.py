"""Whitened embeddings against a dense eigenvalue problem."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stridewell.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component int"


def test_lanczos_finds_repeated_and_clustered_eigenvalues():
    r = np.random.default_rng(1)
    for values, wanted in (([5.0] * 40 + [1.0] * 20, 32), ([7.0, 7.0, 7.0] + [0.0] * 50, 10), (1 / np.arange(1, 90) ** 2, 12), (np.arange(9.0), 32), ([0.0] * 20, 4)):
        v = np.sort(np.array(values, float))[::-1]
        q = np.linalg.qr(r.standard_normal((len(v), len(v))))[0]
        a = q * v @ q.T
        e, u = W.lanczos(lambda x: a @ x, len(v), wanted, block=4)
        k = min(wanted, len(v))
        assert np.allclose(e, v[:k], atol=1e-12) and np.abs(a @ u - u * e).max() < 1e-11 and np.abs(u.T @ u - np.eye(k)).max() < 1e-12


def dense(rows, wanted=32):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(axis=0)
    y = ((n * x - s).astype(np.float64)) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:wanted], vectors[:, ::-1][:, :wanted]
    keep = values > 1e-11 * values[0]
    deviation = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    return deviation, y @ vectors[:, keep] / np.sqrt(values[keep]), values[keep] / (y ** 2).sum() * n


def test_whitening_equals_the_dense_problem(spark):
    r = np.random.default_rng(5)
    base = r.standard_normal((300, 20)) * np.linspace(3, 0.2, 20)
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (None, rows[7][1])]  # repeated and null ids
    odd = [(900, None), (901, [1.0] * 19 + [None]), (902, [float("nan")] * 20), (903, [float("inf")] * 20), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 3) for i, v in rows + odd], SCHEMA).repartition(5)
    for components, block in ((32, 16), (6, 2)):
        got = W.whiten(df, components, block).toPandas()
        deviation, white, shares = dense(rows, components)
        k = white.shape[1]
        assert len(got) == len(rows) * k and (got.n == len(rows)).all() and set(got.component) == set(range(1, k + 1))
        ids = [i for i, _ in rows]
        for j in range(k):
            own = got[got.component == j + 1]
            assert np.allclose(own.explained, shares[j], rtol=1e-10)
            mine = own[own.vec_id == 0].whitened.iloc[0]
            sign = 1 if (mine > 0) == (white[0, j] > 0) else -1
            for i in (0, 1, 5, 299):
                assert np.allclose(own[own.vec_id == i].whitened, sign * white[ids.index(i), j], atol=1e-8)
            assert len(own[own.vec_id == 5]) == 2 and own.vec_id.isna().sum() == 2
        assert {(int(i), int(d)) for i, d in zip(got.vec_id, got.deviation) if i == i} == {(i, d) for i, d in zip(ids, deviation) if i is not None}
        assert got.identity_error.nunique() == 1 and 0 <= got.identity_error.iloc[0] < 1e-9


def test_directions_without_variance_have_no_rows(spark):
    rows = [(i, [float(i), float(2 * i), 5.0], 0) for i in range(40)]
    got = W.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert set(got.component) == {1} and got.explained.iloc[0] == pytest.approx(1) and len(got) == 40
    for few in ([], rows[:1], [(i, [1.0, 2.0], 0) for i in range(9)], [(1, None, 0)]):
        assert W.whiten(spark.createDataFrame(few, SCHEMA)).count() == 0


def test_deviations_are_exact_or_null(spark):
    rows = [(i, [float(2 ** 38) * (-1) ** i], 0) for i in range(4)]  # (n x - S)^2 passes a long
    got = W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")).collect()
    assert [g.deviation for g in got] == [None] * 4 and all(abs(abs(g.whitened) - 1) < 1e-12 for g in got)
    with pytest.raises(Exception, match="too large"):
        W.whiten(spark.createDataFrame([(1, [1e300], 0)], "vec_id long, embedding array<double>, n int"))


def test_blocks_hold_all_rows(spark, monkeypatch):
    monkeypatch.setattr(W, "ROWS", 7)
    rows = [(i, [float(i % 11), float(i * i % 13)], 0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    got = W.whiten(df)
    assert got.count() == 200 and got.select(F.sum("vec_id")).first()[0] == 2 * sum(range(100))
