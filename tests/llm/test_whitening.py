"""Whitening against numpy's eigenvectors and exact integers."""

import random
from collections import Counter

import numpy as np
import pytest

from mdloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<double>, component string, n int"


def frame(spark, data, parts=3):
    return spark.createDataFrame([(i, e, "clash", 1) for i, e in data], SCHEMA).repartition(parts)


def vectors(n=300, d=7, seed=1):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + np.linspace(-3, 3, d)
    return [(i, list(map(float, row))) for i, row in enumerate(mixed)]


def check(got, data, components=32):
    usable = [(i, e) for i, e in data]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in e] for _, e in usable], object)
    n, sums = len(x), x.sum(axis=0)
    num = x * n - sums
    centred = (num / n).astype(float)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, x.shape[1])
    assert Counter((r.vec_id, r.component) for r in got) == Counter((i, c + 1) for i, _ in usable for c in range(k))
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    want = centred @ basis / np.sqrt(values)
    for row, (i, _) in enumerate(usable):
        assert {r.deviation for r in by[i].values()} == {int((num[row] ** 2).sum())} and {r.n for r in by[i].values()} == {n}
    for c in range(k):
        mine = np.array([by[i][c + 1].whitened for i, _ in usable])
        sign = 1 if mine @ want[:, c] > 0 else -1
        assert np.allclose(sign * mine, want[:, c], atol=1e-8)
        assert by[usable[0][0]][c + 1].explained == pytest.approx(values[c] / values.sum(), rel=1e-10)
    assert max(r.identity_error for r in got) < 1e-9


@pytest.mark.parametrize(("d", "parts", "fan_in"), [(1, 1, 16), (2, 2, 2), (7, 9, 2), (40, 3, 16)])
def test_whitening_equals_eigenvectors(spark, monkeypatch, d, parts, fan_in):
    monkeypatch.setattr(wh, "FAN_IN", fan_in)
    monkeypatch.setattr(wh, "BLOCK", 17)
    data = vectors(d=d)
    check(wh.whiten(frame(spark, data, parts)).collect(), data)


def test_rows_that_take_no_part(spark):
    good = vectors(60, 3)
    bad = [(900, None), (901, [1.0, None, 2.0]), (902, [1.0, float("nan"), 2.0]), (903, [float("-inf"), 0.0, 0.0]), (904, [1.0, 2.0]), (905, []), (906, [1e300, 0.0, 0.0]), (907, [0.0] * 4)]
    check(wh.whiten(frame(spark, good + bad)).collect(), good)


def test_null_and_repeated_ids_and_ties(spark):
    rows = [(None, [0.0, 1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [0.0, -1.0]), (5, [-1.0, 0.0])]
    got = wh.whiten(frame(spark, rows)).collect()
    assert Counter(r.vec_id for r in got) == {None: 2, 4: 6, 5: 2}


def test_no_variance_no_rows(spark):
    assert wh.whiten(frame(spark, [])).count() == 0
    assert wh.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert wh.whiten(frame(spark, [(i, [1.0, 2.0]) for i in range(9)])).count() == 0
    flat = wh.whiten(frame(spark, [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and flat[0].explained == pytest.approx(1) and flat[0].identity_error < 1e-12
    assert wh.whiten(frame(spark, [(i, []) for i in range(3)])).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    data = [(i, [float(rng.randint(-(10**5) * 3, 10**5 * 3)), float(rng.randint(-(10**4), 10**4))]) for i in range(40)]
    check(wh.whiten(frame(spark, data)).collect(), data)
    huge = wh.whiten(frame(spark, [(i, [(-1.0) ** i * 1e17, float(i)]) for i in range(6)])).collect()
    assert {r.deviation for r in huge} == {None} and huge[0].identity_error < 1e-9


def test_jacobi_keeps_small_values():
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    sizes = 10.0 ** -np.arange(9)
    v, sigma = wh.jacobi(np.diag(sizes) @ q.T)
    assert np.allclose(sigma / sizes, 1, rtol=1e-12) and np.allclose(np.abs(v.T @ q), np.eye(9), atol=1e-9)


def test_the_query_runs_over_the_whole_table(spark, tmp_path):
    data = vectors(50, 5)
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    check(wh.op11_jacobi_svd_whitening(spark, str(tmp_path)).collect(), data)
