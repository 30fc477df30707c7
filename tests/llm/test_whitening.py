import math

import numpy as np
import pytest

from outcomelens.llm import whitening as W

VEC = "vec_id long, embedding array<float>, n int, y int, deviation string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x") for i, v in rows], VEC)


def direct(rows):
    """All columns by a plain eigendecomposition of the exact covariance."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(0)
    centred = (n * fit - s).astype(float) / n
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    keep = min(16, int((e > 1e-10 * e[0]).sum()))
    dev = [int(((n * np.array(r, object) - s) ** 2).sum()) for r in x]
    z = ((n * np.array(x, object) - s).astype(float) / n) @ u[:, :keep] / np.sqrt(e[:keep])
    return n, dev, z, e[:keep] / np.trace(cov)


def test_secular_update_equals_a_full_decomposition():
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 40):
        a = rng.normal(size=(3, d, d))
        a = np.einsum("lij,lkj->lik", a, a)
        a[1] = np.diag(np.repeat([1.0, 2.0], d)[:d])  # equal eigenvalues
        values, vectors = map(np.array, zip(*(np.linalg.eigh(m) for m in a)))
        y, rho = rng.normal(size=(3, d)), np.array([0.5, 2.0, 1e-9])
        y[2, : d // 2] = 0
        e, u = W.rank_one(values, vectors, y, rho)
        whole = a + rho[:, None, None] * y[:, :, None] * y[:, None, :]
        for k in range(3):
            scale = np.abs(whole[k]).max()
            assert np.allclose(e[k], np.linalg.eigvalsh(whole[k]), atol=1e-13 * scale * d)
            assert np.allclose(u[k].T @ u[k], np.eye(d), atol=1e-13 * d)
            assert np.allclose(u[k] * e[k] @ u[k].T, whole[k], atol=1e-12 * scale * d)


def test_spectra_of_parts_combine():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 12)) * np.arange(1, 13) + 1000
    parts = []
    for rows in (x[:50], x[50:83], x[83:]):
        s = W.empty(1, 12)
        for row in rows:
            s = W.add(s, row[None])
        parts.append(s)
    s = W.combined(W.combined(parts[0], parts[1]), parts[2])
    assert np.allclose(s.values[0], np.linalg.eigvalsh(np.cov(x.T, ddof=0) * 90), rtol=1e-9)
    assert np.allclose(s.mean[0], x.mean(0)) and s.n[0] == 90
    lanes = W.empty(5, 12)
    for k in range(0, 90, 5):
        lanes = W.add(lanes, x[k:k + 5])
    assert np.allclose(W.folded(lanes).values[0], s.values[0], rtol=1e-9)


@pytest.mark.parametrize("d,n", [(24, 400), (3, 60), (64, 40)])
def test_equals_a_plain_decomposition(spark, d, n):
    rng = np.random.default_rng(d)
    rows = [(i, v) for i, v in enumerate((rng.normal(size=(n, d)) * np.linspace(0.2, 1, d)).tolist())]
    rows += [(1000 + i, rows[0][1]) for i in range(70)] + [(5, rows[9][1])]
    got = W.digest(frame(spark, rows).repartition(7)).collect()
    count, dev, z, share = direct(rows)
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    assert len(got) == len(rows) * len(share)
    sign = {}
    for (i, _), t, row in zip(rows, dev, z):
        m = mine[i, t]
        assert sorted(m) == list(range(1, len(share) + 1))
        for c, want in enumerate(row, 1):
            if c not in sign and abs(want) > 1e-3:
                sign[c] = math.copysign(1, want * m[c].whitened)
            assert abs(m[c].whitened * sign.get(c, 1) - want) < 1e-8
            assert m[c].n == count and abs(m[c].explained / share[c - 1] - 1) < 1e-10
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9


def test_defined_cases(spark):
    bad = [(1, None), (2, [None, 1]), (3, [float("nan"), 1]), (4, [float("inf"), 1]), (5, [1, 2, 3]), (6, [])]
    good = [(7, [0, 0]), (None, [1, 0]), (7, [0, 0]), (8, [3, 0])]
    got = W.digest(frame(spark, bad + good)).collect()
    assert len(got) == 4 and {r.component for r in got} == {1} and {r.n for r in got} == {3}
    assert sorted(str(r.vec_id) for r in got) == ["7", "7", "8", "None"]
    assert all(abs(r.explained - 1) < 1e-12 for r in got)
    assert W.digest(frame(spark, [])).count() == 0
    assert W.digest(frame(spark, [(1, [2, 2]), (2, [2, 2])])).count() == 0
    huge = W.digest(frame(spark, [(1, [1e30, 0]), (2, [0, 0]), (3, [0, 1])])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id == 1) and len(huge) >= 3
