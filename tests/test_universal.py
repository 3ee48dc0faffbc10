"""A trend fitted with the GP equals dense universal kriging."""

import numpy as np
import pytest

from surrogata.functions.kernels import matern52
from surrogata.operators import emulators, sgp, universal


def frame(spark, X, Y):
    kind = "double" if Y.ndim == 1 else "array<double>"
    return spark.createDataFrame([(i, x.tolist(), y.tolist() if Y.ndim > 1 else float(y)) for i, (x, y) in
                                  enumerate(zip(X, Y))], f"id long, x array<double>, y {kind}").repartition(3)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(23)
    X = draw.uniform(0, 10, (80, 2))
    return X, 5 + 3 * X[:, 0] - 2 * X[:, 1] + np.sin(X[:, 0]) + 0.1 * draw.standard_normal(80), \
        draw.uniform(-2, 12, (9, 2))


def dense(X, y, new, ls, s2, sigma2):
    H, h = (np.hstack([np.ones((len(A), 1)), A]) for A in (X, new))
    C = s2 * matern52(X, X, ls) + sigma2 * np.eye(len(X))
    Ci = np.linalg.inv(C)
    k = s2 * matern52(new, X, ls)
    hch = np.linalg.inv(H.T @ Ci @ H)
    beta = hch @ H.T @ Ci @ y
    u = h - k @ Ci @ H
    mean = h @ beta + k @ Ci @ (y - H @ beta)
    var = s2 - np.einsum("ij,jk,ik->i", k, Ci, k) + sigma2 + np.einsum("ij,jk,ik->i", u, hch, u)
    r = y - H @ beta
    lml = -0.5 * (len(y) * np.log(2 * np.pi) + np.linalg.slogdet(C)[1] + r @ Ci @ r)
    return mean, var, beta, lml


def predicted(spark, state, new):
    out = sorted(universal.predict_universal(frame(spark, new, np.zeros(len(new))).drop("y"), state).collect(),
                 key=lambda r: r["id"])
    return np.array([r["mean"] for r in out]), np.array([r["sd"] for r in out])


def test_equals_dense_universal_kriging(spark, rows):
    X, y, new = rows
    st = universal.fit_universal(frame(spark, X, y), cfg=sgp.GPConfig(inducing="all", ard_rounds=2))
    gp = st.gp
    mean, var, beta, lml = dense(X, y, new, gp.lengthscale, gp.s2[0], gp.sigma2[0])
    got, sd = predicted(spark, st, new)
    np.testing.assert_allclose(got, mean, rtol=1e-5, atol=1e-5)
    np.testing.assert_allclose(sd ** 2, var, rtol=1e-4)
    np.testing.assert_allclose(st.coefficients()[:, 0], beta, rtol=1e-5)
    assert gp.bound == pytest.approx(lml, rel=1e-5)
    for other in (0.5, 2.0):                              # scale and noise are the best of this kernel
        assert dense(X, y, new, gp.lengthscale, gp.s2[0] * other, gp.sigma2[0])[3] <= lml + 1e-3


def test_trend_is_estimated_with_the_kernel(spark, rows):
    """Correlated errors: generalised least squares differs from plain least squares."""
    X, y, new = rows
    em = emulators.rgasp(trend="linear", ard_rounds=1).fit(frame(spark, X, y))
    plain = np.linalg.lstsq(np.hstack([np.ones((80, 1)), X]), y, rcond=None)[0]
    assert em.mode == "all" and np.abs(em.beta[:, 0] - plain).max() > 1e-3
    far = spark.createDataFrame([(0, [40.0, -30.0])], "id long, x array<double>")
    [row] = em.predict(far).collect()
    assert row["mean"] == pytest.approx(5 + 3 * 40 + 2 * 30, rel=0.1) and row["sd"] > 0.5


def test_outputs_have_their_own_trend(spark, rows):
    X, y, new = rows
    both = universal.fit_universal(frame(spark, X, np.stack([y, 7 - 4 * y], 1)),
                                   cfg=sgp.GPConfig(max_inducing=40, multipliers=(1.0,), refine_rounds=0))
    np.testing.assert_allclose(both.coefficients()[:, 1], -4 * both.coefficients()[:, 0] + [7, 0, 0], rtol=1e-4, atol=1e-4)
    assert both.gp.s2[1] == pytest.approx(16 * both.gp.s2[0], rel=1e-4)
    rows = spark.createDataFrame([(0, [1.0, 2.0])], "id long, x array<double>")
    plan = universal.predict_universal(rows, both)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        universal.fit_universal(frame(spark, X, y).limit(0))
