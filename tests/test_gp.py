"""GP-1/2/3: the inducing-point GP with Z = training rows equals the dense exact GP."""

import numpy as np
import pytest

from surrogata.operators import sgp


def _frame(spark, X, y, parts):
    rows = [(i, X[i].tolist(), float(y[i])) for i in range(len(X))]
    return spark.createDataFrame(rows, "id long, x array<double>, y double").repartition(parts)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    X = rng.normal(size=(80, 3))
    y = np.sin(X[:, 0]) + 0.5 * X[:, 1] ** 2 + 0.05 * rng.normal(size=80) + 3.0
    Xs = rng.normal(size=(15, 3))
    return X, y, Xs


def test_bound_equals_exact_lml_at_fixed_hyperparameters(data):
    from surrogata.functions.kernels import matern52
    X, y, _ = data
    ls = np.full(3, 1.5)
    K1 = matern52(X, X, ls)
    yb = y.mean()
    Li = sgp._whitener(K1, 1e-10)
    Fw = K1 @ Li.T
    a, G, beta, gamma = sgp._decompose(Li, Fw.T @ Fw, (Fw.T @ (y - yb))[:, None])
    yyc = np.array([((y - yb) ** 2).sum()])
    for s2, sg in ((1.0, 1e-3), (1.0, 1e-2), (3.0, 0.1)):
        b = sgp._grid_bound(a, gamma, yyc, len(y), np.array([s2]), np.array([sg]))[0, 0, 0]
        _, _, lml = sgp.dense_gp_reference(X, y, X[:2], ls, s2, sg)
        assert abs(b - lml) < 1e-4


def test_exact_equivalence(spark, data):
    X, y, Xs = data
    st = sgp.fit(_frame(spark, X, y, 3), cfg=sgp.GPConfig(inducing="all", min_noise=1e-2))
    mean, var, lml = sgp.dense_gp_reference(X, y, Xs, st.lengthscale, st.s2[0], st.sigma2[0])
    assert st.bound <= lml + 1e-6 and abs(st.bound - lml) < 1e-4 * abs(lml)
    tdf = spark.createDataFrame([(i, Xs[i].tolist()) for i in range(len(Xs))], "id long, x array<double>")
    pr = sorted(sgp.predict(tdf, st).collect(), key=lambda r: r["id"])
    pm = np.array([r["mean"] for r in pr])
    ps = np.array([r["sd"] for r in pr])
    assert np.max(np.abs(pm - mean)) < 1e-4
    assert np.max(np.abs(ps ** 2 - var)) < 1e-4
    assert all(r["lower"] < r["mean"] < r["upper"] for r in pr)


def test_partition_invariance(spark, data):
    X, y, _ = data
    cfg = sgp.GPConfig(inducing="all", refine_rounds=0)
    b = [sgp.fit(_frame(spark, X, y, p), cfg=cfg).bound for p in (1, 3, 7)]
    assert max(b) - min(b) < 1e-6 * max(1.0, abs(b[0]))


def test_exact_models_are_exact_or_raise(spark):
    from surrogata.operators import emulators
    draw = np.random.default_rng(5)
    X = draw.uniform(-1, 1, (1100, 2))
    df = _frame(spark, X, np.sin(3 * X[:, 0]) + X[:, 1], 3)
    quick = dict(multipliers=(1.0,), refine_rounds=0, ard_rounds=0)
    for name in ("exact_gp", "rgasp"):
        em = emulators.make(name, **quick).fit(df)
        assert em.mode == "all" and len(em.state.Z) == 1100
    many = _frame(spark, draw.uniform(-1, 1, (sgp.MAX_INDUCING + 1, 2)), draw.normal(size=sgp.MAX_INDUCING + 1), 3)
    for name in ("exact_gp", "rgasp"):
        with pytest.raises(ValueError, match="exact"):
            emulators.make(name, **quick).fit(many)
    assert emulators.make("sparse_rgasp", m=20, **quick).fit(many).mode == "landmarks"


def test_sparse_bound_below_exact(spark, data):
    X, y, _ = data
    df = _frame(spark, X, y, 2)
    exact = sgp.fit(df, cfg=sgp.GPConfig(inducing="all", refine_rounds=0, multipliers=(1.0,)))
    Z = X[:20]
    sparse = sgp.fit(df, cfg=sgp.GPConfig(refine_rounds=0, multipliers=(1.0,)), Z=Z)
    assert sparse.bound <= exact.bound + 1e-6


def test_vector_outputs_share_kernel(spark, data):
    X, y, _ = data
    rows = [(i, X[i].tolist(), [float(y[i]), float(2 * y[i] + 1)]) for i in range(len(X))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    st = sgp.fit(df, cfg=sgp.GPConfig(inducing="all", refine_rounds=0))
    assert st.p == 2
    out = sgp.predict(df.select("id", "x"), st).collect()
    m = np.array([r["mean"] for r in out])
    assert np.allclose(m[:, 1], 2 * m[:, 0] + 1, atol=0.05)


def test_predict_has_no_shuffle(spark, data):
    X, y, _ = data
    st = sgp.fit(_frame(spark, X, y, 2), cfg=sgp.GPConfig(inducing="all", refine_rounds=0))
    tdf = spark.createDataFrame([(i, X[i].tolist()) for i in range(5)], "id long, x array<double>")
    plan = sgp.predict(tdf, st)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_unknown_kernel_raises():
    from surrogata.functions.kernels import get_kernel
    with pytest.raises(ValueError):
        get_kernel("laplace")
