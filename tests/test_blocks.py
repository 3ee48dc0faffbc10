"""The exact GP by blocks: the dense algebra's scores, state and predictions on more rows than the cap."""

import numpy as np
import pytest

from surrogata.functions.kernels import matern52
from surrogata.operators import blocks, emulators, exact, sgp

from test_exact import frame


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(7)
    X = draw.uniform(-1, 1, (700, 3))                       # two blocks
    return X, np.sin(3 * X[:, 0]) + 0.3 * X[:, 2] + 0.05 * draw.standard_normal(700)


def test_factor_by_blocks_in_memory_and_on_disk():
    draw = np.random.default_rng(3)
    X, Y, new, ls = draw.normal(size=(75, 4)), draw.normal(size=(75, 2)), draw.normal(size=(9, 4)), np.ones(4)
    L = np.linalg.cholesky(matern52(X, X, ls) + 0.01 * np.eye(75))
    for block, held in ((16, 1 << 20), (16, 20_000), (16, 0), (100, 0)):
        f = blocks.Factor("matern_5_2", X, ls, 0.01, block, held)
        assert f.log_det == pytest.approx(2 * np.log(np.diag(L)).sum(), rel=1e-12)
        np.testing.assert_allclose(f.whiten(Y).T, np.linalg.solve(L, Y), atol=1e-10)
        np.testing.assert_allclose(f.whiten_kernel(new).T, np.linalg.solve(L, matern52(X, new, ls)), atol=1e-10)
    with pytest.raises(np.linalg.LinAlgError):
        blocks.Factor("matern_5_2", np.zeros((40, 4)), ls, -0.5, 16)


def test_scores_are_those_of_the_dense_search(spark, rows):
    X, y = rows[0][:120], rows[1][:120]
    Y = np.stack([y, y ** 2 - 2.0], 1)
    cfg = sgp.GPConfig(prior="reference")
    dense, own = exact.ExactSearch(spark, X, Y, cfg), blocks.BlockSearch(spark, X, Y, cfg)
    ratios, base = np.array([1e-4, 0.1, 1.0]), np.array([0.5, 1.0, 2.0])
    for a, b in zip(dense.quick([base, 2 * base], ratios), own.quick([base, 2 * base], ratios)):
        np.testing.assert_allclose(b, a, rtol=1e-7)
    np.testing.assert_allclose(own.moves(base, ratios, [0.5, 2.0]), dense.moves(base, ratios, [0.5, 2.0]), rtol=1e-7)
    np.testing.assert_allclose(own.full(base), dense.full(base), atol=0.02)
    dense.close(), own.close()


def test_more_rows_than_the_cap(spark, rows):
    X, y = rows
    few = dict(ard_rounds=1, ard_groups=2, input_rounds=1, refine_rounds=0, multipliers=(0.5, 1.0))
    df = frame(spark, X, y)
    for name in ("exact_gp", "rgasp"):
        with pytest.raises(ValueError, match="exact"):
            emulators.make(name, exact_cap=600, **few).fit(df)
        em = emulators.make(name, exact_cap=600, blocks=True, **few).fit(df)
        st, dense = em.state, emulators.make(name, **few).fit(df).state
        assert em.mode == "all" and len(st.Z) == 700 and st.bound == pytest.approx(dense.bound, abs=0.05)
        np.testing.assert_allclose(st.lengthscale, dense.lengthscale)
        new = np.random.default_rng(1).uniform(-1, 1, (15, 3))
        mean, var, lml = sgp.dense_gp_reference(X, y, new, st.lengthscale, st.s2[0], st.sigma2[0])
        got = sorted(em.predict(frame(spark, new, np.zeros(15), 5)).collect(), key=lambda r: r["id"])
        assert st.bound == pytest.approx(lml, rel=1e-8)
        np.testing.assert_allclose([r["mean"] for r in got], mean, atol=1e-7)
        np.testing.assert_allclose([r["sd"] ** 2 for r in got], var, atol=1e-7)


def test_outputs_have_their_own_ratios(spark, rows):
    X, y = rows[0][:90], rows[1][:90]
    Y = np.stack([y, 2 * y + 1, np.random.default_rng(2).normal(size=90)], 1)
    cfg = sgp.GPConfig(inducing="all", exact_cap=50, blocks=True, refine_rounds=0, multipliers=(1.0,))
    st = sgp.fit(frame(spark, X, Y), cfg=cfg)
    assert st.s2[1] == pytest.approx(4 * st.s2[0]) and st.sigma2[2] / st.s2[2] > 10 * st.sigma2[0] / st.s2[0]
    got = sorted(sgp.predict(frame(spark, X[:5], Y[:5]).drop("y"), st).collect(), key=lambda r: r["id"])
    for t in range(3):
        mean, var, _ = sgp.dense_gp_reference(X, Y[:, t], X[:5], st.lengthscale, st.s2[t], st.sigma2[t])
        np.testing.assert_allclose([r["mean"][t] for r in got], mean, atol=1e-7)
        np.testing.assert_allclose([r["sd"][t] ** 2 for r in got], var, atol=1e-7)


def test_queries_ask_for_blocks(monkeypatch):
    from surrogata.plans import registry
    asked = {}
    monkeypatch.setattr(registry, "_eval", lambda spark, sf, model, **kw: asked.update({model: kw}))
    registry.q_gp_exact_embeddings(None, "")
    registry.q_gp_rgasp_embeddings(None, "")
    assert asked == {"exact_gp": {"blocks": True}, "rgasp": {"blocks": True}}
