"""The exact GP: one lengthscale an input, moves by updated distances, never below the block search."""

import numpy as np
import pytest

from surrogata.functions.kernels import kernel_of_sqdist, matern52, scaled_sqdist
from surrogata.functions.synthetic import generate
from surrogata.operators import emulators, exact, sgp


def frame(spark, X, Y, parts=3):
    kind = "double" if Y.ndim == 1 else "array<double>"
    return spark.createDataFrame([(i, x.tolist(), y.tolist() if Y.ndim > 1 else float(y)) for i, (x, y) in
                                  enumerate(zip(X, Y))], f"id long, x array<double>, y {kind}").repartition(parts)


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    X = draw.uniform(-1, 1, (90, 6))
    return X, np.sin(4 * X[:, 0]) + 0.3 * X[:, 3] + 0.02 * draw.standard_normal(90)


def test_state_is_the_dense_gp(spark, rows):
    X, y = rows
    st = sgp.fit(frame(spark, X, y), cfg=sgp.GPConfig(inducing="all", min_noise=1e-3, input_rounds=2))
    new = np.random.default_rng(1).uniform(-1, 1, (7, 6))
    mean, var, lml = sgp.dense_gp_reference(X, y, new, st.lengthscale, st.s2[0], st.sigma2[0])
    got = sorted(sgp.predict(frame(spark, new, np.zeros(7)).drop("y"), st).collect(), key=lambda r: r["id"])
    assert abs(st.bound - lml) < 1e-6 * abs(lml) + 1e-4 and st.mode == "all"
    np.testing.assert_allclose([r["mean"] for r in got], mean, atol=1e-6)
    np.testing.assert_allclose([r["sd"] ** 2 for r in got], var, atol=1e-6)


def test_moves_score_what_a_fresh_kernel_scores(spark, rows):
    X, y = rows
    cfg = sgp.GPConfig(prior="reference")
    search = exact.ExactSearch(spark, X, y[:, None], cfg)
    base, rho = np.linspace(0.5, 2.0, 6), np.array([0.01])
    got = search.moves(base, rho, [0.5, 1.0, 2.0])
    for j in range(6):
        for k, f in enumerate((0.5, 1.0, 2.0)):
            ls = base.copy()
            ls[j] *= f
            K = matern52(X, X, ls) + (0.01 + sgp.EXACT_JITTER) * np.eye(len(X))
            yc = y - y.mean()
            s2 = yc @ np.linalg.solve(K, yc) / len(X)
            want = -0.5 * (len(X) * np.log(2 * np.pi * s2) + np.linalg.slogdet(K)[1] + len(X))
            assert got[j, k] == pytest.approx(want + sgp.log_prior(ls, len(X), cfg), rel=1e-7)
    search.close()


def test_relevant_inputs_get_short_lengthscales(spark, rows):
    X, y = rows
    block = sgp.fit(frame(spark, X, y), cfg=sgp.GPConfig(inducing="all", ard_rounds=2, ard_groups=2))
    own = sgp.fit(frame(spark, X, y), cfg=sgp.GPConfig(inducing="all", ard_rounds=2, ard_groups=2, input_rounds=6))
    assert own.search[-1]["stage"] == "input-full" and own.bound > block.bound + 5
    assert own.lengthscale[0] < min(own.lengthscale[[1, 2, 4, 5]]) / 2 and len(set(own.lengthscale)) == 6


def test_published_design_has_a_lengthscale_an_input(spark):
    """500 x 100 design, 425 rows: the score is never below the search by blocks."""
    train = generate(spark, 500, 42).where("id < 425").selectExpr("id", "x", "y")
    block = emulators.exact_gp(input_rounds=0).fit(train).state
    state = emulators.exact_gp(input_rounds=3).fit(train).state
    full = [s["score"] for s in state.search if s["stage"].endswith("-full")]
    assert full == sorted(full) and state.bound >= block.bound and len(set(state.lengthscale)) > 20


def test_mode_does_not_depend_on_the_row_count(spark, rows):
    X, y = rows
    assert sgp.fit(frame(spark, X, y), cfg=sgp.GPConfig(multipliers=(1.0,), refine_rounds=0)).mode == "landmarks"
    with pytest.raises(ValueError, match="exact"):
        sgp.fit(frame(spark, X, y), cfg=sgp.GPConfig(inducing="all", exact_cap=80))
    with pytest.raises(ValueError):
        sgp.fit(frame(spark, X, y).limit(0), cfg=sgp.GPConfig(inducing="all"))


def test_vector_outputs(spark, rows):
    X, y = rows
    st = sgp.fit(frame(spark, X, np.stack([y, 3 * y - 1], 1)), cfg=sgp.GPConfig(inducing="all", input_rounds=2))
    assert st.p == 2 and st.s2[1] == pytest.approx(9 * st.s2[0], rel=1e-6)
    np.testing.assert_allclose(kernel_of_sqdist("rbf", scaled_sqdist(X, X, np.ones(6))).diagonal(), 1.0)
