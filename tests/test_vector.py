"""Vector emulators from parts: own kernels, any reducers, three result tables, samples."""

import numpy as np
import pytest

from surrogata.operators import latent, sgp, vector
from surrogata.operators.emulators import PCAOutputGP


@pytest.fixture(scope="module")
def data(spark):
    draw = np.random.default_rng(17)
    X = draw.uniform(-1, 1, (120, 3))
    hidden = np.stack([np.sin(5 * X[:, 0]), X[:, 1] ** 2 + 0.2 * X[:, 2]], 1)
    Y = hidden @ draw.standard_normal((2, 14)) * 3 + 10 + 0.05 * draw.standard_normal((120, 14))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(X, Y))],
                               "id long, x array<double>, y array<double>").repartition(3).cache()
    return X, Y, df.where("id < 100"), df.where("id >= 100")


CFG = dict(max_inducing=60, ard_rounds=2, ard_groups=3)


def arrays(df, *names):
    rows = sorted(df.collect(), key=lambda r: r["id"])
    return [np.array([r[c] for r in rows]) for c in names]


def test_own_kernels_equal_separate_fits(spark, data):
    X, _, train, test = data
    from pyspark.sql import functions as F
    two = train.withColumn("y", F.array(F.sin(5 * F.col("x")[0]), 40 * F.col("x")[1] + F.col("x")[2]))
    Z = X[:40]
    states = latent.fit_each(two, "x", "y", sgp.GPConfig(**CFG), Z=Z)
    got = arrays(latent.predict_each(test, states, "x", keep=["id"], z=2.0), "mean", "sd", "lower", "upper")
    for t in range(2):
        one = sgp.fit(two.withColumn("y", F.col("y")[t]), "x", "y", sgp.GPConfig(**CFG), Z=Z)
        np.testing.assert_allclose(states[t].lengthscale, one.lengthscale)
        assert states[t].bound == pytest.approx(one.bound, rel=1e-9) and states[t].mode == "given"
        want = arrays(sgp.predict(test.select("id", "x"), one, z=2.0), "mean", "sd", "lower", "upper")
        for a, b in zip(got, want):
            np.testing.assert_allclose(a[:, t], b, rtol=1e-7, atol=1e-9)
    assert not np.allclose(states[0].lengthscale, states[1].lengthscale)


def test_passes_are_shared(spark, data):
    X, _, train, _ = data
    cfg = sgp.GPConfig(max_inducing=30, refine_rounds=1)
    passes = latent._Passes(train, "x", "y", X[:30], cfg)
    states = latent._search(passes, np.ones(3), cfg)
    assert len(states) == 14 and passes.passes == 2


def test_linear_case_equals_the_pca_emulator(spark, data):
    _, Y, train, test = data
    cfg = sgp.GPConfig(max_inducing=60)
    old = PCAOutputGP(n_components=0.99, cfg=cfg).fit(train)
    new = vector.VectorEmulator(output_reducer=vector.LinearReducer(0.99), cfg=cfg).fit(train)
    for a, b in zip(arrays(new.predict(test), "mean", "sd", "lower", "upper"),
                    arrays(old.predict(test), "mean", "sd", "lower", "upper")):
        np.testing.assert_allclose(a, b, rtol=1e-6)
    assert np.sqrt(((arrays(new.predict(test), "mean")[0] - Y[100:]) ** 2).mean()) < 0.5 * Y.std(0).mean()


def test_draws_approach_the_linear_spread(spark, data, monkeypatch):
    _, _, train, test = data
    em = vector.VectorEmulator(output_reducer=vector.LinearReducer(3), cfg=sgp.GPConfig(max_inducing=60)).fit(train)
    linear = em.predict_all(test, "linear")
    monkeypatch.setattr(vector, "BUDGET", 20_000)                 # many slices of rows and outputs
    draws = em.predict_all(test, "draws", n_draws=4000)
    [a], [b] = arrays(linear.uncertainty, "sd"), arrays(draws.uncertainty, "sd")
    np.testing.assert_allclose(b, a, rtol=0.08)
    [m], [lat] = arrays(linear.original, "mean"), arrays(linear.latent, "mean")
    assert m.shape == (20, 14) and lat.shape == (20, 3) and em.predict_all(test, None).uncertainty is None


def test_samples_follow_the_predictions(spark, data, monkeypatch):
    _, _, train, test = data
    em = vector.VectorEmulator(input_reducer=vector.LinearReducer(3), output_reducer=vector.LinearReducer(2),
                               kernels="own", cfg=sgp.GPConfig(max_inducing=60)).fit(train)
    monkeypatch.setattr(vector, "BUDGET", 3000)
    few = test.limit(4)
    draws = em.sample(few, 3000)
    assert draws.columns == ["id", "draw", "pos", "value"] and draws.count() == 4 * 3000 * 14
    from pyspark.sql import functions as F
    got = {(r["id"], r["pos"]): r for r in draws.groupBy("id", "pos").agg(
        F.avg("value").alias("m"), F.stddev("value").alias("s"), F.countDistinct("value").alias("n")).collect()}
    for r in em.predict(few).collect():
        for j in range(14):
            g = got[r["id"], j]
            assert abs(g["m"] - r["mean"][j]) < 5 * r["sd"][j] / np.sqrt(3000) and g["n"] == 3000
            assert g["s"] == pytest.approx(r["sd"][j], rel=0.08)
    again, once = (np.array(sorted(map(tuple, em.sample(d, 5).collect()))) for d in (few.repartition(7), few))
    np.testing.assert_allclose(again, once, rtol=1e-8)


@pytest.mark.parametrize("inputs,outputs", [
    (vector.KernelReducer(3, m=64), vector.KernelReducer(4, m=90, alpha=1e-6)),
    (None, [vector.LinearReducer(6), vector.KernelReducer(4, m=90, alpha=1e-6)]),
    (vector.LinearReducer(0.99), None)])
def test_any_reducers(spark, data, inputs, outputs):
    _, _, train, test = data
    em = vector.VectorEmulator(inputs, outputs, cfg=sgp.GPConfig(max_inducing=90)).fit(train)
    mean, sd = arrays(em.predict(test), "mean", "sd")
    assert mean.shape == (20, 14) and np.isfinite(mean).all() and (sd > 0).all()
    assert em.sample(test.limit(2), 3).count() == 2 * 3 * 14
    if not em.outputs.linear:
        with pytest.raises(ValueError):
            em.predict_all(test, "linear")


def test_a_linear_kernel_is_pca(spark, data):
    """Kernel PCA of the linear kernel and its pre-image give what PCA gives, alone and in a chain."""
    _, Y, train, test = data
    cfg = sgp.GPConfig(max_inducing=60)
    kernel = lambda: vector.KernelReducer(2, kernel="linear", m=100, alpha=1e-9)      # noqa: E731
    want, spread = arrays(vector.VectorEmulator(output_reducer=vector.LinearReducer(2), cfg=cfg).fit(train)
                          .predict(test), "mean", "sd")
    for outputs in (kernel(), [vector.LinearReducer(6), kernel()]):
        em = vector.VectorEmulator(output_reducer=outputs, cfg=cfg).fit(train)
        mean, sd = arrays(em.predict(test), "mean", "sd")
        np.testing.assert_allclose(mean, want, atol=0.02 * Y.std())
        np.testing.assert_allclose(sd, spread, rtol=0.6)


def test_rank_above_what_the_outputs_give_is_padded(spark, data):
    _, _, train, test = data
    em = vector.VectorEmulator(output_reducer=vector.LinearReducer(2), kernels="own", rank=5,
                               cfg=sgp.GPConfig(max_inducing=40)).fit(train)
    plain = vector.VectorEmulator(output_reducer=vector.LinearReducer(2), kernels="own",
                                  cfg=sgp.GPConfig(max_inducing=40)).fit(train)
    assert em.padding.shape == (3, 14) and np.abs(em.padding).max() < 0.5
    a, b = arrays(em.predict(test), "mean", "sd"), arrays(plain.predict(test), "mean", "sd")
    np.testing.assert_allclose(a[0], b[0])
    np.testing.assert_allclose(a[1] ** 2, b[1] ** 2 + (em.padding ** 2).sum(0) * em.yscaler.scale ** 2)
    lmc = vector.lmc_emulator(train).fit(train)
    assert lmc.mode == "kmeans" and len(lmc.states) + len(lmc.padding) == lmc.rank


def test_checks(spark, data):
    _, _, train, test = data
    with pytest.raises(ValueError):
        vector.VectorEmulator(output_reducer=vector.LinearReducer(2), zero_mean=True)
    with pytest.raises(ValueError, match="input dimensions"):
        vector.VectorEmulator(input_reducer=vector.LinearReducer(2), ndim=3).fit(train)
    with pytest.raises(ValueError):
        vector.KernelReducer(0.5)
    with pytest.raises(RuntimeError):
        vector.VectorEmulator().predict_all(test)
