import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def _frame(spark, X, y):
    return spark.createDataFrame([(i, X[i].tolist(), float(y[i])) for i in range(len(X))],
                                 "id long, x array<double>, y double")


def test_linear_trend_recovers_plane(spark):
    from surrogata.operators.trend import fit_linear_trend
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3))
    y = 2.0 + X @ np.array([1.0, -3.0, 0.5])
    beta = fit_linear_trend(_frame(spark, X, y))
    assert np.allclose(beta[:, 0], [2.0, 1.0, -3.0, 0.5], atol=1e-6)


def test_trend_emulator_predicts_plane(spark):
    from surrogata.operators.emulators import rgasp
    rng = np.random.default_rng(1)
    X = rng.normal(size=(120, 2))
    y = 5.0 + 3.0 * X[:, 0] + 0.1 * np.sin(3 * X[:, 1])
    em = rgasp(trend="linear").fit(_frame(spark, X, y))
    Xs = rng.normal(size=(10, 2))
    out = sorted(em.predict(spark.createDataFrame([(i, Xs[i].tolist()) for i in range(10)],
                                                  "id long, x array<double>")).collect(), key=lambda r: r.id)
    want = 5.0 + 3.0 * Xs[:, 0] + 0.1 * np.sin(3 * Xs[:, 1])
    assert np.max(np.abs(np.array([r.mean for r in out]) - want)) < 0.1


def test_validation_rules(spark):
    from surrogata.operators.emulators import PCAOutputGP, PCAInputGP, exact_gp
    from surrogata.operators.metrics import check_prediction_columns
    from surrogata.operators import maps
    with pytest.raises(ValueError):
        PCAOutputGP(zero_mean=True)                                        # VAL-6
    vec = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 2.0])], "id long, x array<double>, y array<double>")
    with pytest.raises(ValueError):
        PCAInputGP().fit(vec)                                              # VAL-5
    with pytest.raises(ValueError):
        check_prediction_columns(vec)                                      # VAL-10
    a = spark.createDataFrame([(0, 0, 1.0)], "sample_id long, pos int, value double")
    b = spark.createDataFrame([(0, 1, 1.0)], "sample_id long, pos int, value double")
    with pytest.raises(ValueError):
        maps.check_same_shape(a, b)                                        # VAL-9
    with pytest.raises(ValueError):
        maps.diff_grid(a, a, "other")
    rng = np.random.default_rng(2)
    X = rng.normal(size=(30, 2))
    em = exact_gp().fit(_frame(spark, X, X[:, 0]))
    wide = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "id long, x array<double>")
    with pytest.raises(Exception):
        em.predict(wide).collect()                                         # VAL-5 width


def test_qoi_units(spark):
    from surrogata.functions.scalar import qoi_unit, check_qoi
    df = spark.createDataFrame([("hmax",), ("vmax",), ("cmax",)], "q string")
    assert [r.u for r in df.select(qoi_unit(F.col("q")).alias("u")).collect()] == ["[m]", "[m/s]", ""]
    with pytest.raises(ValueError):
        check_qoi("zmax")
    with pytest.raises(Exception):
        spark.createDataFrame([("zmax",)], "q string").select(qoi_unit(F.col("q"))).collect()


def test_component_range_and_kmeans_padding(spark):
    from surrogata.operators.stats import component_range
    from surrogata.operators import sgp
    df = spark.createDataFrame([(0, [1.0, -2.0]), (1, [3.0, 5.0])], "id long, z array<double>")
    r = {x.component: (x["min"], x["max"]) for x in component_range(df).collect()}
    assert r == {0: (1.0, 3.0), 1: (-2.0, 5.0)}
    rng = np.random.default_rng(3)
    X = rng.normal(size=(20, 2))
    Z = sgp.choose_inducing(_frame(spark, X, X[:, 0]), "x", 20, sgp.GPConfig(inducing="kmeans", max_inducing=32))
    assert Z.shape == (32, 2)


def test_ml_wrappers_in_pipeline(spark):
    from pyspark.ml import Pipeline
    from surrogata.operators.mlapi import SurrogatePCA, SurrogateGP
    from surrogata.sources.tables import embedding_design
    d = embedding_design(spark, SF_SMALL)
    pipe = Pipeline(stages=[SurrogatePCA("x", "z", 4), SurrogateGP("z", "y", maxInducing=64, inducing="landmarks")])
    model = pipe.fit(d)
    out = model.transform(d)
    assert {"mean", "sd", "lower", "upper"} <= set(out.columns)
    assert out.count() == d.count()
    back = model.stages[0].inverse_transform(model.stages[0].transform(d))
    assert len(back.first().x_hat) == 64


def test_case_study_synthetic(spark):
    from surrogata.plans.jobs import case_study
    t = case_study(spark, "synthetic_100d_function", models=("rgasp",))
    r = t.first()
    assert t.count() == 1 and r.model == "rgasp" and 1.0 < r.rmse < 4.0


def test_chunked_windows_equal_plain(spark):
    from surrogata.operators import windows as W
    from surrogata.sources import tables as tb
    ev = tb.table(spark, SF_SMALL, "events").select(F.col("user_id").alias("run"), "event_id",
                                                    F.col("value").alias("loss"))
    from pyspark.sql import Window
    plain = ev.withColumn("epoch", F.row_number().over(Window.partitionBy("run").orderBy("event_id")).cast("long"))
    buck = W.ordinal_in_run(ev, "run", "event_id", bucket_width=13)
    assert sorted(plain.select("run", "epoch", "loss").collect()) == sorted(buck.select("run", "epoch", "loss").collect())
    h = plain.select("run", "epoch", "loss")
    a = W.running_best(W.patience(W.trailing_slope(h), min_epoch=3, tol=-1e9, limit=10))
    b = W.running_best_chunked(W.patience_chunked(W.trailing_slope_chunked(h, chunk=21), min_epoch=3, tol=-1e9,
                                                  limit=10, chunk=21), chunk=21)
    cols = ["run", "epoch", "slope", "counter", "stop", "best_loss"]
    assert sorted(tuple(r) for r in a.select(*cols).collect()) == sorted(tuple(r) for r in b.select(*cols).collect())


def test_feature_map_gradients_and_training(spark):
    from surrogata.operators import featuremap as fm
    rng = np.random.default_rng(0)
    P = fm.init_params([3, 5, 4, 2, 1], 1)
    X = rng.normal(size=(7, 3))
    Y = rng.normal(size=(7, 1))
    g, s = fm.gradients(P, X, Y)
    for i in range(len(P)):
        Q = [q.copy() for q in P]
        idx = (0,) * P[i].ndim
        Q[i][idx] += 1e-6
        _, s2 = fm.gradients(Q, X, Y)
        assert abs((s2 - s) / 1e-6 - g[i][idx]) < 1e-4
    Xb = rng.normal(size=(100, 3))
    df = _frame(spark, Xb, Xb[:, 0] - Xb[:, 1])
    params, losses = fm.train(df, hidden=(8, 8, 4), latent=2, epochs=30, lr=0.05)
    assert losses[-1] < losses[0] * 0.5


def test_lmc_sizes_from_spectrum(spark):
    from surrogata.operators.emulators import lmc_for
    rng = np.random.default_rng(4)
    X = rng.normal(size=(60, 2))
    Y = np.hstack([X @ rng.normal(size=(2, 6)), 0.01 * rng.normal(size=(60, 6))])
    df = spark.createDataFrame([(i, X[i].tolist(), Y[i].tolist()) for i in range(60)],
                               "id long, x array<double>, y array<double>")
    em = lmc_for(df)
    assert em.n_components >= 1 and em.cfg.inducing == "kmeans"
    em.fit(df)
    assert len(em.predict(df.select("id", "x")).first().mean) == 12


def test_loss_curves_equal_the_plain_windows(spark):
    from surrogata.operators import windows as W
    from surrogata.sources import tables as tb
    h = tb.loss_history(spark, SF_SMALL)
    cols = ["run", "epoch", "slope", "counter", "stop", "best_loss"]
    gapped = h.withColumn("epoch", F.col("epoch") * 2)
    from_zero = h.withColumn("epoch", F.col("epoch") - 1)
    for g in (h, gapped, from_zero):
        plain = W.running_best(W.patience(W.trailing_slope(g, "run", "epoch", "loss"), "run", "epoch"),
                               "run", "epoch", "loss")
        for chunk in (20, 1 << 16):
            got = W.loss_curves(g, chunk=chunk)
            key = lambda d: sorted((r.run, r.epoch, None if r.slope is None else round(r.slope, 9),
                                    r.counter, r.stop, r.best_loss) for r in d.select(*cols).collect())
            assert key(got) == key(plain)


def test_sample_outputs_and_inducing_shape(spark):
    from surrogata.operators.sampling import sample_outputs
    from surrogata.operators import sgp
    W = np.array([[1.0, 2.0, 0.0]])
    df = spark.createDataFrame([(1, [1.0], [0.0]), (2, [2.0], [0.0])], "id long, mean array<double>, sd array<double>")
    out = sample_outputs(df, lambda L: L @ W, n_draws=5)
    rows = out.collect()
    assert len(rows) == 2 * 5 * 3
    assert all(abs(r.value - {0: 1.0, 1: 2.0, 2: 0.0}[r.pos] * (1.0 if r.id == 1 else 2.0)) < 1e-12 for r in rows)
    rng = np.random.default_rng(6)
    X = rng.normal(size=(20, 2))
    with pytest.raises(ValueError):                                            # VAL-11
        sgp.fit(_frame(spark, X, X[:, 0]), Z=np.zeros((5, 3)))


def test_landmarks_are_distinct_whatever_the_copies(spark):
    from surrogata.operators.inducing import distinct_landmarks
    df = spark.range(200_000).select(F.array((F.col("id") % 977).cast("double"),
                                             (F.col("id") % 3).cast("double")).alias("x")).repartition(6)
    a = distinct_landmarks(df, "x", 128)
    assert a.shape == (128, 2) and len({tuple(r) for r in a}) == 128
    assert (distinct_landmarks(df.repartition(3), "x", 128) == a).all()
    assert len(distinct_landmarks(df.where("id % 977 < 5"), "x", 128)) == 15      # all there are


def test_gp_does_not_depend_on_the_unit_of_y(spark):
    from surrogata.operators import sgp
    rng = np.random.default_rng(2)
    X = rng.uniform(-2, 2, size=(300, 2))
    y = np.sin(2 * X[:, 0]) + 0.3 * X[:, 1] + 0.1 * rng.standard_normal(300)
    cfg = sgp.GPConfig(inducing="landmarks", max_inducing=40)
    one, other = sgp.fit(_frame(spark, X, y), cfg=cfg), sgp.fit(_frame(spark, X, 1000 * y), cfg=cfg)
    assert np.allclose(other.sigma2, 1e6 * one.sigma2) and np.allclose(other.s2, 1e6 * one.s2)
    assert np.allclose(other.lengthscale, one.lengthscale) and len(one.Z) == 40 and one.mode == "landmarks"
    assert 0.05 < np.sqrt(one.sigma2[0]) < 0.2
    with pytest.raises(ValueError):
        sgp.fit(_frame(spark, X, y), cfg=sgp.GPConfig(inducing="landmarks", max_inducing=sgp.MAX_INDUCING + 1))


def test_linear_trend_of_vector_outputs(spark):
    from surrogata.operators.emulators import GPEmulator
    rng = np.random.default_rng(4)
    X = rng.uniform(0, 1, size=(60, 2))
    Y = np.stack([1 + 2 * X[:, 0], 5 - X[:, 1]], 1)
    rows = [(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(X, Y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    got = GPEmulator("t", trend="linear").fit(df).predict(df.select("id", "x")).collect()
    assert np.allclose([r["mean"] for r in sorted(got, key=lambda r: r["id"])], Y, atol=1e-3)


def test_text_matrix_with_blank_lines(spark, tmp_path):
    from surrogata.sources.matrix import assemble, read_matrix
    (tmp_path / "a.csv").write_text("1,2\n\n3,4\n5,6\n")
    (tmp_path / "b.csv").write_text("7,8\n\n\n9,10\n")
    m = read_matrix(spark, str(tmp_path))
    assert sorted((r.id, r.x) for r in m.collect()) == [
        (0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [5.0, 6.0]), (3, [7.0, 8.0]), (4, [9.0, 10.0])]
    shifted = m.select((F.col("id") + 1).alias("id"), "x")
    with pytest.raises(ValueError):
        assemble([m, shifted])
    assert assemble([m, m]).count() == 5


def test_evidence_count_against_the_formula(spark):
    from math import lgamma, log, pi
    from surrogata.operators.pca import _mle_count
    rng = np.random.default_rng(1)
    w = np.sort(np.concatenate([rng.uniform(5, 30, 4), rng.uniform(0.9, 1.1, 11)]))[::-1]
    n, d = 200, len(w)

    def evidence(k):
        v = w[k:].mean()
        x = np.where(np.arange(d) < k, w, v)
        pairs = [(i, j) for i in range(k) for j in range(i + 1, d)]
        az = sum(log(n) + log(1 / x[j] - 1 / x[i]) + log(w[i] - w[j]) for i, j in pairs)
        u = -k * log(2) + sum(lgamma((d - i) / 2) - (d - i) / 2 * log(pi) for i in range(k))
        m = d * k - k * (k + 1) / 2
        return (u - n / 2 * np.log(w[:k]).sum() - n * (d - k) / 2 * log(v)
                + (m + k) / 2 * log(2 * pi) - az / 2 - k / 2 * log(n))
    assert _mle_count(w, n) == max(range(1, d), key=evidence)
