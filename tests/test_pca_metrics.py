import numpy as np
import pytest
from pyspark.sql import functions as F

from surrogata.operators import metrics, pca


@pytest.fixture(scope="module")
def mat():
    rng = np.random.default_rng(3)
    return rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6))


def _df(spark, X, parts=3):
    return spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))],
                                 "id long, x array<double>").repartition(parts)


def test_pca_matches_numpy(spark, mat):
    m = pca.fit_pca(_df(spark, mat), "x", 3)
    C = np.cov(mat, rowvar=False)
    w, V = np.linalg.eigh(C)
    order = np.argsort(w)[::-1]
    assert np.allclose(m.explained_variance, w[order][:3])
    for k in range(3):
        v = V[:, order[k]]
        assert abs(abs(v @ m.components[k]) - 1.0) < 1e-8
        assert m.components[k][np.argmax(np.abs(m.components[k]))] > 0


def test_pca_roundtrip_full_rank(spark, mat):
    df = _df(spark, mat)
    m = pca.fit_pca(df, "x", 6)
    z = pca.transform(df, m, "x", "z", keep=["id"])
    back = pca.inverse_transform(z, m, "z", "x_hat", keep=["id"]).collect()
    got = np.array([r.x_hat for r in sorted(back, key=lambda r: r.id)])
    assert np.allclose(got, mat, atol=1e-8)


def test_component_count_rule():
    r = np.array([0.5, 0.25, 0.125, 0.125])                   # exact binary fractions
    assert pca.count_for_share(r, 0.875) == 4                  # strictly above
    assert pca.count_for_share(r, 0.8) == 3
    assert pca.count_for_share(np.array([0.2, 0.2]), 0.999) == 1             # none above -> 1


def test_n_components_validation():
    for bad in (0, -1, 1.0, 0.0, "auto"):
        with pytest.raises((ValueError, TypeError)):
            pca.check_n_components(bad)
    with pytest.raises(TypeError):
        pca.check_n_components(None)


def test_randomized_pca_close_to_exact(spark, mat):
    df = _df(spark, mat)
    exact = pca.fit_pca(df, "x", 2)
    approx = pca.randomized_pca(df, 2, "x", oversample=4, power_iters=3)
    assert np.allclose(approx.explained_variance, exact.explained_variance, rtol=1e-6)


def test_metrics_hand_computed(spark):
    rows = [("m", 0, 1, 1.0, 1.5, 0.5, 0.0, 2.0), ("m", 0, 2, 2.0, 2.0, 0.5, 1.5, 2.5),
            ("m", 1, 1, 3.0, 2.0, 0.5, 3.5, 4.0), ("m", 1, 2, 5.0, 5.0, 0.5, 4.0, 6.0)]
    df = spark.createDataFrame(rows, "model string, task int, id int, y double, mean double, sd double, lower double, upper double")
    r = metrics.scores(df, ["model"]).first()
    rmse0 = np.sqrt((0.25 + 0) / 2)
    rmse1 = np.sqrt((1 + 0) / 2)
    assert abs(r.rmse - (rmse0 + rmse1) / 2) < 1e-12
    assert abs(r.coverage - 0.75) < 1e-12 and abs(r.qce - 0.2) < 1e-12
    assert abs(r.nrmse - np.sqrt(1.25 / 4) / (11 / 4)) < 1e-12
    r2_0 = 1 - 0.25 / 0.5
    r2_1 = 1 - 1.0 / 2.0
    assert abs(r.r2 - (r2_0 + r2_1) / 2) < 1e-12


def test_val1_mismatched_sizes(spark):
    a = spark.createDataFrame([(1,), (2,)], "id int")
    b = spark.createDataFrame([(1,)], "id int")
    with pytest.raises(ValueError):
        metrics.check_equal_size(a, b, ["id"])


def test_msll_without_train(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0, 1.0)], "task int, y double, mean double, sd double")
    v = metrics.msll(df).first().msll
    assert abs(v - 0.5 * np.log(2 * np.pi)) < 1e-12


def test_threshold_validation():
    from surrogata.operators.truncate import check_threshold
    with pytest.raises(TypeError):
        check_threshold("0.5")
    with pytest.raises(ValueError):
        check_threshold(-1)


def test_wide_input_switches_to_randomized(spark, monkeypatch):
    monkeypatch.setattr(pca, "GRAM_LIMIT", 4)          # treat the 6-wide test matrix as wide
    rng = np.random.default_rng(5)
    X = rng.normal(size=(150, 6)) * np.array([5, 3, 1, 0.5, 0.2, 0.1])
    df = _df(spark, X)
    with pytest.raises(ValueError):
        pca.moments(df, "x")
    m = pca.fit_pca(df, "x", 2)
    w = np.sort(np.linalg.eigvalsh(np.cov(X, rowvar=False)))[::-1]
    assert np.allclose(m.explained_variance, w[:2], rtol=1e-6)
    m2 = pca.fit_pca(df, "x", 0.9)
    assert 1 <= m2.k <= 6 and m2.share == 0.9          # as for narrow inputs: the share asked for


def test_mle_component_count(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 3)) @ rng.normal(size=(3, 8)) * 3 + 0.3 * rng.normal(size=(300, 8))
    m = pca.fit_pca(_df(spark, X), "x", "mle")
    assert m.k == 3
