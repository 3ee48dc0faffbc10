"""PCA of wide inputs: the same count, components and scores as through the d x d matrix."""

import numpy as np
import pytest

from surrogata.operators import pca, pca_wide


def frame(spark, X, parts=5):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(X)], "id long, x array<double>") \
        .repartition(parts)


def mixed(n, d, rank, noise, seed, uneven=True):
    draw = np.random.default_rng(seed)
    X = draw.standard_normal((n, rank)) * 0.7 ** np.arange(rank) @ draw.standard_normal((rank, d))
    X += noise * draw.standard_normal((n, d)) + draw.uniform(-5, 5, d)
    return X * draw.uniform(0.1, 8, d) if uneven else X


def compare(spark, X, n_components, monkeypatch, dual):
    df = frame(spark, X)
    narrow = pca.fit_pca(df, "x", n_components)
    monkeypatch.setattr(pca, "GRAM_LIMIT", 10)
    monkeypatch.setattr(pca_wide, "DUAL_LIMIT", 10_000 if dual else 5)
    monkeypatch.setattr(pca_wide, "SLICE", 32)
    monkeypatch.setattr(pca_wide, "BLOCK", 8)
    wide = pca.fit_pca(df, "x", n_components)
    assert wide.k == narrow.k and wide.n_samples == len(X)
    np.testing.assert_allclose(wide.mean, narrow.mean, atol=1e-9)
    np.testing.assert_allclose(wide.explained_variance, narrow.explained_variance, rtol=1e-5)
    np.testing.assert_allclose(wide.explained_variance_ratio, narrow.explained_variance_ratio, rtol=1e-5)
    assert wide.share == pytest.approx(narrow.share, rel=1e-5)
    scale = np.abs(narrow.transform_np(X)).max()
    np.testing.assert_allclose(wide.transform_np(X), narrow.transform_np(X), atol=2e-3 * scale)
    np.testing.assert_allclose(wide.components @ wide.components.T, np.eye(wide.k), atol=1e-8)


@pytest.mark.parametrize("n_components", [3, 0.9, 0.99])
@pytest.mark.parametrize("dual", [True, False])
def test_same_as_the_gram_way(spark, monkeypatch, n_components, dual):
    compare(spark, mixed(150, 90, 6, 0.02, 1), n_components, monkeypatch, dual)


@pytest.mark.parametrize("dual", [True, False])
def test_fewer_rows_than_inputs(spark, monkeypatch, dual):
    compare(spark, mixed(40, 120, 5, 0.05, 2), 0.95, monkeypatch, dual)


@pytest.mark.parametrize("dual", [True, False])
def test_standardised_input_uses_one_basis(spark, monkeypatch, dual):
    X = mixed(200, 60, 4, 0.1, 3, uneven=False)
    compare(spark, (X - X.mean(0)) / X.std(0), 0.9, monkeypatch, dual)


def test_slow_spectrum_grows_the_basis(spark, monkeypatch):
    """Many equal directions: the basis has to grow several times, and the count stays right."""
    draw = np.random.default_rng(4)
    X = draw.standard_normal((300, 40)) * np.linspace(3, 1, 40)
    df = frame(spark, X)
    want = pca.fit_pca(df, "x", 0.8).k
    monkeypatch.setattr(pca, "GRAM_LIMIT", 10)
    monkeypatch.setattr(pca_wide, "DUAL_LIMIT", 5)
    monkeypatch.setattr(pca_wide, "BLOCK", 8)
    assert want > 16 and pca.fit_pca(df, "x", 0.8).k == want


def test_repeated_rows_constant_columns_and_mle(spark, monkeypatch):
    X = mixed(30, 50, 3, 0.01, 5)
    X[:, 7] = 2.5
    X = np.vstack([X, X[:10], X[:10]])
    compare(spark, X, 2, monkeypatch, True)
    tall = mixed(120, 30, 3, 0.05, 6)
    df = frame(spark, tall)
    monkeypatch.undo()
    want = pca.fit_pca(df, "x", "mle").k
    monkeypatch.setattr(pca, "GRAM_LIMIT", 10)
    assert pca.fit_pca(df, "x", "mle").k == want
    monkeypatch.setattr(pca_wide, "DUAL_LIMIT", 5)
    with pytest.raises(ValueError):
        pca.fit_pca(df, "x", "mle")


def test_checks_hold_for_wide_inputs(spark, monkeypatch):
    monkeypatch.setattr(pca, "GRAM_LIMIT", 10)
    df = frame(spark, np.random.default_rng(7).standard_normal((12, 20)))
    for bad in (0, 1.0, "all", 13):
        with pytest.raises(ValueError):
            pca.fit_pca(df, "x", bad)
    with pytest.raises(TypeError):
        pca.fit_pca(df, "x", None)
    with pytest.raises(ValueError):
        pca_wide.column_moments(df.limit(0), "x")


def test_r_factor_of_a_tall_matrix(spark):
    X = np.random.default_rng(8).standard_normal((500, 12))
    space = pca_wide.RowSpace(frame(spark, X, 9), "x", X.mean(0), np.ones(12))
    basis = np.linalg.qr(np.random.default_rng(9).standard_normal((12, 5)))[0]
    z, r = space.times(basis)
    Y = (X - X.mean(0)) @ basis
    np.testing.assert_allclose(np.abs(r), np.abs(np.linalg.qr(Y, mode="r")), atol=1e-9)
    np.testing.assert_allclose(z, (X - X.mean(0)).T @ Y, atol=1e-8)


def test_rows_of_a_large_wide_input_are_not_kept(spark, monkeypatch):
    X = mixed(60, 40, 6, 0.1, 3)
    seen = []
    whole = pca_wide.fit_range
    monkeypatch.setattr(pca, "GRAM_LIMIT", 10)
    monkeypatch.setattr(pca_wide, "DUAL_LIMIT", 5)
    monkeypatch.setattr(pca_wide, "BLOCK", 8)
    monkeypatch.setattr(pca_wide, "fit_range", lambda df, *a: seen.append(df.storageLevel) or whole(df, *a))
    pca.fit_pca(frame(spark, X, 2), "x", 3)
    assert len(seen) == 1 and not seen[0].useDisk and not seen[0].useMemory


def test_moments_keep_their_digits_beside_a_large_mean(spark):
    X = np.random.default_rng(5).standard_normal((50, 6)) * [1, 1e-3, 5, 0, 2, 1] + [1e8, 1e5, 0, 0.1, -3e7, 4]
    n, mean, sd = pca_wide.column_moments(frame(spark, X), "x")
    assert n == 50 and sd[3] == 0.0
    np.testing.assert_allclose(mean, X.mean(axis=0), rtol=1e-12)
    np.testing.assert_allclose(sd[:3], X.std(axis=0)[:3], rtol=1e-6)


def test_wide_design_has_the_rows_of_its_formula(spark, tmp_path):
    from surrogata.sources import tables
    given = [[1.0, 2.0, 3.0], [4.0, None, 6.0], None, [7.0, 8.0]]
    spark.createDataFrame(list(enumerate(given)), "vec_id int, embedding array<float>") \
        .write.parquet(str(tmp_path / "embeddings.parquet"))
    made = {r["id"]: r["x"] for r in tables.wide_design(spark, str(tmp_path), 7).collect()}
    w = 1.0 + np.cos(np.arange(7.0)) / 2.0
    assert sorted(made) == [0, 1, 2, 3]
    for i, v in enumerate(given):
        own = [None] * 7 if v is None else [v[j % len(v)] for j in range(7)]
        assert [a is None for a in made[i]] == [a is None for a in own]
        np.testing.assert_allclose([a for a in made[i] if a is not None],
                                   [a * b for a, b in zip(own, w) if a is not None], rtol=1e-15)


def test_blocks_of_rows():
    import pyarrow as pa
    from surrogata.operators.arrowutil import matrix_blocks
    col = pa.array([[float(i), 1.0, 2.0] for i in range(10)])
    sizes = [len(b) for b in matrix_blocks(col.slice(1), 9)]
    assert sizes == [3, 3, 3]
    assert [b[0, 0] for b in matrix_blocks(col.slice(1), 9)] == [1.0, 4.0, 7.0]
