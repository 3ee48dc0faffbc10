"""Encoders and decoders with hand weights against closed forms."""

import math

import numpy as np
import pytest

from surrogata.operators import encoder


def column(df, name):
    return np.array([r[name] for r in sorted(df.collect(), key=lambda r: r["id"])])


@pytest.fixture(scope="module")
def rows(spark):
    X = np.array([[1.0, -2.0, 0.5], [0.0, 0.0, 0.0], [3.0, 1.0, -1.0]])
    return X, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>")


def test_auto_encoder(spark, rows):
    X, df = rows
    W, b = np.array([[1.0, 0.0, 2.0], [0.0, -1.0, 1.0]]), np.array([0.5, 0.0])
    V, c = np.array([[1.0, 1.0]]), np.array([0.25])
    layers = encoder.layer_rows("encoder", [("linear", W, b), ("relu",), ("linear", V, c)])
    layers += encoder.layer_rows("decoder", [("linear", V.T, [0.0, 1.0]), ("relu",), ("linear", W.T, [0.0, 0.0, 0.0])])
    net = encoder.Network(encoder.layer_table(spark, layers[::-1]))
    z = net.encode(df)
    want = np.maximum(X @ W.T + b, 0) @ V.T + c
    np.testing.assert_allclose(column(z, "z"), want)
    assert column(z, "z")[0, 0] == 0.25 + 2.5 + 2.5              # by hand: relu(1 + 1 + .5), relu(2 + .5)
    np.testing.assert_allclose(column(net.decode(z), "x_hat"), np.maximum(want @ V + [0, 1], 0) @ W)


def test_variational_encoder(spark, rows):
    X, df = rows
    gain, shift = np.array([1.0, 2.0, 0.5]), np.array([0.0, 0.1, -0.1])
    M, L = np.array([[1.0, -1.0, 0.5], [0.3, 0.2, 0.1]]), np.array([[0.2, 0.0, 0.0], [0.0, -0.4, 0.0]])
    layers = encoder.layer_rows("encoder", [("norm", gain, shift), ("gelu",)])
    layers += encoder.layer_rows("mean", [("linear", M, [0.0, 1.0])]) + encoder.layer_rows("logvar", [("linear", L, [0.0, 0.0])])
    net = encoder.Network(encoder.layer_table(spark, layers))
    normal = (X - X.mean(1, keepdims=True)) / np.sqrt(X.var(1, keepdims=True) + 1e-5) * gain + shift
    hidden = np.array([[0.5 * v * (1 + math.erf(v / math.sqrt(2))) for v in r] for r in normal])
    out = net.encode(df)
    mean, logvar, z = (column(out, c) for c in ("mean", "logvar", "z"))
    np.testing.assert_allclose(mean, hidden @ M.T + [0.0, 1.0], rtol=1e-12)
    np.testing.assert_allclose(logvar, hidden @ L.T, rtol=1e-12, atol=1e-15)
    noise = (z - mean) / np.exp(logvar / 2)
    assert len(np.unique(noise.round(9))) == 6 and np.abs(noise).max() < 5
    np.testing.assert_allclose(column(net.encode(df.repartition(3)), "z"), z)
    many = spark.range(4000).selectExpr("id", "array(1D, 2D, 4D) as x")
    out = net.encode(many)
    spread = (column(out, "z") - column(out, "mean")) / np.exp(column(out, "logvar") / 2)
    assert abs(spread.mean()) < 0.05 and abs(spread.std() - 1) < 0.05
    assert "Exchange" not in net.encode(many)._jdf.queryExecution().executedPlan().toString()


def test_checks(spark):
    lin = encoder.layer_rows("encoder", [("linear", np.ones((4, 3)), np.zeros(4)), ("linear", np.ones((2, 3)), np.zeros(2))])
    with pytest.raises(ValueError, match="does not fit"):
        encoder.Network(encoder.layer_table(spark, lin))
    with pytest.raises(ValueError, match="bytes of weights"):
        encoder.Network(encoder.layer_table(spark, lin[:1]), limit=100)
    with pytest.raises(ValueError, match="no such layer"):
        encoder.Network(encoder.layer_table(spark, [("encoder", 0, "softmax", None, None, None, None)]))
    with pytest.raises(ValueError, match="variational"):
        encoder.Network(encoder.layer_table(spark, encoder.layer_rows("mean", [("linear", np.ones((1, 1)), [0.0])])))
