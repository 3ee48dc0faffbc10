"""A task's memory follows blocks of rows, not the Arrow batches or partitions that it is given."""

import tracemalloc

import numpy as np
import pyarrow as pa

from surrogata.operators import featuremap as fm
from surrogata.operators import latent, sgp
from surrogata.operators.arrowutil import matrix_to_list
from surrogata.operators.sgp import GPState

ROWS = 10_000


class OneTask:
    """Stands for a table of one batch; the task's function runs here."""

    def __init__(self, batch):
        self.batch = batch

    def select(self, *columns):
        return self

    def mapInArrow(self, fn, schema):
        tracemalloc.start()
        out = list(fn(iter([self.batch])))
        self.peak = tracemalloc.get_traced_memory()[1] / 1e6
        tracemalloc.stop()
        return out


def test_statistics_pass_holds_a_block_of_features(monkeypatch):
    draw = np.random.default_rng(1)
    X, y, Z = draw.standard_normal((ROWS, 3)), draw.standard_normal(ROWS), draw.standard_normal((64, 3))
    task = OneTask(pa.RecordBatch.from_arrays([matrix_to_list(X), pa.array(y)], ["x", "y"]))
    monkeypatch.setattr(sgp, "num_partitions", lambda df: 1)
    monkeypatch.setattr(sgp, "reduce_partials", lambda parts, n: {
        k: np.array(v) for rb in parts for k, v in zip(rb.column(0).to_pylist(), rb.column(2).to_pylist())})
    scales = [np.ones(3), np.full(3, 2.0)]
    white = [sgp._whitener(sgp.get_kernel("matern_5_2")(Z, Z, ls)) for ls in scales]
    st = sgp._stats_pass(task, "x", "y", Z, scales, white, "matern_5_2")
    assert task.peak < 10
    for c, ls in enumerate(scales):
        features = sgp.get_kernel("matern_5_2")(X, Z, ls) @ white[c].T
        np.testing.assert_allclose(st[f"phi{c}"].reshape(64, 64), features.T @ features, rtol=1e-8, atol=1e-6)
        np.testing.assert_allclose(st[f"b{c}"], features.T @ y, rtol=1e-8, atol=1e-6)
        np.testing.assert_allclose(st[f"k{c}"], features.sum(axis=0), rtol=1e-8, atol=1e-6)
    assert st["n"][0] == ROWS


def test_gradients_hold_a_block_of_activations():
    draw = np.random.default_rng(2)
    params = fm.init_params([8, 200, 100, 50, 2, 1], 0)
    X, Y = draw.standard_normal((ROWS, 8)), draw.standard_normal((ROWS, 1))
    tracemalloc.start()
    grads, sse = fm.gradients(params, X, Y)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 20
    whole, error = fm.gradients(params, X[:300], Y[:300])
    parts = [fm.gradients(params, X[i:i + 100], Y[i:i + 100]) for i in (0, 100, 200)]
    for k, g in enumerate(whole):
        np.testing.assert_allclose(g, sum(p[0][k] for p in parts), rtol=1e-9, atol=1e-9)
    assert abs(error - sum(s for _, s in parts)) < 1e-8 * error
    assert abs(sse - float(((fm.forward(params, X) - Y) ** 2).sum())) < 1e-8 * sse


def test_encoder_makes_mean_and_logvar_in_one_pass(spark):
    from surrogata.operators.encoder import Network, layer_rows, layer_table
    draw = np.random.default_rng(3)
    W = [draw.standard_normal(s) for s in ((4, 3), (2, 4), (2, 4))]
    net = Network(layer_table(spark, [
        *layer_rows("encoder", [("linear", W[0], np.zeros(4)), ("relu",)]),
        *layer_rows("mean", [("linear", W[1], np.ones(2))]), *layer_rows("logvar", [("linear", W[2], np.zeros(2))]),
        *layer_rows("decoder", [("linear", draw.standard_normal((3, 2)), np.zeros(3))])]))
    X = draw.standard_normal((20, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(X)], "id long, x array<double>")
    out = net.encode(df)
    assert out.columns == ["id", "x", "mean", "logvar", "z"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    hidden = np.maximum(X @ W[0].T, 0.0)
    rows = sorted(out.collect(), key=lambda r: r["id"])
    np.testing.assert_allclose([r["mean"] for r in rows], hidden @ W[1].T + 1.0)
    np.testing.assert_allclose([r["logvar"] for r in rows], hidden @ W[2].T)


def test_predictions_in_blocks_are_those_of_all_rows(spark, monkeypatch):
    draw = np.random.default_rng(4)
    X, Z = draw.standard_normal((50, 2)), draw.standard_normal((5, 2))
    G, a, beta = draw.standard_normal((5, 5)) * 0.1, np.arange(1.0, 6.0), draw.standard_normal((5, 1))
    state = GPState("matern_5_2", Z, np.ones(2), G, a, beta, np.array([1.5]), np.array([0.1]), np.array([2.0]), 50,
                    0.0, 1.0)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(X)], "id long, x array<double>").coalesce(1)
    whole = {r["id"]: r for r in sgp.predict(df, state).collect()}
    W, U = state.weights()
    Q = sgp.get_kernel("matern_5_2")(X, Z, np.ones(2)) @ G.T
    for i in range(50):
        assert abs(whole[i]["mean"] - (2.0 + Q[i] @ W)[0]) < 1e-10
    monkeypatch.setattr(sgp, "STATS_ROWS", 7)
    for made in (sgp.predict(df, state).collect(), latent.predict_each(df, [state]).collect()):
        for r in made:
            mean = r["mean"] if isinstance(r["mean"], float) else r["mean"][0]
            assert abs(mean - whole[r["id"]]["mean"]) < 1e-10
