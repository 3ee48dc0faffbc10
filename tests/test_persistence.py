"""Fitted stages give the same results after a reload, alone, in a pipeline and in a new session."""

import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel

from surrogata.operators import mlapi, pca, state


@pytest.fixture(scope="module")
def frame(spark):
    draw = np.random.default_rng(31)
    X = draw.standard_normal((120, 5)) * [5, 3, 1, 1, 0.2]
    return spark.createDataFrame([(i, x.tolist(), float(np.sin(x[0] / 5) + x[1])) for i, x in enumerate(X)],
                                 "id long, x array<double>, y double").cache()


def column(df, name):
    return np.array([r[name] for r in sorted(df.collect(), key=lambda r: r["id"])])


@pytest.mark.parametrize("stage,out", [
    (mlapi.SurrogateScaler("x", "z"), "z"), (mlapi.SurrogatePCA("x", "z", 0.95), "z"),
    (mlapi.SurrogatePCA("x", "z", 2), "z"), (mlapi.SurrogateKernelPCA("x", "z", 3, "rbf", 40), "z"),
    (mlapi.SurrogateGP("x", "y", maxInducing=30), "mean")])
def test_a_reloaded_model_gives_the_same(spark, frame, tmp_path, stage, out):
    stage.write().save(f"{tmp_path}/stage")
    again = type(stage).load(f"{tmp_path}/stage")
    assert again.uid == stage.uid and again.extractParamMap() == stage.extractParamMap()
    model = stage.fit(frame)
    model.write().overwrite().save(f"{tmp_path}/model")
    loaded = type(model).load(f"{tmp_path}/model")
    assert loaded.uid == model.uid
    np.testing.assert_array_equal(column(loaded.transform(frame), out), column(model.transform(frame), out))
    if out == "z":
        back = [column(m.inverse_transform(m.transform(frame)), "x_hat") for m in (loaded, model)]
        np.testing.assert_array_equal(*back)


def test_saved_pipeline_in_a_new_session(spark, frame, tmp_path):
    pipe = Pipeline(stages=[mlapi.SurrogateScaler("x", "s"), mlapi.SurrogatePCA("s", "z", 4),
                            mlapi.SurrogateGP("z", "y", maxInducing=40)])
    model = pipe.fit(frame)
    model.write().save(f"{tmp_path}/pipe")
    frame.write.parquet(f"{tmp_path}/rows")
    want = model.transform(frame)
    np.testing.assert_array_equal(column(PipelineModel.load(f"{tmp_path}/pipe").transform(frame), "mean"),
                                  column(want, "mean"))
    code = (f"import sys; sys.path.insert(0, {os.getcwd()!r})\n"
            "from surrogata.session import get_spark\n"
            "from pyspark.ml import PipelineModel\n"
            "spark = get_spark('local[2]', shuffle_partitions=2)\n"
            f"m = PipelineModel.load('{tmp_path}/pipe')\n"
            f"m.transform(spark.read.parquet('{tmp_path}/rows')).select('id', 'mean', 'sd')"
            f".write.parquet('{tmp_path}/out')\n")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_ENV"))}
    subprocess.run([sys.executable, "-c", code.replace(repr(os.getcwd()), repr(root))], check=True, timeout=300,
                   env=env | {"PYSPARK_SUBMIT_ARGS": "--conf spark.ui.enabled=false pyspark-shell"},
                   capture_output=True)
    got = spark.read.parquet(f"{tmp_path}/out")
    np.testing.assert_allclose(column(got, "mean"), column(want, "mean"), rtol=1e-8)
    np.testing.assert_allclose(column(got, "sd"), column(want, "sd"), rtol=1e-8)


def test_state_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "PART", 7)
    model = pca.PCAModel(np.arange(5.0), np.arange(20.0).reshape(4, 5), np.ones(4), np.full(4, 0.25), 0.9, 17)
    state.save_state(spark, model, f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").where("size(vals) > 7").count() == 0
    back = state.load_state(spark, f"{tmp_path}/m", pca.PCAModel)
    assert back.n_samples == 17 and back.share == 0.9 and (back.components == model.components).all()
    with pytest.raises(TypeError):
        state.state_table(spark, {"a": 1})
    with pytest.raises(ValueError):
        mlapi.SurrogatePCAModel().write().save(f"{tmp_path}/none")
