"""The long-form result store, models side by side, and the chart series."""

import pytest
from pyspark.sql import functions as F

from surrogata.functions.synthetic import generate
from surrogata.operators import emulators
from surrogata.plans import jobs
from surrogata.sources import store


def predictions(spark, shift, n=50):
    d = spark.range(n).select("id", (F.col("id") * 1.0).alias("y"))
    return d.select("id", "y", *[(F.col("y") + shift + k).alias(c) for k, c in
                                 enumerate(("mean", "sd", "lower", "upper"))])


def row(name, rmse):
    return {"name": name, "rmse": rmse, "train_time": 1.0, "infer_time": 2.0, "mode": "all"}


def test_last_write_of_a_model_wins(spark, tmp_path):
    root = str(tmp_path)
    store.write_results(predictions(spark, 1.0), row("a", 1.0), root)
    store.write_results(predictions(spark, 2.0, 30), row("b", 2.0), root)
    store.write_results(predictions(spark, 3.0, 20), row("a", 3.0), root)
    pred, metrics = store.read_results(spark, root)
    assert {tuple(r) for r in pred.groupBy("model").agg(F.count("*"), F.min("mean")).collect()} == {("a", 20, 3.0), ("b", 30, 2.0)}
    assert {(r["model"], r["rmse"]) for r in metrics.collect()} == {("a", 3.0), ("b", 2.0)}
    vector = predictions(spark, 0.0, 4).select("id", *[F.array(c, c).alias(c) for c in ("y", "mean", "sd", "lower", "upper")])
    store.write_results(vector, row("v", 0.5), root)
    assert store.read_results(spark, root, ["v"])[0].groupBy("task").count().orderBy("task").collect() == [(0, 4), (1, 4)]


def test_reads_are_pruned(spark, tmp_path):
    for name in "abc":
        store.write_results(predictions(spark, 1.0), row(name, 1.0), str(tmp_path))
    one, _ = store.read_results(spark, str(tmp_path), ["b"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan or "PartitionFilters: [(model" in plan
    assert one.select(F.input_file_name().alias("f")).distinct().where("f not like '%model=b%'").count() == 0


def test_models_side_by_side_equal_one_after_another(spark):
    prep = jobs.prepare(generate(spark, 120, 42))
    prep.train.cache().count()
    make = lambda: [emulators.sparse_gp(m=m, multipliers=(1.0, 4.0), refine_rounds=0) for m in (20, 40, 60)]
    side = jobs.evaluate_all(make(), prep, 3)
    once = [jobs.evaluate(e, prep) for e in make()]
    assert [r["rmse"] for _, r in side] == pytest.approx([r["rmse"] for _, r in once], rel=1e-9)
    assert [len(p.columns) for p, _ in side] == [len(p.columns) for p, _ in once]
    broken = make()
    broken[1].cfg.kernel = "none"
    with pytest.raises(ValueError, match="kernel"):
        jobs.evaluate_all(broken, prep, 2)


def test_chart_series(spark):
    table = spark.createDataFrame([("a", 3.0, 1.0, 0.5), ("b", 2.0, 5.0, 0.5), ("c", 2.5, 6.0, 0.1)],
                                  "model string, rmse double, train_time double, infer_time double")
    got = {r["model"]: (r["time"], r["frontier"]) for r in jobs.rmse_against_time(table).collect()}
    assert got == {"a": (1.5, True), "b": (5.5, True), "c": (6.1, False)}
    spectrum = spark.createDataFrame([(1, 6.0), (2, 3.0), (3, 1.0)], "k int, variance double")
    out = [(r["k"], round(r["cum_ratio"], 6), r["above"]) for r in jobs.cumulative_variance(spectrum, 0.85).orderBy("k").collect()]
    assert out == [(1, 0.6, False), (2, 0.9, True), (3, 1.0, True)]
