import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL


def test_read_matrix_ordinal_ids(spark):
    d = tempfile.mkdtemp(prefix="surrogata-mat-")
    X = np.arange(3000 * 4, dtype=float).reshape(3000, 4)
    np.savetxt(os.path.join(d, "m.csv"), X, delimiter=",", fmt="%.1f")
    from surrogata.sources.matrix import read_matrix, assemble
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")   # many splits
    try:
        df = read_matrix(spark, os.path.join(d, "m.csv"))
        rows = sorted(df.collect(), key=lambda r: r.id)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.id for r in rows] == list(range(3000))
    assert np.allclose(np.array([r.x for r in rows]), X)
    both = assemble([df, df]).collect()
    assert len(both[0].x) == 8


def test_store_roundtrip_and_documents(spark):
    from surrogata.plans.jobs import prepare, evaluate, metrics_document, compare
    from surrogata.sources import store
    from surrogata.sources.tables import embedding_design
    from surrogata.operators import emulators
    root = tempfile.mkdtemp(prefix="surrogata-store-")
    prep = prepare(embedding_design(spark, SF_SMALL))
    store.write_store(prep, spark, f"{root}/store")
    back = store.read_store(spark, f"{root}/store")
    assert back.n_train == prep.n_train and back.n_test == prep.n_test
    pred, row = evaluate(emulators.make("rgasp"), back)
    doc = metrics_document(pred, row)
    store.write_metrics(doc, f"{root}/m1")
    store.write_metrics(doc.withColumn("rmse", F.lit(9.0)), f"{root}/m2")
    res = store.read_metrics(spark, [f"{root}/m1", f"{root}/m2"])
    table = compare(res)
    r = table.first()
    assert table.count() == 1 and r.rmse == 9.0           # last document wins
    store.write_comparison(table, f"{root}/cmp")
    assert store.read_comparison(spark, f"{root}/cmp").first().model == "rgasp"
    with pytest.raises(ValueError):
        store.read_metrics(spark, [])


def test_catalog_dispatch(spark):
    from surrogata.sources import catalog
    df = catalog.load(spark, "synthetic_100d_function")
    assert df.count() == 500
    with pytest.raises(ValueError):
        catalog.load(spark, "nope")


def test_kpca_linear_matches_pca(spark):
    from surrogata.operators import kpca, pca
    rng = np.random.default_rng(1)
    X = rng.normal(size=(60, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(60)], "id long, x array<double>")
    km = kpca.fit_kpca(df, "x", 2, kernel="linear", m=60)
    pm = pca.fit_pca(df, "x", 2)
    a = km.transform_np(X)
    b = pm.transform_np(X)
    for k in range(2):
        assert abs(abs(np.corrcoef(a[:, k], b[:, k])[0, 1]) - 1) < 1e-8
    z = kpca.transform(df, km, "x", "z", keep=["id"])
    back = kpca.inverse_transform(z, km, "z", "x_hat", keep=["id"]).collect()
    assert len(back) == 60 and len(back[0].x_hat) == 4


def test_mc_reconstruction_matches_linear(spark):
    from surrogata.operators.sampling import mc_reconstruct, predictive_draws
    W = np.array([[1.0, 0.0, 2.0], [0.0, 1.0, 1.0]])
    rows = [(i, [0.1 * i, 1.0], [0.5, 0.2]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, mean array<double>, sd array<double>")
    out = mc_reconstruct(df, lambda L: L @ W, n_draws=4000).collect()
    lin = np.sqrt(np.array([0.25, 0.04]) @ (W ** 2))
    sds = np.array([r.sd for r in out])
    assert np.allclose(sds.mean(0), lin, rtol=0.05)
    long = spark.createDataFrame([(1, 0, 2.0, 0.5)], "id long, task int, mean double, sd double")
    d = predictive_draws(long, 2000).agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    assert abs(d.m - 2.0) < 0.05 and abs(d.s - 0.5) < 0.05


def test_stream_scoring(spark):
    from surrogata.operators import emulators
    from surrogata.plans.jobs import prepare
    from surrogata.sources.tables import embedding_design
    from surrogata.streaming.scoring import start_scoring
    prep = prepare(embedding_design(spark, SF_SMALL))
    em = emulators.make("rgasp").fit(prep.train)
    base = tempfile.mkdtemp(prefix="surrogata-stream-")
    prep.test.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(prep.test.schema).parquet(f"{base}/in")
    q = start_scoring(stream, em, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{base}/out").count() == prep.n_test
