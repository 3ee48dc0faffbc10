"""SRC-3/4/5 train/test store and SRC-10/11/12 result documents."""

from __future__ import annotations


from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in
      ("ground_truth", "predictions_mean", "predictions_std", "predictions_lower95", "predictions_upper95")],
    *[T.StructField(c, T.DoubleType()) for c in ("rmse", "train_time", "infer_time")],
])


def write_store(prep, spark: SparkSession, root: str, float32: bool = False) -> None:
    """SRC-4: train, test, scaler and dataset_info tables under one root."""
    cast = (lambda c: F.col(c).cast("array<float>") if float32 else F.col(c))
    prep.train.select("id", cast("x").alias("x"), "y").write.mode("overwrite").parquet(f"{root}/train")
    prep.test.select("id", cast("x").alias("x"), "y").write.mode("overwrite").parquet(f"{root}/test")
    prep.scaler.to_df(spark).write.mode("overwrite").parquet(f"{root}/scaler")
    spark.createDataFrame([(prep.n_train, prep.n_test, prep.n_features)],
                          "n_samples_train long, n_samples_test long, n_features int") \
        .write.mode("overwrite").parquet(f"{root}/dataset_info")


def read_store(spark: SparkSession, root: str):
    """SRC-5 + VAL-4: read back and check row and feature counts."""
    from surrogata.operators.scale import Scaler
    from surrogata.plans.jobs import Prepared
    import numpy as np

    train = spark.read.parquet(f"{root}/train")
    test = spark.read.parquet(f"{root}/test")
    info = spark.read.parquet(f"{root}/dataset_info").first()
    sc = sorted(spark.read.parquet(f"{root}/scaler").collect(), key=lambda r: r["pos"])
    n_tr, n_te = train.count(), test.count()
    if n_tr != info["n_samples_train"] or n_te != info["n_samples_test"]:
        raise ValueError("train/test row counts do not match the stored attributes")
    for name, df in (("train", train), ("test", test)):
        widths = df.agg(F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi")).first()
        if widths["lo"] != info["n_features"] or widths["hi"] != info["n_features"]:
            raise ValueError(f"{name} feature count differs from n_features={info['n_features']}")
    scaler = Scaler(np.array([r["mean"] for r in sc]), np.array([r["scale"] for r in sc]))
    return Prepared(train, test, scaler, n_tr, n_te, int(info["n_features"]))


def write_metrics(doc: DataFrame, directory: str) -> None:
    """SRC-10: one metrics document (single row) as JSON under ``directory``."""
    doc.coalesce(1).write.mode("overwrite").json(directory)


def read_metrics(spark: SparkSession, paths: list[str]) -> DataFrame:
    """SRC-11 + VAL-7: documents from a non-empty list of directories; ``ordinal`` = list position."""
    if not isinstance(paths, list) or not paths:
        raise ValueError("expected at least one metrics directory, in a list")
    frames = []
    for i, p in enumerate(paths):
        if not isinstance(p, str):
            raise ValueError(f"a metrics directory is a text; entry {i} is a {type(p).__name__}")
        try:
            df = spark.read.schema(METRICS_SCHEMA).option("mode", "FAILFAST").json(p)
        except AnalysisException as e:
            raise FileNotFoundError(f"no metrics can be read for item {i}: {p}") from e
        frames.append(df.withColumn("ordinal", F.lit(i)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    if out.filter(F.col("name").isNull()).limit(1).count():
        raise ValueError("a metrics document is missing the 'name' field")
    return out


RESULT_COLUMNS = ["id", "task", "y", "mean", "sd", "lower", "upper"]


def write_results(pred: DataFrame, row: dict, root: str) -> None:
    """SRC-10 in long form: a row a prediction and task under ``predictions``, one row under
    ``metrics``, both partitioned by model.  Only the model's own partition is overwritten, so the last
    write of a model wins (SET-2) and the others stay; any number of predictions is written by all
    tasks."""
    cols = ["y", "mean", "sd", "lower", "upper"]
    if dict(pred.dtypes)["mean"].startswith("array"):
        long = pred.select("id", F.posexplode(F.arrays_zip(*cols)).alias("task", "v")) \
            .select("id", "task", *[F.col("v")[c].alias(c) for c in cols])
    elif "task" in pred.columns:
        long = pred.select("id", "task", *cols)
    else:
        long = pred.select("id", F.lit(0).alias("task"), *cols)
    metrics = pred.sparkSession.createDataFrame(
        [tuple(row.get(c) for c in ("rmse", "train_time", "infer_time", "mode"))],
        "rmse double, train_time double, infer_time double, mode string")
    for table, name in ((long, "predictions"), (metrics, "metrics")):
        table.withColumn("model", F.lit(row["name"])).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(f"{root}/{name}")


def read_results(spark: SparkSession, root: str, models: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-11 in long form: (predictions, metrics) of the named models, or of all; other models' files
    are not listed for reading."""
    def of(name, schema):
        df = spark.read.schema(schema).parquet(f"{root}/{name}")
        return df if models is None else df.where(F.col("model").isin(*models))

    return (of("predictions", "id long, task int, y double, mean double, sd double, lower double, upper double, "
                              "model string"),
            of("metrics", "rmse double, train_time double, infer_time double, mode string, model string"))


def write_comparison(table: DataFrame, path: str) -> None:
    """SRC-12: CSV with the model name in an unnamed first column."""
    table.select(F.col("model").alias(""), "rmse", "train_time", "infer_time") \
        .coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_comparison(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    first = df.columns[0]
    return df.select(F.col(first).alias("model"),
                     *[F.col(c).cast("double").alias(c) for c in ("rmse", "train_time", "infer_time")])
