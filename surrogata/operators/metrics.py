"""MET-1..MET-7 and VAL-1: error and calibration metrics as aggregations.

Input is the long prediction table ``(model, task, id, y, mean, sd, lower,
upper)`` (JN-2 alignment already done).  Every metric is a one- or two-level
``groupBy``; partial aggregation keeps the shuffle at (partitions x groups).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# sklearn's MAPE epsilon (float64 machine epsilon) and the MSLL
# variance floor.
MAPE_EPS = 2.220446049250313e-16
VAR_FLOOR = 1e-12


def align(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """JN-2 + VAL-1: inner join on keys; raises when either side has unmatched rows."""
    check_equal_size(pred, truth, keys)
    return pred.join(truth, keys, "inner")


PRED_COLUMNS = ("mean", "sd", "lower", "upper")


def check_prediction_columns(df: DataFrame) -> None:
    """VAL-10: every prediction component is present."""
    missing = [c for c in PRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"prediction components missing: {missing}")


def check_equal_size(pred: DataFrame, truth: DataFrame, keys: list[str]) -> None:
    """VAL-1, cheap form: anti-joins both ways must be empty."""
    a = pred.select(*keys).join(truth.select(*keys), keys, "left_anti").limit(1).count()
    b = truth.select(*keys).join(pred.select(*keys), keys, "left_anti").limit(1).count()
    if a or b:
        raise ValueError("some keys have a prediction without a true value, or the reverse")


def per_task(df: DataFrame, by: list[str], y: str = "y", mean: str = "mean",
             lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Per (by..., task) sums that every metric needs, in one aggregation."""
    d = F.col(mean) - F.col(y)
    return df.groupBy(*by, "task").agg(
        F.count(F.col(y)).alias("n"),
        F.sum(d * d).alias("sse"),
        (F.var_pop(F.col(y)) * F.count(F.col(y))).alias("sst"),
        F.sum(F.col(y)).alias("sum_y"),
        F.sum(F.abs(d) / F.greatest(F.abs(F.col(y)), F.lit(MAPE_EPS))).alias("sum_ape"),
        F.sum(F.when((F.col(y) >= F.col(lower)) & (F.col(y) <= F.col(upper)), 1).otherwise(0)).alias("n_in"),
    )


def scores(df: DataFrame, by: list[str] | None = None, nominal: float = 0.95,
           y: str = "y", mean: str = "mean", lower: str = "lower", upper: str = "upper") -> DataFrame:
    """MET-1..MET-6 per group.

    rmse   — mean over tasks of per-task RMSE (uniform average);
    nrmse  — sqrt(MSE over all tasks) / mean of all observations (NULL if 0);
    mape   — 100 * mean |y - mean| / max(|y|, eps);
    r2     — mean over tasks of 1 - SSE/SST (SST = 0: 1 if SSE = 0 else 0);
    coverage, qce — share inside [lower, upper] and |coverage - nominal|.
    """
    by = by or []
    t = per_task(df, by, y, mean, lower, upper)
    r2 = (F.when(F.col("sst") != 0, F.lit(1.0) - F.col("sse") / F.col("sst"))
          .when(F.col("sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    agg = t.groupBy(*by).agg(
        F.avg(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"),
        (F.sum("sse") / F.sum("n")).alias("_mse"),
        (F.sum("sum_y") / F.sum("n")).alias("_ybar"),
        (F.lit(100.0) * F.sum("sum_ape") / F.sum("n")).alias("mape"),
        F.avg(r2).alias("r2"),
        (F.sum("n_in") / F.sum("n")).alias("coverage"),
    )
    return agg.select(
        *by, "rmse",
        F.try_divide(F.sqrt("_mse"), F.col("_ybar")).alias("nrmse"),
        (F.abs(F.col("_ybar")) < F.lit(MAPE_EPS)).alias("mean_near_zero"),
        "mape", "r2", "coverage",
        F.abs(F.col("coverage") - F.lit(float(nominal))).alias("qce"),
    )


def msll(df: DataFrame, train: DataFrame | None = None, by: list[str] | None = None,
         y: str = "y", mean: str = "mean", sd: str = "sd", train_y: str = "y") -> DataFrame:
    """MET-7: mean standardised log loss per (by..., task).

    Model loss ``0.5 ln(2 pi v) + (y - mu)^2 / (2 v)`` with v = max(sd^2, 1e-12);
    minus the loss of a trivial model with the per-task training mean and the
    training variance pooled over all tasks (ddof 1).  Without ``train`` the
    mean log loss is returned.
    """
    by = by or []
    v = F.greatest(F.col(sd) * F.col(sd), F.lit(VAR_FLOOR))
    loss = F.lit(0.5) * F.log(F.lit(2.0 * math.pi) * v) + (F.col(y) - F.col(mean)) ** 2 / (F.lit(2.0) * v)
    if train is None:
        return df.groupBy(*by, "task").agg(F.avg(loss).alias("msll"))
    # one scalar (pooled variance) and one row per task
    tv = train.agg(F.greatest(F.var_samp(train_y), F.lit(VAR_FLOOR)).alias("tv")).first()["tv"]
    stats = train.groupBy("task").agg(F.avg(train_y).alias("tm")).withColumn("tv", F.lit(tv))
    j = df.join(stats, "task", "left")
    triv = (F.lit(0.5) * F.log(F.lit(2.0 * math.pi) * F.col("tv"))
            + (F.col(y) - F.col("tm")) ** 2 / (F.lit(2.0) * F.col("tv")))
    return j.groupBy(*by, "task").agg((F.avg(loss) - F.avg(triv)).alias("msll"))


def rmse(df: DataFrame, by: list[str] | None = None, y: str = "y", mean: str = "mean") -> DataFrame:
    """MET-1 alone."""
    by = by or []
    d = F.col(mean) - F.col(y)
    t = df.groupBy(*by, "task").agg(F.sqrt(F.avg(d * d)).alias("_r"))
    return t.groupBy(*by).agg(F.avg("_r").alias("rmse"))
