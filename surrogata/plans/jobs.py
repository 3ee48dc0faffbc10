"""JOB-1..JOB-6: composite jobs built from the operators."""

from __future__ import annotations

import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from surrogata.functions.scalar import threshold_floor
from surrogata.operators import maps, metrics, truncate
from surrogata.operators.projection import append_target
from surrogata.operators.scale import Scaler, fit_scaler, standardise_df
from surrogata.operators.split import add_split_flag


@dataclass
class Prepared:
    train: DataFrame
    test: DataFrame
    scaler: Scaler          # features then target (target last)
    n_train: int
    n_test: int
    n_features: int

    @property
    def target(self) -> tuple[float, float]:
        return float(self.scaler.mean[-1]), float(self.scaler.scale[-1])


def prepare(df: DataFrame, test_size: float | int = 0.15, seed: int = 42, fit_on: str = "all",
            persist_to: str | None = None, cache: bool = False) -> Prepared:
    """JOB-1: standardise ``[x | y]``, split, optionally write the store.

    ``fit_on='all'`` reproduces the original (scaler fitted before the split);
    ``'train'`` fits on the training rows only.  ``persist_to`` writes the
    train/test tables (a written table cuts lineage and survives executor loss).
    """
    flagged = add_split_flag(df.select("id", "x", "y"), "id", test_size, seed)
    v = flagged.withColumn("v", append_target("x", "y"))
    src = v if fit_on == "all" else v.filter(~F.col("is_test"))
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on must be 'all' or 'train'")
    scaler = fit_scaler(src, "v")
    d = scaler.width - 1
    z = standardise_df(v.select("id", "v", "is_test"), "v", scaler)
    z = z.select("id", F.slice("v", 1, d).alias("x"), F.element_at("v", -1).alias("y"), "is_test")
    if persist_to:
        z.write.mode("overwrite").partitionBy("is_test").parquet(persist_to)
        # the partition column comes back as a string; train/test filters prune partitions
        z = df.sparkSession.read.parquet(persist_to).withColumn("is_test", F.col("is_test").cast("boolean"))
    elif cache:
        # train and test (and every pass of a later fit) read this table
        z = z.persist(StorageLevel.MEMORY_AND_DISK)
    counts = {r["is_test"]: r["c"] for r in z.groupBy("is_test").agg(F.count("*").alias("c")).collect()}
    train = z.filter(~F.col("is_test")).drop("is_test")
    test = z.filter(F.col("is_test")).drop("is_test")
    return Prepared(train, test, scaler, int(counts.get(False, 0)), int(counts.get(True, 0)), d)


def descale_predictions(pred: DataFrame, mu: float, sigma: float) -> DataFrame:
    """PRJ-5 on the four prediction columns (sd by the scale only)."""
    out = pred
    for c in ("mean", "lower", "upper"):
        out = out.withColumn(c, F.col(c) * F.lit(sigma) + F.lit(mu))
    return out.withColumn("sd", F.col("sd") * F.lit(sigma))


def evaluate(emulator, prep: Prepared) -> tuple[DataFrame, dict]:
    """JOB-2: fit, predict the test rows, descale, RMSE; returns predictions + metrics row."""
    t0 = time.perf_counter()
    emulator.fit(prep.train)
    t1 = time.perf_counter()
    mu, sigma = prep.target
    pred = descale_predictions(emulator.predict(prep.test), mu, sigma)
    pred = pred.withColumn("y", F.col("y") * F.lit(sigma) + F.lit(mu))
    pred = pred.persist()
    pred.count()
    t2 = time.perf_counter()
    rmse = pred.agg(F.sqrt(F.avg((F.col("mean") - F.col("y")) ** 2)).alias("rmse")).first()["rmse"]
    row = {"name": emulator.name, "rmse": float(rmse), "train_time": t1 - t0, "infer_time": t2 - t1,
           "mode": emulator.mode}
    return pred, row


def evaluate_all(emulators: list, prep: Prepared, at_once: int = 4) -> list[tuple[DataFrame, dict]]:
    """JOB-2 for independent models, several at a time, in the order given.

    Every model runs in a driver thread of its own with its own scheduler pool and job group, so with
    ``spark.scheduler.mode=FAIR`` the models share the executors evenly (under FIFO a model takes what
    the one before leaves), and a model that fails ends the others by cancelling their groups.
    """
    spark = prep.train.sparkSession
    sc, groups = spark.sparkContext, [f"model-{uuid.uuid4().hex[:8]}-{e.name}" for e in emulators]

    def one(emulator, group):
        sc.setLocalProperty("spark.scheduler.pool", group)
        sc.setJobGroup(group, f"evaluate {emulator.name}", interruptOnCancel=False)
        try:
            return evaluate(emulator, prep)
        finally:
            sc.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(one), e, g) for e, g in zip(emulators, groups)]
        try:
            return [r.result() for r in running]
        except BaseException:
            for r, g in zip(running, groups):
                r.cancel()
                sc.cancelJobGroup(g)
            raise


DOCUMENT_ROW_LIMIT = 1_000_000


def metrics_document(pred: DataFrame, row: dict, limit: int = DOCUMENT_ROW_LIMIT) -> DataFrame:
    """SRC-10 document form: one row with arrays ordered by id.

    The document packs a whole test set into one row, so it is only built for
    test sets up to ``limit`` rows; larger results stay in the long form
    (write ``pred`` partitioned by model name instead).
    """
    n = pred.count()
    if n > limit:
        raise ValueError(f"{n} predictions exceed the document limit {limit}; keep the long form")
    s = pred.agg(F.sort_array(F.collect_list(F.struct("id", "y", "mean", "sd", "lower", "upper"))).alias("r"))
    return s.select(
        F.lit(row["name"]).alias("name"),
        F.col("r.y").alias("ground_truth"), F.col("r.mean").alias("predictions_mean"),
        F.col("r.sd").alias("predictions_std"), F.col("r.lower").alias("predictions_lower95"),
        F.col("r.upper").alias("predictions_upper95"),
        F.lit(row["rmse"]).alias("rmse"), F.lit(row["train_time"]).alias("train_time"),
        F.lit(row["infer_time"]).alias("infer_time"))


def compare(results: DataFrame, name: str = "name", ordinal: str = "ordinal") -> DataFrame:
    """JOB-3 / SET-2: last document per model name wins; comparison table.

    ``max_by`` is an aggregate with map-side partial merge, so a model name
    holding most rows does not land in one task (a window would sort it).
    """
    cols = ["rmse", "train_time", "infer_time", *(["mode"] if "mode" in results.columns else [])]
    row = F.struct(*cols)
    return (results.groupBy(F.col(name).alias("model"))
            .agg(F.max_by(row, F.col(ordinal)).alias("_r"))
            .select("model", *[f"_r.{c}" for c in cols]))


def map_report(truth_cells: DataFrame, pred_cells: DataFrame, samples: DataFrame, rows: int, cols: int,
               threshold: float = 0.5) -> dict[str, DataFrame]:
    """JOB-5: floor, mean/std maps, difference, sign, percent error, best/worst runs.

    Inputs are long ``(sample_id, pos, value)`` of the stored cells.  Errors and counts are
    aggregates of those and joins with the grid or the samples; only the mean and std maps scatter
    the cells to the grid."""
    grid = truncate.grid_positions(samples.sparkSession, rows, cols)
    gt = maps.floor_values(truth_cells, threshold)
    pr = maps.floor_values(pred_cells, threshold)
    dense = [truncate.scatter(v, samples, rows, cols) for v in (gt, pr)]
    cmp = maps.compare_maps(*map(maps.mean_std_map, dense))
    err = maps.percent_error(maps.paired(gt, pr))
    counts = maps.error_counts(err, samples)
    which = maps.best_worst(counts)
    return {
        "maps": cmp,
        "limits": maps.colour_limits(cmp),
        "mean_error": maps.mean_error_map(err, grid),
        "counts": counts,
        "best_worst": which,
        "run_maps": maps.run_map(err, which, grid),
    }


def chart_series(pred: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """JOB-6: parity and residual series (floored), and a histogram of the truth."""
    yt = threshold_floor(F.col("y"), threshold)
    yp = threshold_floor(F.col("mean"), threshold)
    parity = pred.select("id", yt.alias("y_true"), yp.alias("y_pred"), "sd")
    resid = parity.select("id", "y_true", (F.col("y_pred") - F.col("y_true")).alias("residual"), "sd")
    return {"parity": parity, "residuals": resid, "histogram": maps.histogram(pred, "y")}


def rmse_against_time(comparison: DataFrame) -> DataFrame:
    """JOB-6: the points (model, total time, RMSE) of the comparison chart, and whether no other model
    is both faster and more accurate."""
    points = comparison.select("model", (F.col("train_time") + F.col("infer_time")).alias("time"), "rmse")
    best_so_far = Window.orderBy("time", "rmse").rowsBetween(Window.unboundedPreceding, -1)      # a row a model
    return points.withColumn("frontier", F.coalesce(F.col("rmse") < F.min("rmse").over(best_so_far), F.lit(True)))


def cumulative_variance(spectrum: DataFrame, share: float = 0.95) -> DataFrame:
    """JOB-6: (k, ratio, cum_ratio, above) of a component spectrum (k, variance); ``above`` marks the
    components from the first whose cumulative share exceeds ``share`` on."""
    from surrogata.operators.windows import cumulative_ratio
    return cumulative_ratio(spectrum, "k", "variance").select("k", "ratio", "cum_ratio",
                                                              (F.col("cum_ratio") > share).alias("above"))


# Model sets of the two case-study kinds.
SYNTHETIC_MODELS = ("exact_gp", "dkl", "rgasp", "pca_rgasp")
FILE_MODELS = ("exact_gp", "dkl", "pca_rgasp")


def case_study(spark, name: str, data_dir: str | None = None, models: tuple | None = None,
               test_size: float = 0.15, seed: int = 42, at_once: int = 4) -> DataFrame:
    """JOB-4: catalog -> prepare -> evaluate every model, ``at_once`` of them side by side ->
    comparison table."""
    from surrogata.operators import emulators
    from surrogata.sources import catalog
    df = catalog.load(spark, name, data_dir, seed)
    if models is None:
        models = SYNTHETIC_MODELS if catalog.CATALOG[name]["source"] == "" else FILE_MODELS
    # every model reads the prepared store: write it once below the shared
    # checkpoint folder (a written table survives executor loss, cuts lineage)
    from surrogata.session import scratch_path
    prep = prepare(df, test_size, seed, persist_to=scratch_path(spark, f"case-{name}-{uuid.uuid4().hex[:8]}"))
    rows = []
    for i, (pred, row) in enumerate(evaluate_all([emulators.make(m) for m in models], prep, at_once)):
        pred.unpersist()
        rows.append((row["name"], i, row["rmse"], row["train_time"], row["infer_time"], row["mode"]))
    res = spark.createDataFrame(rows, "name string, ordinal int, rmse double, train_time double, "
                                      "infer_time double, mode string")
    return compare(res)
