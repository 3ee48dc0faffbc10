"""SRT-5, GP-12, GP-13: predictive draws and Monte-Carlo reconstruction.

Draws are hash normals of (id, task, draw, seed) — reproducible under any
partitioning.  For reconstruction the draws never leave the task: each Arrow
batch draws, maps back through the (linear or kernel) inverse and reduces to
a population standard deviation per output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surrogata.functions.rand import hash_normal
from surrogata.operators.arrowutil import list_to_matrix, matrix_to_list
from surrogata.operators.blas import single_thread_blas


def predictive_draws(pred_long: DataFrame, n_draws: int = 128, seed: int = 42) -> DataFrame:
    """SRT-5: ``(id, task, draw, value)`` with value ~ N(mean, sd), independent per (id, task)."""
    d = pred_long.select("id", "task", "mean", "sd", F.explode(F.sequence(F.lit(1), F.lit(n_draws))).alias("draw"))
    return d.select("id", "task", "draw",
                    (F.col("mean") + F.col("sd") * hash_normal(F.col("id"), F.col("task"), F.col("draw"),
                                                               F.lit(seed))).alias("value"))


def _bits(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _row_normals(ids: np.ndarray, n_draws: int, k: int, seed: int) -> np.ndarray:
    """(rows, draws, k) standard normals, each a function of (seed, id, draw, position)."""
    row = _bits(np.asarray(ids, np.int64).view(np.uint64) ^ _bits(np.array([seed], np.int64).view(np.uint64)))
    place = np.arange(1, n_draws * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = _bits(row[:, None] + place[None, :])
    u = ((h >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53
    angle = (_bits(h ^ np.uint64(0xD1B54A32D192ED03)) >> np.uint64(11)).astype(float) * (2.0 * np.pi / 2.0 ** 53)
    return (np.sqrt(-2.0 * np.log(u)) * np.cos(angle)).reshape(-1, n_draws, k)


#: Numbers that a task holds at once when it maps draws to the output space.
DRAW_BUDGET = 1 << 22


def mc_reconstruct(pred: DataFrame, inverse_np, n_draws: int = 100, seed: int = 42) -> DataFrame:
    """GP-12: mean/sd arrays in latent space -> mean and population sd in output space.

    ``inverse_np`` maps (N, k) latent rows to (N, p) outputs (PCA or kernel
    PCA inverse).  Per-row generators are seeded by (seed, id).
    """
    schema = T.StructType([T.StructField("id", T.LongType()),
                           T.StructField("mean", T.ArrayType(T.DoubleType())),
                           T.StructField("sd", T.ArrayType(T.DoubleType()))])

    def fn(batches):
        single_thread_blas()
        for rb in batches:
            if rb.num_rows == 0:
                continue
            ids = rb.column(0).to_numpy(zero_copy_only=False)
            mu = list_to_matrix(rb.column(1))
            sd = list_to_matrix(rb.column(2))
            centre = inverse_np(mu)
            spread = np.empty_like(centre)
            step = max(1, DRAW_BUDGET // (n_draws * max(centre.shape[1], mu.shape[1])))
            for s in range(0, ids.size, step):
                eps = _row_normals(ids[s:s + step], n_draws, mu.shape[1], seed)
                lat = mu[s:s + step, None, :] + sd[s:s + step, None, :] * eps          # rows x D x k
                outs = inverse_np(lat.reshape(-1, mu.shape[1])).reshape(len(eps), n_draws, -1)
                spread[s:s + step] = outs.std(axis=1)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), matrix_to_list(centre), matrix_to_list(spread)], names=["id", "mean", "sd"])

    return pred.select(F.col("id").cast("long"), "mean", "sd").mapInArrow(fn, schema)


def sample_outputs(pred: DataFrame, inverse_np, n_draws: int = 128, seed: int = 42) -> DataFrame:
    """GP-13: predictive samples mapped back to the output space, long ``(id, draw, pos, value)``."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("draw", T.IntegerType()),
                           T.StructField("value", T.ArrayType(T.DoubleType()))])

    def fn(batches):
        single_thread_blas()
        for rb in batches:
            if rb.num_rows == 0:
                continue
            ids = rb.column(0).to_numpy(zero_copy_only=False)
            mu = list_to_matrix(rb.column(1))
            sd = list_to_matrix(rb.column(2))
            eps = _row_normals(ids, n_draws, mu.shape[1], seed)
            lat = (mu[:, None, :] + sd[:, None, :] * eps).reshape(-1, mu.shape[1])
            out = inverse_np(lat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, n_draws)), pa.array(np.tile(np.arange(1, n_draws + 1, dtype=np.int32), ids.size)),
                 matrix_to_list(out)], names=["id", "draw", "value"])

    s = pred.select(F.col("id").cast("long"), "mean", "sd").mapInArrow(fn, schema)
    return s.select("id", "draw", F.posexplode("value").alias("pos", "value"))
