"""ML-8, ML-9, SRT-6: model size rule and inducing-point choice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surrogata.functions.rand import hash_normal, hash_order_key


def model_size(n: int, d: int, r90: int, n_outputs: int, min_rank: int = 1,
               base: int = 64) -> tuple[int, int]:
    """ML-8: latent rank and inducing count.

    rank = min(max(r90, min_rank), p // 2), clamped to [1, p] (trap 14);
    m = min(512, min(256, max(base, n // 4)) + 8 d), then min(m, min(512, n + 50)).
    """
    rank = min(max(r90, min_rank), n_outputs // 2)
    rank = max(1, min(rank, n_outputs))
    m = min(512, min(256, max(base, n // 4)) + 8 * d)
    m = min(m, min(512, n + 50))
    return rank, m


def distinct_landmarks(df: DataFrame, x: str, m: int, seed: int = 42) -> np.ndarray:
    """The m distinct vectors with the least md5 of (JSON text, seed), in that order; all distinct
    vectors when there are fewer.  A task hands on at most m rows, whatever copies it holds."""
    keyed = df.select(F.col(x).cast("array<double>").alias("v")) \
        .select(hash_order_key(F.to_json("v"), F.lit(seed)).alias("h"), "v")

    def least(batches):
        held: dict[str, list] = {}
        bar = None
        for rb in batches:
            keys = rb.column(0).to_pylist()
            for i, h in enumerate(keys):
                if h not in held and (bar is None or h < bar):
                    held[h] = rb.column(1)[i].as_py()
            if len(held) > 2 * m:
                held = dict(sorted(held.items())[:m])
                bar = max(held)
        rows = sorted(held.items())[:m]
        yield pa.RecordBatch.from_arrays(
            [pa.array([h for h, _ in rows], pa.string()),
             pa.array([v for _, v in rows], pa.list_(pa.float64()))], ["h", "v"])

    few = keyed.mapInArrow(least, "h string, v array<double>")
    rows = few.groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(m).collect()
    return np.array([r["v"] for r in rows], dtype=float)


def kmeans_centres(df: DataFrame, x: str, k: int, seed: int = 42, n_init: int = 10,
                   max_iter: int = 20) -> np.ndarray:
    """ML-9: MLlib k-means (k-means|| init), best of ``n_init`` seeds by training cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vec = df.select(array_to_vector(F.col(x)).alias("features")).persist()
    try:
        best = None
        for i in range(n_init):
            model = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="features").fit(vec)
            cost = model.summary.trainingCost
            if best is None or cost < best[0]:
                best = (cost, model)
        return np.array([c.tolist() for c in best[1].clusterCenters()], dtype=float)
    finally:
        vec.unpersist()


def padding_points(stats_mean: np.ndarray, stats_std: np.ndarray, ids: DataFrame,
                   id_col: str = "id", seed: int = 42) -> DataFrame:
    """SRT-6: random points from the data mean/std, one per id of ``ids``.

    Normals are hash draws of (id, j, seed), so the padding is reproducible.
    """
    d = stats_mean.size
    mu = F.array(*[F.lit(float(v)) for v in stats_mean])
    sd = F.array(*[F.lit(float(v)) for v in stats_std])
    idc = F.col(id_col)
    z = F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda j: hash_normal(idc, j, F.lit(seed)))
    x = F.zip_with(F.zip_with(z, sd, lambda a, b: a * b), mu, lambda a, b: a + b)
    return ids.select(idc.alias("id"), x.alias("x"))
