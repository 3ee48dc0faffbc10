"""ML-12: encoder and decoder networks with given weights, applied to vectors in Arrow batches.

A network is a table of layers (part, ordinal, kind, n_in, n_out, weight, bias): parts are
``encoder``, ``decoder`` and, for variational ones, ``mean`` and ``logvar``; kinds are ``linear``
(weight row by row), ``norm`` (layer normalisation: weight is the gain), ``relu`` and ``gelu``.
Its size is summed before anything is fetched; the layers then travel to the tasks as one broadcast.
Latent draws are hash normals of (id, position, seed), made in the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surrogata.functions.rand import hash_normal
from surrogata.operators.arrowutil import list_to_matrix, matrix_to_list
from surrogata.operators.blas import single_thread_blas
from surrogata.operators.pca import _map_vectors

LIMIT_BYTES = 1 << 28      # weights that are sent to the tasks
NORM_EPS = 1e-5
LAYERS = "part string, ordinal int, kind string, n_in int, n_out int, weight array<double>, bias array<double>"
PARTS = ("encoder", "decoder", "mean", "logvar")


def _erf(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erf, 1, 1)(x).astype(float)


def layer_rows(part: str, layers: list[tuple]) -> list[tuple]:
    """Rows of the layer table from ('linear', W, b), ('norm', gain, bias), ('relu',) and ('gelu',)."""
    rows = []
    for k, (kind, *arrays) in enumerate(layers):
        if kind == "linear":
            W, b = (np.asarray(a, float) for a in arrays)
            rows.append((part, k, kind, W.shape[1], W.shape[0], W.ravel().tolist(), b.tolist()))
        elif kind == "norm":
            gain, b = (np.asarray(a, float) for a in arrays)
            rows.append((part, k, kind, gain.size, gain.size, gain.tolist(), b.tolist()))
        else:
            rows.append((part, k, kind, None, None, None, None))
    return rows


def _apply(layers: list[tuple], X: np.ndarray) -> np.ndarray:
    for kind, weight, bias in layers:
        if kind == "linear":
            X = X @ weight.T + bias
        elif kind == "norm":
            centred = X - X.mean(axis=1, keepdims=True)
            X = centred / np.sqrt((centred ** 2).mean(axis=1, keepdims=True) + NORM_EPS) * weight + bias
        elif kind == "relu":
            X = np.maximum(X, 0.0)
        else:
            X = 0.5 * X * (1.0 + _erf(X / math.sqrt(2.0)))
    return X


class Network:
    """The layers of a table, checked and shared with the tasks."""

    def __init__(self, layers: DataFrame, limit: int = LIMIT_BYTES):
        entries = F.coalesce(F.size("weight"), F.lit(0)) + F.coalesce(F.size("bias"), F.lit(0))
        size = 8 * int(layers.agg(F.sum(F.greatest(entries, F.lit(0)))).first()[0] or 0)
        if size > limit:
            raise ValueError(f"{size} bytes of weights; at most {limit} are sent to the tasks")
        parts: dict[str, list] = {p: [] for p in PARTS}
        self.widths: dict[str, int] = {}
        for r in sorted(layers.collect(), key=lambda r: (r["part"], r["ordinal"])):
            if r["part"] not in parts or r["kind"] not in ("linear", "norm", "relu", "gelu"):
                raise ValueError(f"no such layer: {r['part']}, {r['kind']}")
            weight = None if r["weight"] is None else np.array(r["weight"], float)
            if r["kind"] in ("linear", "norm"):
                before = self.widths.get(r["part"], r["n_in"])
                wanted = r["n_in"] * r["n_out"] if r["kind"] == "linear" else r["n_out"]
                if before != r["n_in"] or weight.size != wanted or len(r["bias"]) != r["n_out"]:
                    raise ValueError(f"{r['part']} layer {r['ordinal']} does not fit: {before} values come in, "
                                     f"it takes {r['n_in']} and has {weight.size} weights")
                self.widths[r["part"]] = r["n_out"]
            if r["kind"] == "linear":
                weight = weight.reshape(r["n_out"], r["n_in"])
            parts[r["part"]].append((r["kind"], weight, None if r["bias"] is None else np.array(r["bias"], float)))
        self.variational = bool(parts["mean"])
        if self.variational != bool(parts["logvar"]):
            raise ValueError("a variational encoder has both a mean and a logvar part")
        self.shared = layers.sparkSession.sparkContext.broadcast(parts)

    def _part(self, df: DataFrame, name: str, col: str, out: str) -> DataFrame:
        shared = self.shared

        def run(X):
            single_thread_blas()
            return _apply(shared.value[name], X)

        return _map_vectors(df, col, out, run, keep=[c for c in df.columns if c != out])

    def _moments(self, df: DataFrame, x: str) -> DataFrame:
        """The rows with ``mean`` and ``logvar``, all three parts in one pass through Python."""
        shared = self.shared
        keep = [c for c in df.columns if c not in ("mean", "logvar")]
        sel = df.select(*keep, F.col(x).alias("_vector"))
        vector = T.ArrayType(T.DoubleType())
        schema = T.StructType([*sel.schema.fields[:len(keep)], T.StructField("mean", vector),
                               T.StructField("logvar", vector)])
        names = schema.names

        def fn(batches):
            single_thread_blas()
            parts = shared.value
            for rb in batches:
                if rb.num_rows:
                    hidden = _apply(parts["encoder"], list_to_matrix(rb.column(len(keep))))
                    own = [matrix_to_list(_apply(parts[p], hidden)) for p in ("mean", "logvar")]
                    yield pa.RecordBatch.from_arrays([rb.column(i) for i in range(len(keep))] + own, names=names)

        return sel.mapInArrow(fn, schema)

    def encode(self, df: DataFrame, x: str = "x", out: str = "z", id_col: str = "id", seed: int = 42) -> DataFrame:
        """The rows with their latent vector; a variational encoder adds ``mean`` and ``logvar`` columns
        and draws ``mean + exp(logvar / 2) * e``, e a normal of (id, position, seed)."""
        if not self.variational:
            return self._part(df, "encoder", x, "_hidden").withColumnRenamed("_hidden", out)
        both = self._moments(df, x)
        noise = F.transform(F.sequence(F.lit(0), F.size("mean") - 1),
                            lambda j: hash_normal(F.col(id_col), j, F.lit(seed)))
        spread = F.zip_with("logvar", noise, lambda v, e: F.exp(v / 2.0) * e)
        return both.withColumn(out, F.zip_with("mean", spread, lambda m, s: m + s))

    def decode(self, df: DataFrame, z: str = "z", out: str = "x_hat") -> DataFrame:
        return self._part(df, "decoder", z, out)


def layer_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, LAYERS)
