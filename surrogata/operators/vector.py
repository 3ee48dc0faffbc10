"""GP-10/12/13, ML-10: vector emulators from parts: scalers, reducers of inputs and outputs, latent GPs.

A reducer turns vectors into shorter ones and back: ``LinearReducer`` (PCA), ``KernelReducer``
(kernel PCA with a ridge pre-image), or a list of them, each fitted on what the one before gives.
The way back always ends in a product with a matrix of (features x outputs), so predictions, spreads
and samples are made slice by slice of the outputs: a task never holds rows x draws x outputs.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surrogata.operators import kpca, latent, sgp
from surrogata.operators import pca as pca_ops
from surrogata.operators.arrowutil import list_to_matrix, matrix_to_list
from surrogata.operators.blas import single_thread_blas
from surrogata.operators.emulators import Emulator
from surrogata.operators.sampling import _row_normals
from surrogata.operators.scale import Scaler, standardise_df
from surrogata.operators.stats import vector_stats

#: Numbers that a task holds at once when it maps draws to the output space.
BUDGET = 1 << 22


class LinearReducer:
    """PCA; the spread of outputs follows from the latent ones in closed form."""

    linear = True

    def __init__(self, n_components=0.95):
        pca_ops.check_n_components(n_components)
        self.n_components = n_components

    def fit(self, df: DataFrame, col: str) -> "LinearReducer":
        self.model = pca_ops.fit_pca(df, col, self.n_components)
        self.width, self.weights, self.offset = self.model.k, self.model.components, self.model.mean
        return self

    def reduce(self, X: np.ndarray) -> np.ndarray:
        return self.model.transform_np(X)

    def features(self, latents: np.ndarray) -> np.ndarray:
        return latents


class KernelReducer:
    """Kernel PCA on landmarks; the way back is its ridge pre-image."""

    linear = False

    def __init__(self, n_components: int, kernel: str = "rbf", m: int = 256, alpha: float = 0.001, **kernel_args):
        if not isinstance(n_components, int) or n_components < 1:
            raise ValueError("a kernel reducer takes a positive count of components")
        self.args = dict(n_components=n_components, kernel=kernel, m=m, alpha=alpha, **kernel_args)

    def fit(self, df: DataFrame, col: str) -> "KernelReducer":
        self.model = m = kpca.fit_kpca(df, col, **self.args)
        self.width, self.weights = m.components.shape[0], m.dual
        self.offset = np.zeros(m.dual.shape[1])
        return self

    def reduce(self, X: np.ndarray) -> np.ndarray:
        return self.model.transform_np(X)

    def features(self, latents: np.ndarray) -> np.ndarray:
        m = self.model
        return kpca.make_kernel(m.kernel, m.gamma, m.degree, m.coef0)(latents, m.latent_landmarks)


class Chain:
    """Reducers one after another (none: the vectors themselves)."""

    def __init__(self, parts):
        self.parts = list(parts) if isinstance(parts, (list, tuple)) else [] if parts is None else [parts]

    @property
    def linear(self) -> bool:
        return all(p.linear for p in self.parts)

    def fit(self, df: DataFrame, col: str) -> "Chain":
        for part in self.parts:
            part.fit(df, col)
            df = pca_ops._map_vectors(df, col, col, part.reduce)
        return self

    def reduce(self, X: np.ndarray) -> np.ndarray:
        for part in self.parts:
            X = part.reduce(X)
        return X

    def apply(self, df: DataFrame, col: str) -> DataFrame:
        return pca_ops._map_vectors(df, col, col, self.reduce) if self.parts else df

    def features(self, latents: np.ndarray) -> np.ndarray:
        """What the last product (``weights``, ``offset``) turns into vectors."""
        for part in reversed(self.parts[1:]):
            latents = part.features(latents) @ part.weights + part.offset
        return self.parts[0].features(latents) if self.parts else latents

    def way_back(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.parts[0].weights, self.parts[0].offset) if self.parts else (np.eye(width), np.zeros(width))

    def linear_map(self, width: int) -> np.ndarray:
        """(latents x outputs) of a linear chain."""
        out = self.way_back(width)[0]
        for part in self.parts[1:]:
            out = part.weights @ out
        return out


class Predictions(NamedTuple):
    """``latent`` (id, mean, sd, lower, upper of the latent outputs), ``original`` (id, mean in the
    units of the data), ``uncertainty`` (id, sd, lower, upper in those units, or None)."""
    latent: DataFrame
    original: DataFrame
    uncertainty: DataFrame | None


class VectorEmulator(Emulator):
    """Vector outputs through any input and output reducer.

    ``kernels='own'`` fits a kernel a latent output (LMC), 'shared' one for all.  ``scaling`` of
    inputs is 'zscore' or 'minmax'; outputs are z-scored.  ``rank`` above the number of components
    that an output PCA can give adds random directions of small weight.
    """

    def __init__(self, input_reducer=None, output_reducer=None, kernels: str = "shared", scaling: str = "zscore",
                 cfg: sgp.GPConfig | None = None, z: float = 1.96, name: str = "vector", rank: int | None = None,
                 ndim: int | None = None, zero_mean: bool = False, seed: int = 42):
        if zero_mean and output_reducer is not None:
            raise ValueError("zero_mean cannot be combined with an output reducer")      # VAL-6
        if kernels not in ("shared", "own"):
            raise ValueError("kernels must be 'shared' or 'own'")
        if scaling not in ("zscore", "minmax"):
            raise ValueError("scaling must be 'zscore' or 'minmax'")
        self.inputs, self.outputs = Chain(input_reducer), Chain(output_reducer)
        self.kernels, self.scaling, self.cfg, self.z, self.name = kernels, scaling, cfg or sgp.GPConfig(), z, name
        self.rank, self.ndim, self.seed = rank, ndim, seed
        self.states: list[sgp.GPState] | None = None

    @property
    def mode(self) -> str:
        return self.states[0].mode

    def fit(self, train: DataFrame) -> "VectorEmulator":
        train = train.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return self._fit(train)
        finally:
            train.unpersist()

    def _fit(self, train: DataFrame) -> "VectorEmulator":
        def column(name, key):
            rows = sorted(vector_stats(train, name).collect(), key=lambda r: r["pos"])
            return [np.array([float(r[k] or 0.0) for r in rows]) for k in key]

        mean, sd, low, high = column("x", ("mean", "std_pop", "min", "max"))
        if self.scaling == "zscore":
            self.xscaler = Scaler(mean, np.where(sd > 0, sd, 1.0))
        else:
            self.xscaler = Scaler(low, np.maximum(high - low, 1e-12))
        mean, sd = column("y", ("mean", "std_pop"))
        self.yscaler = Scaler(mean, np.where(sd > 0, sd, 1.0))
        scaled = standardise_df(standardise_df(train.select("id", "x", "y"), "x", self.xscaler), "y", self.yscaler)
        self.inputs.fit(scaled, "x")
        self.width_in = mean_width = self.xscaler.mean.size
        reduced = self.inputs.parts[-1].width if self.inputs.parts else mean_width
        if self.ndim is not None and reduced != self.ndim:
            raise ValueError(f"{reduced} input dimensions after reduction, {self.ndim} expected")     # VAL-5
        self.outputs.fit(scaled, "y")
        latents = self.outputs.apply(self.inputs.apply(scaled, "x"), "y")
        if self.kernels == "own":
            self.states = latent.fit_each(latents, "x", "y", self.cfg)
        else:
            self.states = [sgp.fit(latents, "x", "y", self.cfg)]
        self._pad()
        return self

    def _pad(self) -> None:
        """Random directions for ranks that the output PCA can't reach: latent outputs that the data
        say nothing of, with mean 0 and unit prior, times weights of 0.1."""
        width = sum(s.p for s in self.states)
        self.padding = np.zeros((0, self.yscaler.mean.size))
        if self.rank is not None and self.rank > width:
            draw = _row_normals(np.arange(self.rank - width), 1, self.yscaler.mean.size, self.seed)[:, 0, :]
            self.padding = 0.1 * draw

    # -- latent predictions

    def _latent(self, df: DataFrame) -> DataFrame:
        ready = self.inputs.apply(standardise_df(df.select("id", "x"), "x", self.xscaler), "x")
        if self.kernels == "own":
            return latent.predict_each(ready, self.states, "x", keep=["id"], z=self.z)
        return sgp.predict(ready, self.states[0], "x", keep=["id"], z=self.z, scalar=False)

    def predict_all(self, df: DataFrame, uncertainty: str | None = "linear", n_draws: int = 100) -> Predictions:
        """``uncertainty``: None, 'linear' (propagated through the loadings, linear reducers only) or
        'draws' (spread of the pre-images of latent draws, any reducer)."""
        if self.states is None:
            raise RuntimeError("emulator is not fitted yet")
        if uncertainty not in (None, "linear", "draws"):
            raise ValueError("uncertainty must be None, 'linear' or 'draws'")
        if uncertainty == "linear" and not self.outputs.linear:
            raise ValueError("the linear way needs linear output reducers; use 'draws'")
        lat = self._latent(df)
        both = self._original(lat, uncertainty, n_draws)
        spread = both.select("id", "sd", "lower", "upper") if uncertainty else None
        return Predictions(lat, both.select("id", "mean"), spread)

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, mean, sd, lower, upper) in the units of the data."""
        return self._original(self._latent(df), "linear" if self.outputs.linear else "draws", 100)

    def _original(self, lat: DataFrame, uncertainty: str | None, n_draws: int) -> DataFrame:
        outputs, ymu, ysc, zz, seed = self.outputs, self.yscaler.mean, self.yscaler.scale, self.z, self.seed
        width = sum(s.p for s in self.states)
        weights, offset = outputs.way_back(width)
        squared = outputs.linear_map(width) ** 2 if uncertainty == "linear" else None
        extra = (self.padding ** 2).sum(axis=0)
        schema = T.StructType([T.StructField("id", T.LongType()), *[T.StructField(c, T.ArrayType(T.DoubleType()))
                                                                    for c in ("mean", "sd", "lower", "upper")]])

        def spread_of(ids, m, s):
            """Population spread of the outputs of draws, a slice of outputs and some rows at a time."""
            out = np.empty((len(m), len(offset)))
            inner = max(m.shape[1], weights.shape[0])
            rows = max(1, BUDGET // (n_draws * inner))
            for low in range(0, len(m), rows):
                own = slice(low, low + rows)
                lats = m[own, None, :] + s[own, None, :] * _row_normals(ids[own], n_draws, m.shape[1], seed)
                feats = outputs.features(lats.reshape(-1, m.shape[1]))
                step = max(1, BUDGET // len(feats))
                for a in range(0, len(offset), step):
                    made = (feats @ weights[:, a:a + step]).reshape(-1, n_draws, min(step, len(offset) - a))
                    out[own, a:a + step] = made.std(axis=1)
            return out

        def fn(batches):
            single_thread_blas()
            for rb in batches:
                if not rb.num_rows:
                    continue
                ids = rb.column(0).to_numpy(zero_copy_only=False)
                m, s = list_to_matrix(rb.column(1)), list_to_matrix(rb.column(2))
                mean = (outputs.features(m) @ weights + offset) * ysc + ymu
                if uncertainty == "linear":
                    sd = np.sqrt((s * s) @ squared + extra) * ysc
                elif uncertainty == "draws":
                    sd = np.sqrt(spread_of(ids, m, s) ** 2 + extra) * ysc
                else:
                    sd = np.full_like(mean, np.nan)
                yield pa.RecordBatch.from_arrays(
                    [rb.column(0), *[matrix_to_list(M) for M in (mean, sd, mean - zz * sd, mean + zz * sd)]],
                    names=schema.names)

        return lat.select(F.col("id").cast("long"), "mean", "sd").mapInArrow(fn, schema)

    def sample(self, df: DataFrame, n: int = 1, seed: int = 42) -> DataFrame:
        """GP-13: (id, draw, pos, value), draws of the predictive distribution in the units of the data.
        A task holds at most BUDGET numbers of rows x draws x outputs at once."""
        if self.states is None:
            raise RuntimeError("emulator is not fitted yet")
        outputs, ymu, ysc, padding = self.outputs, self.yscaler.mean, self.yscaler.scale, self.padding
        width = sum(s.p for s in self.states)
        weights, offset = outputs.way_back(width)
        schema = "id long, draw int, at int, value array<double>"

        def fn(batches):
            single_thread_blas()
            for rb in batches:
                ids = rb.column(0).to_numpy(zero_copy_only=False)
                m, s = list_to_matrix(rb.column(1)), list_to_matrix(rb.column(2))
                inner = max(width + len(padding), weights.shape[0], 1)
                for r in range(len(ids)):
                    eps = _row_normals(ids[r:r + 1], n, width + len(padding), seed)[0]
                    for d in range(0, n, step := max(1, BUDGET // (4 * inner))):
                        own = eps[d:d + step]
                        feats = outputs.features(m[r] + s[r] * own[:, :width])
                        cols = max(1, BUDGET // (4 * len(feats)))
                        for a in range(0, len(offset), cols):
                            made = feats @ weights[:, a:a + cols] + offset[a:a + cols]
                            made += own[:, width:] @ padding[:, a:a + cols]
                            made = made * ysc[a:a + cols] + ymu[a:a + cols]
                            k = len(made)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(k, ids[r])), pa.array(np.arange(d + 1, d + k + 1, dtype=np.int32)),
                                 pa.array(np.full(k, a, np.int32)), matrix_to_list(made)],
                                names=["id", "draw", "at", "value"])

        made = self._latent(df).select(F.col("id").cast("long"), "mean", "sd").mapInArrow(fn, schema)
        return made.select("id", "draw", F.posexplode("value").alias("k", "value"), "at") \
            .select("id", "draw", (F.col("at") + F.col("k")).alias("pos"), "value")


def lmc_emulator(train: DataFrame, **options) -> VectorEmulator:
    """LMC (ML-8/9/10): rank and number of inducing points by the size rule, PCA mixing, k-means
    inducing points, and an own kernel for each latent GP; ranks above what the PCA can give are padded."""
    from surrogata.operators.inducing import model_size

    mom = pca_ops.moments(train, "y")
    cum = np.cumsum(pca_ops.explained_ratio_for_count(mom))
    hit = np.flatnonzero(cum >= 0.90)
    r90 = int(hit[0]) + 1 if hit.size else cum.size + 1
    rank, m = model_size(mom.n, pca_ops.input_width(train, "x"), r90, mom.mean.size)
    possible = max(1, min(mom.n - 1, mom.mean.size, rank))
    return VectorEmulator(output_reducer=LinearReducer(possible), kernels="own", rank=rank, name="lmc",
                          cfg=sgp.GPConfig(inducing="kmeans", max_inducing=m), **options)
