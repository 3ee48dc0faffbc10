"""ML-5 / ML-6: kernel PCA by the Nystrom method, and its ridge pre-image.

Landmarks Z (m rows, hash-sampled, bounded) define features
``phi(x) = Kzz^(-1/2) k(Z, x)``; kernel PCA is then the centred linear PCA of
phi, computed from per-partition sums (``sum phi``, ``sum phi phi^T``) — the
n x n kernel matrix is never formed.  With every row a landmark the scores are
exactly those of kernel PCA (up to sign).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surrogata.operators.arrowutil import list_to_matrix
from surrogata.operators.blas import single_thread_blas
from surrogata.operators.inducing import distinct_landmarks
from surrogata.operators.partials import emit, num_partitions, reduce_partials
from surrogata.operators.pca import _map_vectors


def make_kernel(name: str, gamma: float | None, degree: int = 3, coef0: float = 1.0):
    """Kernels of ML-5 with the usual defaults (gamma = 1/d when None)."""
    def k(A, B):
        g = gamma if gamma is not None else 1.0 / A.shape[1]
        if name == "linear":
            return A @ B.T
        if name == "poly":
            return (g * (A @ B.T) + coef0) ** degree
        if name == "rbf":
            aa = (A * A).sum(1)[:, None]
            bb = (B * B).sum(1)[None, :]
            return np.exp(-g * np.maximum(aa + bb - 2 * A @ B.T, 0.0))
        if name == "sigmoid":
            return np.tanh(g * (A @ B.T) + coef0)
        if name == "cosine":
            na = np.linalg.norm(A, axis=1)[:, None]
            nb = np.linalg.norm(B, axis=1)[None, :]
            return (A @ B.T) / np.maximum(na * nb, 1e-300)
        raise ValueError(f"unknown kernel {name!r}")
    return k


@dataclass
class KPCAModel:
    kernel: str
    gamma: float | None
    degree: int
    coef0: float
    Z: np.ndarray            # m x d landmarks
    P: np.ndarray            # m x m, Kzz^(-1/2)
    mean: np.ndarray         # m, mean of phi
    components: np.ndarray   # k x m
    eigenvalues: np.ndarray  # k
    dual: np.ndarray | None = None       # pre-image ridge coefficients (m x d)
    latent_landmarks: np.ndarray | None = None

    def features(self, X):
        kf = make_kernel(self.kernel, self.gamma, self.degree, self.coef0)
        return kf(X, self.Z) @ self.P.T

    def transform_np(self, X):
        return (self.features(X) - self.mean) @ self.components.T


def fit_kpca(df: DataFrame, x: str = "x", n_components: int = 2, kernel: str = "rbf",
             gamma: float | None = None, degree: int = 3, coef0: float = 1.0, m: int = 256,
             seed: int = 42, fit_inverse: bool = True, alpha: float = 0.001) -> KPCAModel:
    """ML-5 fit; with ``fit_inverse`` also the ML-6 ridge pre-image map."""
    single_thread_blas()
    Z = distinct_landmarks(df, x, m, seed)
    kf = make_kernel(kernel, gamma, degree, coef0)
    Kzz = kf(Z, Z)
    w, U = np.linalg.eigh(0.5 * (Kzz + Kzz.T))
    keep = w > 1e-10 * max(w.max(), 1e-300)
    P = (U[:, keep] / np.sqrt(w[keep])) @ U[:, keep].T          # Kzz^(-1/2), pseudo-inverse root
    mm = Z.shape[0]

    def fn(batches):
        single_thread_blas()
        s = np.zeros(mm)
        ss = np.zeros((mm, mm))
        n = 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            Fm = kf(list_to_matrix(rb.column(0)), Z) @ P.T
            s += Fm.sum(0)
            ss += Fm.T @ Fm
            n += Fm.shape[0]
        if n:
            yield emit({"n": np.array([n]), "s": s, "ss": ss})

    sel = df.select(x)
    st = reduce_partials(sel.mapInArrow(fn, "key string, chunk int, vals array<double>"), num_partitions(sel))
    n = int(round(st["n"][0]))
    mean = st["s"] / n
    C = st["ss"].reshape(mm, mm) / n - np.outer(mean, mean)
    ev, V = np.linalg.eigh(0.5 * (C + C.T))
    order = np.argsort(ev)[::-1][:n_components]
    comps = V[:, order].T
    idx = np.argmax(np.abs(comps), axis=1)
    comps *= np.sign(comps[np.arange(comps.shape[0]), idx])[:, None]
    model = KPCAModel(kernel, gamma, degree, coef0, Z, P, mean, comps, np.clip(ev[order], 0, None))
    if fit_inverse:
        _fit_preimage(sel, model, alpha)
    return model


def _fit_preimage(sel: DataFrame, model: KPCAModel, alpha: float) -> None:
    """ML-6: kernel ridge from latent scores back to inputs, over all rows, with the landmarks'
    scores as centres: (sum k k^T + alpha K) B = sum k x^T.  With every row a landmark this is the
    ordinary kernel ridge."""
    Lz = model.transform_np(model.Z)
    kl = make_kernel(model.kernel, model.gamma, model.degree, model.coef0)
    m, d = model.Z.shape

    def fn(batches):
        single_thread_blas()
        kk, kx, seen = np.zeros((m, m)), np.zeros((m, d)), False
        for rb in batches:
            if rb.num_rows:
                X = list_to_matrix(rb.column(0))
                k = kl(model.transform_np(X), Lz)
                kk += k.T @ k
                kx += k.T @ X
                seen = True
        if seen:
            yield emit({"kk": kk, "kx": kx})

    st = reduce_partials(sel.mapInArrow(fn, "key string, chunk int, vals array<double>"), num_partitions(sel))
    lhs = st["kk"].reshape(m, m) + alpha * kl(Lz, Lz)
    model.dual = np.linalg.lstsq(lhs, st["kx"].reshape(m, d), rcond=None)[0]
    model.latent_landmarks = Lz


def transform(df: DataFrame, model: KPCAModel, x: str = "x", out: str = "z", keep=None) -> DataFrame:
    return _map_vectors(df, x, out, model.transform_np, keep)


def inverse_transform(df: DataFrame, model: KPCAModel, z: str = "z", out: str = "x_hat", keep=None) -> DataFrame:
    if model.dual is None:
        raise NotImplementedError("inverse transform needs fit_inverse=True")
    kl = make_kernel(model.kernel, model.gamma, model.degree, model.coef0)
    Lz, dual = model.latent_landmarks, model.dual
    return _map_vectors(df, z, out, lambda Zl: kl(Zl, Lz) @ dual, keep)
