"""GP-16: a GP with a linear trend, both fitted together (universal kriging on GP-1's statistics).

The basis columns [1, x] ride through the data pass as further outputs, so the sums
``sum phi h^T``, ``sum h h^T`` and ``sum h y^T`` border the GP's statistics.  For every ratio of scale
to noise the trend's generalised least squares, the noise and the bound follow on the driver; the
predictive variance has the part of the estimated trend.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surrogata.functions.kernels import get_kernel
from surrogata.operators import sgp
from surrogata.operators.arrowutil import list_to_matrix, matrix_to_list
from surrogata.operators.blas import single_thread_blas
from surrogata.operators.partials import PARTIAL_SCHEMA, emit, ensure_parallelism, num_partitions, reduce_partials


@dataclass
class UniversalState:
    """A fitted GP with trend: ``gp`` for the part beyond the trend, ``beta`` (1 + d, p) for the basis of
    centred, scaled inputs, and what the variance of the trend needs (an entry an output)."""
    gp: sgp.GPState
    beta: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    cross: np.ndarray              # m x q: features times basis
    shrink: np.ndarray             # m x p: r / (1 + r a)
    inverse: list                  # p of q x q

    def coefficients(self) -> np.ndarray:
        """(1 + d, p): intercept and slopes of the inputs as they are."""
        slopes = self.beta[1:] / self.scale[:, None]
        return np.vstack([self.beta[:1] - self.centre @ slopes, slopes])


def _basis(X: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(X), 1)), (X - centre) / scale])


def _products(df: DataFrame, column: str) -> tuple[int, np.ndarray]:
    """n and the sums of products of all entries of an array column."""
    sel = df.select(column)

    def fn(batches):
        single_thread_blas()
        n, acc = 0, None
        for rb in batches:
            if rb.num_rows:
                E = list_to_matrix(rb.column(0))
                acc = E.T @ E if acc is None else acc + E.T @ E
                n += len(E)
        if n:
            yield emit({"n": np.array([n]), "e": acc})

    st = reduce_partials(sel.mapInArrow(fn, PARTIAL_SCHEMA), num_partitions(sel))
    width = math.isqrt(st["e"].size)
    return int(round(st["n"][0])), st["e"].reshape(width, width)


def _profile(a, fy, fh, products, n: int, p: int, r: float):
    """(bound, noise, beta, inverse) of every output at one ratio of scale to noise."""
    shrink = (r / (1.0 + r * a))[:, None]
    hh = products[p:, p:] - fh.T @ (shrink * fh)
    hy = products[p:, :p] - fh.T @ (shrink * fy)
    yy = np.diag(products)[:p] - (fy * shrink * fy).sum(axis=0)
    inverse = np.linalg.pinv(0.5 * (hh + hh.T), hermitian=True)
    beta = inverse @ hy
    noise = np.maximum(yy - (hy * beta).sum(axis=0), 1e-300) / n
    gap = max(float(n) - float(a.sum()), 0.0)
    bound = (-0.5 * n * (sgp.LOG2PI + 1.0 + np.log(noise)) - 0.5 * np.log1p(r * a).sum() - 0.5 * r * gap)
    return bound, noise, beta, inverse


def _best_ratios(a, fy, fh, products, n: int, p: int):
    """Best ratio of every output: a grid over magnitudes, then two finer ones around each best."""
    ratios = np.logspace(-4, 7, 45)
    table = np.stack([_profile(a, fy, fh, products, n, p, r)[0] for r in ratios])
    best = ratios[table.argmax(axis=0)]
    width = math.log10(ratios[1] / ratios[0])
    for _ in range(2):
        for t in range(p):
            own = best[t] * 10.0 ** (width * np.linspace(-1, 1, 9))
            best[t] = own[int(np.argmax([_profile(a, fy[:, [t]], fh, products[np.ix_([t, *range(p, len(products))],
                                                                                     [t, *range(p, len(products))])],
                                                  n, 1, r)[0][0] for r in own]))]
        width /= 4.0
    return best


def fit_universal(df: DataFrame, x: str = "x", y: str = "y", cfg: sgp.GPConfig | None = None,
                  Z: np.ndarray | None = None) -> UniversalState:
    """Search of the lengthscales with the trend fitted anew for each candidate."""
    cfg = cfg or sgp.GPConfig()
    single_thread_blas()
    scalar = not isinstance(df.schema[y].dataType, T.ArrayType)
    outputs = F.array(F.col(y).cast("double")) if scalar else F.col(y).cast("array<double>")
    keep = [c for c in ("id",) if c in df.columns]
    rows = ensure_parallelism(df.select(*keep, x, outputs.alias("_y"))).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, lo, hi = sgp._range_stats(rows, x)
        if n == 0:
            raise ValueError("cannot fit a GP on an empty table")
        centre, scale = 0.5 * (lo + hi), np.where(hi > lo, 0.5 * (hi - lo), 1.0)
        p = len(rows.select("_y").first()[0])
        middle, half = (F.array(*[F.lit(float(v)) for v in c]) for c in (centre, scale))
        basis = F.zip_with(F.zip_with(x, middle, lambda v, c: v - c), half, lambda v, s: v / s)
        ext = rows.withColumn("_e", F.concat("_y", F.array(F.lit(1.0)), basis))
        _, products = _products(ext, "_e")
        Z = sgp.choose_inducing(rows, x, n, cfg) if Z is None else Z
        jitter = cfg.jitter if cfg.jitter is not None else sgp.EXACT_JITTER if cfg.inducing == "all" else sgp.JITTER
        kern, m = get_kernel(cfg.kernel), len(Z)
        best = None

        def consider(candidates):
            nonlocal best
            step = max(1, sgp.PASS_DOUBLES // m ** 2)
            for low in range(0, len(candidates), step):
                own = candidates[low:low + step]
                white = [sgp._whitener(kern(Z, Z, ls), jitter) for ls, _ in own]
                st = sgp._stats_pass(ext, x, "_e", Z, [ls for ls, _ in own], white, cfg.kernel)
                for c, (ls, mu) in enumerate(own):
                    a, G, f, _ = sgp._decompose(white[c], st[f"phi{c}"].reshape(m, m), st[f"b{c}"].reshape(m, -1))
                    ratios = _best_ratios(a, f[:, :p], f[:, p:], products, n, p)
                    each = [_profile(a, f[:, :p], f[:, p:], products, n, p, r) for r in ratios]
                    bound = float(sum(e[0][t] for t, e in enumerate(each)))
                    score = bound + sgp.log_prior(ls, n, cfg)
                    if best is None or score > best[0]:
                        best = (score, ls, mu, a, G, f, ratios, each, bound)

        base = sgp.initial_lengthscale(n, lo, hi, cfg.lengthscale_init)
        mults = list(cfg.multipliers)
        for rnd in range(1 + cfg.refine_rounds):
            consider([(base * v, v) for v in mults])
            ratio = 2.0 ** (0.5 ** (rnd + 1))
            mults = [best[2] / ratio, best[2] / math.sqrt(ratio), best[2] * math.sqrt(ratio), best[2] * ratio]
        groups = np.array_split(np.arange(base.size), min(base.size, cfg.ard_groups or base.size))
        step = 2.0
        for _ in range(cfg.ard_rounds):
            before, moves = best[0], []
            for g in groups:
                for factor in (1.0 / step, step):
                    ls = best[1].copy()
                    ls[g] *= factor
                    moves.append((ls, best[2]))
            consider(moves)
            if best[0] <= before:
                step = math.sqrt(step)
        _, ls, mu, a, G, f, ratios, each, bound = best
        noise = np.array([e[1][t] for t, e in enumerate(each)])
        beta = np.stack([e[2][:, t] for t, e in enumerate(each)], axis=1)
        shrink = ratios[None, :] / (1.0 + np.outer(a, ratios))
        gp = sgp.GPState(cfg.kernel, Z, ls, G, a, f[:, :p] - f[:, p:] @ beta, ratios * noise, noise, np.zeros(p), n,
                         bound, float(mu), mode=cfg.inducing)
        return UniversalState(gp, beta, centre, scale, f[:, p:], shrink, [e[3] for e in each])
    finally:
        rows.unpersist()


def predict_universal(df: DataFrame, state: UniversalState, x: str = "x", keep: list[str] | None = None,
                      z: float = 2.0, scalar: bool | None = None) -> DataFrame:
    """As sgp.predict, with the trend and the variance of its coefficients; a narrow map."""
    keep = keep or [c for c in df.columns if c != x]
    gp, zz = state.gp, float(z)
    scalar = gp.p == 1 if scalar is None else scalar
    sel = df.select(*keep, x)
    kind = T.DoubleType() if scalar else T.ArrayType(T.DoubleType())
    schema = T.StructType([f for f in sel.schema.fields if f.name in keep]
                          + [T.StructField(c, kind) for c in ("mean", "sd", "lower", "upper")])
    W, U = gp.weights()

    def fn(batches):
        single_thread_blas()
        kern = get_kernel(gp.kernel)
        for rb in batches:
            if not rb.num_rows:
                continue
            X = list_to_matrix(rb.column(len(keep)))
            Q, H = kern(X, gp.Z, gp.lengthscale) @ gp.G.T, _basis(X, state.centre, state.scale)
            mean = H @ state.beta + Q @ W
            var = gp.s2 * np.clip(1.0 - (Q * Q) @ U, 0.0, None) + gp.sigma2
            for t in range(gp.p):
                u = H - (Q * state.shrink[:, t]) @ state.cross
                var[:, t] += gp.sigma2[t] * np.einsum("ij,jk,ik->i", u, state.inverse[t], u)
            sd = np.sqrt(var)
            yield pa.RecordBatch.from_arrays(
                [rb.column(i) for i in range(len(keep))]
                + [pa.array(M[:, 0]) if scalar else matrix_to_list(M) for M in (mean, sd, mean - zz * sd, mean + zz * sd)],
                names=schema.names)

    return sel.mapInArrow(fn, schema)
