"""GP-1/GP-3 with the training rows as inducing points: the exact GP, one lengthscale an input.

Up to ``sgp.MAX_INDUCING`` rows (more with ``cfg.blocks``, see blocks.py) are fetched once and shared
with the tasks; every task scores whole
candidates by dense algebra, so a candidate is never an n x n matrix in a shuffle.  What comes back
is a score a candidate, or for the winner its hyper-parameters.

Lengthscales are searched one input at a time, all inputs in one batch: a task keeps the matrix of
scaled squared distances and a move changes it by one input's part (n^2 work, whatever d is).  A
move's score holds the noise ratio and takes the best scale in closed form (one Cholesky); moves
that help are put together from the best on.  Each stage's winner is then scored over all scales
and noises, and never replaces a better one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from surrogata.functions.kernels import kernel_of_sqdist, scaled_sqdist
from surrogata.operators import sgp
from surrogata.operators.blas import single_thread_blas

SHARED_BYTES = 1 << 28     # training rows that are sent to the tasks


class ExactSearch:
    """Scores of lengthscales on fixed training rows."""

    def __init__(self, spark, X: np.ndarray, Y: np.ndarray, cfg: "sgp.GPConfig"):
        if X.nbytes + Y.nbytes > SHARED_BYTES:
            raise ValueError(f"training rows of {X.nbytes + Y.nbytes} bytes; at most {SHARED_BYTES} are shared")
        self.spark, self.X, self.Y, self.cfg = spark, X, Y, cfg
        self.rows = spark.sparkContext.broadcast((X, Y - Y.mean(axis=0)))
        self.tasks = spark.sparkContext.defaultParallelism

    def close(self) -> None:
        self.rows.destroy()

    def _map(self, items: list, score) -> dict[int, list[float]]:
        """``score(X, Y, item)`` of every item, items dealt to the tasks."""
        parts = min(len(items), 4 * self.tasks)
        rows = self.rows

        def fn(batches):
            single_thread_blas()
            X, Y = rows.value
            for rb in batches:
                at = rb.column(0).to_pylist()
                out = [score(X, Y, items[i]) for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(out, pa.list_(pa.float64()))],
                                                 ["i", "out"])

        dealt = self.spark.range(0, len(items), 1, parts).toDF("i")
        return {r["i"]: r["out"] for r in dealt.mapInArrow(fn, "i long, out array<double>").collect()}

    def quick(self, candidates: list[np.ndarray], ratios: np.ndarray) -> list[tuple[float, float]]:
        """(score, noise-to-scale ratio) of each candidate: every output takes the best of the given
        ratios and its best scale in closed form; the ratio told is the first output's."""
        cfg = self.cfg

        def score(X, Y, ls):
            K = kernel_of_sqdist(cfg.kernel, scaled_sqdist(X, X, ls))
            each = np.stack([ratio_scores(K, Y, rho) for rho in ratios])
            return [float(each.max(axis=0).sum()) + sgp.log_prior(ls, len(X), cfg), float(ratios[each[:, 0].argmax()])]

        out = self._map(candidates, score)
        return [tuple(out[i]) for i in range(len(candidates))]

    def full(self, ls: np.ndarray) -> tuple[float, float]:
        """(score, bound) with the best scale and noise of every output."""
        a, _, gamma, yyc = spectrum(self.X, self.Y - self.Y.mean(axis=0), ls, self.cfg)
        bound, _, _ = best_hyper(a, gamma, yyc, len(self.X), self.cfg)
        return bound + sgp.log_prior(ls, len(self.X), self.cfg), bound

    def state(self, ls: np.ndarray, multiplier: float) -> "sgp.GPState":
        return state_of(self.X, self.Y, ls, multiplier, self.cfg)

    def moves(self, base: np.ndarray, ratios: np.ndarray, factors: list[float]) -> np.ndarray:
        """(inputs x factors) scores of scaling one lengthscale; ratios as in ``quick``."""
        cfg, d = self.cfg, base.size

        def score(X, Y, inputs):
            sq, out = scaled_sqdist(X, X, base), []
            for j in inputs:
                v = X[:, j] / base[j]
                part = (v[:, None] - v[None, :]) ** 2
                for f in factors:
                    moved = np.maximum(sq + (1.0 / f ** 2 - 1.0) * part, 0.0)
                    K = kernel_of_sqdist(cfg.kernel, moved)
                    ls = base.copy()
                    ls[j] *= f
                    each = np.stack([ratio_scores(K, Y, rho) for rho in ratios])
                    out.append(float(each.max(axis=0).sum()) + sgp.log_prior(ls, len(X), cfg))
            return out

        per = max(1, math.ceil(d / (4 * self.tasks)))
        items = [list(range(s, min(d, s + per))) for s in range(0, d, per)]
        out = self._map(items, score)
        return np.concatenate([np.array(out[i]).reshape(-1, len(factors)) for i in range(len(items))])


def ratio_scores(K: np.ndarray, Y: np.ndarray, ratio: float) -> np.ndarray:
    """Log marginal likelihood of each output at a noise-to-scale ratio and its best scale, from one
    Cholesky factor of K bordered by the outputs, whose last rows are the whitened outputs."""
    n, p = len(K), Y.shape[1]
    level = ratio + sgp.EXACT_JITTER
    M = np.empty((n + p, n + p))
    M[:n, :n], M[:n, n:], M[n:, :n] = K, Y, Y.T
    M[np.arange(n), np.arange(n)] += level
    M[n:, n:] = np.eye(p) * ((Y * Y).sum() / level + 1.0) * 2.0
    try:
        L = np.linalg.cholesky(M)
    except np.linalg.LinAlgError:
        return np.full(p, -math.inf)
    fit = (L[n:, :n] ** 2).sum(axis=1)
    return (-0.5 * n * np.log(np.maximum(fit / n, 1e-300)) - np.log(np.diag(L)[:n]).sum()
            - 0.5 * n * (1.0 + sgp.LOG2PI))


def spectrum(X: np.ndarray, Y: np.ndarray, ls: np.ndarray, cfg):
    """(eigenvalues of the kernel matrix, vectors, energies of the outputs along them, their sums);
    directions below the numerical floor have eigenvalue 0."""
    a, V = np.linalg.eigh(kernel_of_sqdist(cfg.kernel, scaled_sqdist(X, X, ls)))
    a = np.where(a > sgp.EIG_FLOOR * max(float(a.max()), 1e-300), a, 0.0)
    gamma = (V.T @ Y) ** 2
    gamma[a == 0] = 0.0
    return a, V, gamma, (Y * Y).sum(axis=0)


def best_hyper(a, gamma, yyc, n: int, cfg):
    """(bound, scales, noises), searched in units of each output's variance."""
    var = np.where(yyc > 0, yyc / n, 1.0)
    s2, sg, bound = sgp._best_scale_noise(a, gamma / var, yyc / var, n, cfg)
    return float((bound - 0.5 * n * np.log(var)).sum()), s2 * var, sg * var


def state_of(X, Y, ls, multiplier, cfg) -> "sgp.GPState":
    """The fitted state at the lengthscales; its prediction is the exact GP's."""
    ybar = Y.mean(axis=0)
    a, V, gamma, yyc = spectrum(X, Y - ybar, ls, cfg)
    bound, s2, sg = best_hyper(a, gamma, yyc, len(X), cfg)
    keep = a > 0
    G = np.zeros_like(V)
    G[keep] = V.T[keep] / np.sqrt(a[keep])[:, None]
    beta = np.sqrt(a)[:, None] * (V.T @ (Y - ybar))
    return sgp.GPState(cfg.kernel, X, ls, G, a, beta, s2, sg, ybar, len(X), bound, float(multiplier), mode="all")


def fit_exact(df: DataFrame, x: str, y: str, cfg: "sgp.GPConfig") -> "sgp.GPState":
    """Search by multiplier, by blocks of inputs, then input by input; no step lowers the score."""
    cap = min(cfg.exact_cap, sgp.MAX_INDUCING)
    cols = [x, y] + (["id"] if "id" in df.columns else [])
    rows = df.select(*cols).limit(cap + 1).collect()
    if not rows:
        raise ValueError("cannot fit a GP on an empty table")
    if len(rows) > cap and not cfg.blocks:
        raise ValueError(f"exact mode refuses more than {cap} training rows; use sparse")
    if len(rows) > cap:
        from surrogata.operators import blocks
        rows = None
        X, Y = blocks.all_rows(df, x, y)
        kind = blocks.BlockSearch
    else:
        rows.sort(key=(lambda r: r[2]) if len(cols) == 3 else (lambda r: tuple(r[0])))
        X = np.array([r[0] for r in rows], float)
        Y = np.array([np.atleast_1d(r[1]) for r in rows], float)
        kind = ExactSearch
    n, base = len(X), sgp.initial_lengthscale(len(X), X.min(0), X.max(0), cfg.lengthscale_init)
    search = kind(df.sparkSession, X, Y, cfg)
    try:
        walk = _Walk(search, base)
        mults = list(cfg.multipliers)
        for rnd in range(1 + cfg.refine_rounds):
            walk.consider([base * mu for mu in mults], f"multiplier{rnd}", mults)
            ratio = 2.0 ** (0.5 ** (rnd + 1))
            mu = walk.multiplier
            mults = [mu / ratio, mu / math.sqrt(ratio), mu * math.sqrt(ratio), mu * ratio]
        walk.settle("multiplier")
        _block_rounds(walk, base.size, cfg)
        walk.settle("ard")
        _input_rounds(walk, cfg)
        walk.settle("input")
        state = search.state(walk.settled, walk.multiplier)
        state.search = walk.log
        return state
    finally:
        search.close()


class _Walk:
    """The best lengthscales so far.  Candidates are compared by quick scores; at the end of a stage its
    winner is scored in full and goes on only if it is no worse than the stage before."""

    def __init__(self, search: ExactSearch, base: np.ndarray):
        self.search, self.ls, self.score, self.multiplier = search, base, -math.inf, 1.0
        self.single = search.Y.shape[1] == 1
        self.rho: float | None = None
        self.settled, self.full_score = base, -math.inf
        self.log: list = []

    def ratios(self) -> np.ndarray:
        """Three around the known one; all magnitudes where none is known or outputs have their own."""
        if self.rho is None or not self.single:
            return np.logspace(-6, 1, 8)
        return self.rho * np.array([0.25, 1.0, 4.0])

    def consider(self, candidates: list, stage: str, multipliers: list | None = None) -> list[float]:
        scored = self.search.quick(candidates, self.ratios())
        for k, ((score, rho), ls) in enumerate(zip(scored, candidates)):
            mu = multipliers[k] if multipliers else self.multiplier
            self.log.append({"stage": stage, "multiplier": float(mu), "score": score})
            if score > self.score:
                self.score, self.ls, self.multiplier, self.rho = score, ls, mu, rho
        return [s for s, _ in scored]

    def settle(self, stage: str) -> None:
        if self.full_score > -math.inf and self.ls is self.settled:
            return
        score, bound = self.search.full(self.ls)
        self.log.append({"stage": f"{stage}-full", "multiplier": float(self.multiplier), "bound": bound,
                         "score": score})
        if score >= self.full_score:
            self.settled, self.full_score = self.ls, score
        else:
            self.ls = self.settled


def _block_rounds(walk: _Walk, d: int, cfg) -> None:
    """Moves of contiguous groups of inputs, and of all that helped together."""
    groups = np.array_split(np.arange(d), min(d, cfg.ard_groups or d)) if cfg.ard_rounds else []
    step, combined = 2.0, None
    for rnd in range(cfg.ard_rounds):
        before, current = walk.score, walk.ls
        candidates, parts = [], []
        for g in groups:
            for f in (1.0 / step, step):
                ls = current.copy()
                ls[g] *= f
                candidates.append(ls)
                parts.append((g, f))
        scores = walk.consider(candidates + ([combined] if combined is not None else []), f"ard{rnd}")
        gains = sorted(((s, k) for k, s in enumerate(scores[:len(parts)]) if s > before), reverse=True)
        combined, done = None, set()
        if len(gains) > 1:
            combined = current.copy()
            for _, k in gains:
                g, f = parts[k]
                if int(g[0]) not in done:
                    combined[g] *= f
                    done.add(int(g[0]))
        if not gains:
            step = math.sqrt(step)


def _input_rounds(walk: _Walk, cfg) -> None:
    """All single-input moves in one batch a round, then the 1, 2, 4, ... best of them together."""
    step = 3.0
    for rnd in range(cfg.input_rounds):
        before, current = walk.score, walk.ls
        factors = [1.0 / step, step]
        known = np.array([walk.rho]) if walk.single else walk.ratios()
        scores = walk.search.moves(current, known, factors)
        top = scores.argmax(axis=1)
        gain = scores.max(axis=1) - before
        order = [j for j in np.argsort(-gain, kind="stable") if gain[j] > 0]
        candidates = []
        for size in sorted({min(len(order), 1 << k) for k in range(len(order).bit_length() + 1)} - {0}):
            for damp in (1.0, 0.5):
                ls = current.copy()
                for j in order[:size]:
                    ls[j] *= factors[top[j]] ** damp
                candidates.append(ls)
        if candidates:
            walk.consider(candidates, f"input{rnd}")
        if walk.score <= before + 1e-4 * abs(before):
            if step < 1.2:
                break
            step = math.sqrt(step)
