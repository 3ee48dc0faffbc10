"""GP-1..GP-8: inducing-point Gaussian process regression as additive statistics.

Collapsed variational bound (Titsias 2009) in map-reduce form (Gal, van der
Wilk & Rasmussen 2014).  For a kernel ``s2 * k1`` with unit-scale ``k1`` the
statistics over training rows are sums::

    Phi1 = sum k1(Z,x) k1(Z,x)^T   (m x m)      b1 = sum k1(Z,x) y^T   (m x p)
    ksum = sum k1(Z,x)             (m)          n, sum y, sum y^2      (p)

They are computed in one data pass for every lengthscale candidate at once
(``mapInArrow`` + grouped partial sums).  Output scale ``s2`` and noise
``sigma2`` only enter on the driver: after one eigen-decomposition per
candidate, ``A1 = L1^-1 Phi1 L1^-T = V diag(a) V^T``, the bound of every
(s2, sigma2) pair costs O(m p), so a dense grid is scored for free and each
output (task) gets its own scale and noise (GP-8) under one shared kernel.

With the inducing set equal to the training inputs the bound is the exact log
marginal likelihood and the predictions are the exact GP's.

Prediction is a narrow batch map with the small state broadcast in the
closure: ``q = G k1(Z, x*)`` with ``G = V^T L1^-1``; mean = ybar + q W,
var = s2 (1 - q^2 U) + sigma2.  No shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surrogata.functions.kernels import get_kernel
from surrogata.operators.blas import driver_blas_for, single_thread_blas
from surrogata.operators.arrowutil import list_to_matrix, matrix_to_list, vector_or_scalar
from surrogata.operators.partials import emit, ensure_parallelism, num_partitions, reduce_partials

LOG2PI = math.log(2.0 * math.pi)

# Relative jitter on the inducing kernel matrix (escalated on failure) and the
# relative eigenvalue floor below which directions are numerically unresolved.
JITTER = 1e-6
EXACT_JITTER = 1e-8
EIG_FLOOR = 1e-10

# Hard cap for the inducing set kept on the driver (m x m doubles: 2048 -> 32 MB).
MAX_INDUCING = 2048
# Statistics of the candidates of one data pass (doubles; 16M -> 128 MB a task).
PASS_DOUBLES = 1 << 24
# Rows whose features a task holds at once.
STATS_ROWS = 1024
# Kernel values made at once, so that they stay in a core's cache.
CACHED_NUMBERS = 1 << 15
# Added to the standard deviation of padding points.
PADDING_SD = 1e-6


@dataclass
class GPConfig:
    kernel: str = "matern_5_2"
    inducing: str = "landmarks"     # all (exact) | landmarks | kmeans
    max_inducing: int = 512         # m for the sparse modes
    exact_cap: int = MAX_INDUCING   # training rows above which "all" raises
    blocks: bool = False            # "all" above exact_cap: dense algebra by blocks instead
    multipliers: tuple = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
    refine_rounds: int = 1
    ard_rounds: int = 0             # refinement rounds by groups of inputs after the multiplier search
    ard_groups: int | None = 8      # contiguous groups of inputs scaled together; None: one each
    input_rounds: int = 0           # exact mode: rounds of moves of one input each, after the groups
    lengthscale_init: str = "range"   # range: 3*range_j/n^(1/d);  mean_range: mean(range)/sqrt(d)
    prior: str | None = None        # None | "reference" (GP-4) | "lognormal" (GP-5)
    prior_weight: float = 0.25
    min_noise: float = 1e-4         # in units of the task's variance
    max_noise: float = 10.0
    seed: int = 42
    z: float = 2.0                  # interval multiplier for lower/upper
    jitter: float | None = None     # sparse modes; None: JITTER


@dataclass
class GPState:
    """Fitted model state; every array is bounded by m (inducing) and p (outputs)."""
    kernel: str
    Z: np.ndarray                   # m x d
    lengthscale: np.ndarray         # d
    G: np.ndarray                   # m x m
    a: np.ndarray                   # m
    beta: np.ndarray                # m x p
    s2: np.ndarray                  # p
    sigma2: np.ndarray              # p
    ybar: np.ndarray                # p
    n: int
    bound: float
    multiplier: float
    search: list = field(default_factory=list)
    mode: str = "given"             # all (exact) | landmarks | kmeans | given

    @property
    def p(self) -> int:
        return int(self.s2.size)

    def weights(self):
        r = self.s2 / self.sigma2                           # p
        ra = np.outer(self.a, r)                            # m x p
        W = self.beta * (r[None, :] / (1.0 + ra))           # m x p
        U = ra / (1.0 + ra)                                 # m x p
        return W, U

    def moments(self):
        """A function of inputs that gives means and variances."""
        W, U = self.weights()
        kern = get_kernel(self.kernel)

        def of(X):
            mean, var = np.empty((len(X), self.p)), np.empty((len(X), self.p))
            for low in range(0, len(X), STATS_ROWS):
                own = slice(low, low + STATS_ROWS)
                Q = kern(X[own], self.Z, self.lengthscale) @ self.G.T       # rows x m
                mean[own] = self.ybar[None, :] + Q @ W
                var[own] = (self.s2[None, :] * np.clip(1.0 - (Q * Q) @ U, 0.0, None)
                            + self.sigma2[None, :])
            return mean, var

        return of


# ----------------------------------------------------------------------------
# data passes


def _range_stats(df: DataFrame, x: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n and per-position min/max of the inputs (AGG-3), one aggregation."""
    long = df.select(F.posexplode(x).alias("pos", "v"))
    rows = long.groupBy("pos").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                   F.count("v").alias("n")).collect()
    rows.sort(key=lambda r: r["pos"])
    lo = np.array([r["lo"] for r in rows], dtype=float)
    hi = np.array([r["hi"] for r in rows], dtype=float)
    n = int(rows[0]["n"]) if rows else 0
    return n, lo, hi


def initial_lengthscale(n: int, lo: np.ndarray, hi: np.ndarray, how: str = "range") -> np.ndarray:
    """GP-6: (a) 3*range_j / n^(1/d), (b) mean(range)/sqrt(d) for every input."""
    rng = np.maximum(hi - lo, 1e-12)
    d = rng.size
    if how == "range":
        return 3.0 * rng / (max(n, 1) ** (1.0 / d))
    if how == "mean_range":
        return np.full(d, rng.mean() / math.sqrt(d))
    raise ValueError(f"unknown lengthscale_init {how!r}")


def _stats_pass(df: DataFrame, x: str, y: str, Z: np.ndarray, cands: list[np.ndarray],
                whiteners: list[np.ndarray], kernel: str) -> dict[str, np.ndarray]:
    """One data pass: whitened features phi = L1^-1 k1(Z, x) per candidate, then
    ``sum phi phi^T``, ``sum phi y^T``, ``sum phi`` (whitening before squaring keeps
    the condition number from being squared)."""
    kern_name = kernel
    C = len(cands)
    m = Z.shape[0]
    cands_arr = np.stack(cands)
    Li_arr = np.stack(whiteners)

    def fn(batches):
        single_thread_blas()
        kern = get_kernel(kern_name)
        phi = b = ks = features = None
        few = 1
        ysum = yy = None
        n = 0
        for X, Y in ((rb.column(0).slice(low, STATS_ROWS), rb.column(1).slice(low, STATS_ROWS))
                     for rb in batches for low in range(0, rb.num_rows, STATS_ROWS)):
            X, Y = list_to_matrix(X), vector_or_scalar(Y)
            if phi is None:
                p = Y.shape[1]
                phi = np.zeros((C, m, m))
                b = np.zeros((C, m, p))
                ks = np.zeros((C, m))
                ysum = np.zeros(p)
                yy = np.zeros(p)
                features = np.empty((2, STATS_ROWS, m))
                few = max(16, CACHED_NUMBERS // m)
            K, F_ = features[0][:len(X)], features[1][:len(X)]
            for c in range(C):
                for low in range(0, len(X), few):
                    K[low:low + few] = kern(X[low:low + few], Z, cands_arr[c])
                np.matmul(K, Li_arr[c].T, out=F_)               # whitened
                phi[c] += F_.T @ F_
                b[c] += F_.T @ Y
                ks[c] += F_.sum(axis=0)
            ysum += Y.sum(axis=0)
            yy += (Y * Y).sum(axis=0)
            n += X.shape[0]
        if n:
            stats = {"n": np.array([n]), "ysum": ysum, "yy": yy}
            for c in range(C):
                stats[f"phi{c}"] = phi[c]
                stats[f"b{c}"] = b[c]
                stats[f"k{c}"] = ks[c]
            yield emit(stats)

    sel = df.select(x, y)
    parts = sel.mapInArrow(fn, "key string, chunk int, vals array<double>")
    return reduce_partials(parts, num_partitions(sel))


# ----------------------------------------------------------------------------
# driver algebra (all m x m)


def _chol_jitter(K: np.ndarray, start: float = None) -> tuple[np.ndarray, float]:
    scale = float(np.mean(np.diag(K))) if K.size else 1.0
    start = JITTER if start is None else start
    ladder = [start] + [j for j in (1e-8, 1e-6, 1e-5, 1e-4, 1e-3, 1e-2) if j > start]
    for j in ladder:
        try:
            return np.linalg.cholesky(K + (j * scale) * np.eye(K.shape[0])), j
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("inducing kernel matrix is not positive definite")


def _tri_inv(L: np.ndarray) -> np.ndarray:
    return np.linalg.solve(L, np.eye(L.shape[0]))


def _whitener(Kzz1: np.ndarray, jitter: float = None) -> np.ndarray:
    L1, _ = _chol_jitter(Kzz1, jitter)
    return _tri_inv(L1)


def _decompose(Li: np.ndarray, A1: np.ndarray, bw: np.ndarray):
    """Eigen-basis of the whitened statistic A1 = sum phi phi^T; directions below the
    numerical floor are dropped.  Returns a, G = V^T L1^-1, beta = V^T bw, gamma."""
    A1 = 0.5 * (A1 + A1.T)
    a, V = np.linalg.eigh(A1)
    keep = a > EIG_FLOOR * max(float(a.max()), 1e-300)
    a = np.where(keep, a, 0.0)
    Vt = V.T.copy()
    Vt[~keep, :] = 0.0
    G = Vt @ Li
    beta = Vt @ bw
    gamma = np.zeros_like(beta)
    gamma[keep] = beta[keep] ** 2 / a[keep, None]
    return a, G, beta, gamma


def _grid_bound(a: np.ndarray, gamma: np.ndarray, yyc: np.ndarray, n: int,
                s2_grid: np.ndarray, sig_grid: np.ndarray) -> np.ndarray:
    """Bound for every (s2, sigma2, task): array (S, N, p).

    The data term ``y^T (Q + sigma2 I)^-1 y`` is written as
    ``(res + sum_i gamma_i / (1 + r a_i)) / sigma2`` with ``gamma_i = beta_i^2 / a_i``
    and ``res = yyc - sum gamma`` (energy outside the span), which has no
    cancellation between large terms when the noise is small.
    """
    S2, SG = np.meshgrid(s2_grid, sig_grid, indexing="ij")       # S x N
    r = (S2 / SG).ravel()                                        # SN
    ra = np.outer(r, a)                                          # SN x m
    logdet = np.log1p(ra).sum(axis=1)                            # SN
    inv = 1.0 / (1.0 + ra)                                       # SN x m
    res = np.clip(yyc - gamma.sum(axis=0), 0.0, None)            # p
    fit = res[None, :] + inv @ gamma                             # SN x p
    s2 = S2.ravel()[:, None]
    sg = SG.ravel()[:, None]
    gap = max(float(n) - float(a.sum()), 0.0)
    bound = (-0.5 * n * LOG2PI - 0.5 * logdet[:, None] - 0.5 * n * np.log(sg)
             - fit / (2.0 * sg) - s2 * gap / (2.0 * sg))
    return bound.reshape(S2.shape + (gamma.shape[1],))


def _task_bounds(a, gamma, yyc, n, S2: np.ndarray, SG: np.ndarray) -> np.ndarray:
    """Bound of every task t on its own (s2, sigma2) grid: S2, SG are (p, A, B)."""
    gap = max(float(n) - float(a.sum()), 0.0)
    res = np.clip(yyc - gamma.sum(axis=0), 0.0, None)                    # p
    r = S2 / SG                                                          # p A B
    ra = r[..., None] * a                                                # p A B m
    logdet = np.log1p(ra).sum(axis=-1)
    fit = res[:, None, None] + np.einsum("tabm,mt->tab", 1.0 / (1.0 + ra), gamma)
    return (-0.5 * n * LOG2PI - 0.5 * logdet - 0.5 * n * np.log(SG)
            - fit / (2.0 * SG) - S2 * gap / (2.0 * SG))


def _best_scale_noise(a, gamma, yyc, n, cfg: GPConfig):
    """Per task, maximise the bound over a log grid of (s2, sigma2), then refine
    twice on finer local grids (all tasks at once, each on its own grid)."""
    keep = a > 0
    a, gamma = a[keep], gamma[keep]                  # dropped directions contribute nothing
    p = gamma.shape[1]
    s2_grid = np.logspace(-3, 3, 41)
    sig_grid = np.logspace(math.log10(cfg.min_noise), math.log10(cfg.max_noise), 41)
    B = _grid_bound(a, gamma, yyc, n, s2_grid, sig_grid)                # A B p
    flat = B.reshape(-1, p).argmax(axis=0)
    i, j = np.unravel_index(flat, B.shape[:2])
    s2c, sgc = s2_grid[i], sig_grid[j]                                   # p
    width_s, width_n = 0.15, math.log10(sig_grid[1] / sig_grid[0])
    steps = np.linspace(-1.0, 1.0, 11)
    for _ in range(2):
        S2 = s2c[:, None, None] * (10.0 ** (width_s * steps))[None, :, None] * np.ones((1, 1, 11))
        SG = np.clip(sgc[:, None, None] * (10.0 ** (width_n * steps))[None, None, :] * np.ones((1, 11, 1)),
                     cfg.min_noise, cfg.max_noise)
        Bt = _task_bounds(a, gamma, yyc, n, S2, SG)                      # p 11 11
        k = Bt.reshape(p, -1).argmax(axis=1)
        s2c = S2.reshape(p, -1)[np.arange(p), k]
        sgc = SG.reshape(p, -1)[np.arange(p), k]
        width_s /= 10.0
        width_n /= 10.0
    best_b = _task_bounds(a, gamma, yyc, n, s2c[:, None, None], sgc[:, None, None])[:, 0, 0]
    return s2c, sgc, best_b


def log_prior(lengthscale: np.ndarray, n: int, cfg: GPConfig) -> float:
    """GP-4 reference-prior term or GP-5 log-normal lengthscale prior."""
    if cfg.prior is None:
        return 0.0
    d = lengthscale.size
    if cfg.prior == "reference":
        # a = 0.2, b = n^(-1/d) * (a + d), beta = 1/lengthscale.
        a_ = 0.2
        b_ = n ** (-1.0 / d) * (a_ + d)
        bet = 1.0 / lengthscale
        return cfg.prior_weight * ((a_ + 1.0) * np.log(bet).sum() - b_ * bet.sum())
    if cfg.prior == "lognormal":
        mu = math.log(d) / 2.0
        ll = np.log(lengthscale)
        return float(np.sum(-ll - 0.5 * LOG2PI - 0.5 * (ll - mu) ** 2))
    raise ValueError(f"unknown prior {cfg.prior!r}")


# ----------------------------------------------------------------------------
# inducing points


def choose_inducing(df: DataFrame, x: str, n: int, cfg: GPConfig, id_col: str | None = "id") -> np.ndarray:
    """Z on the driver; its size is bounded by ``max_inducing``/``exact_cap``."""
    mode = cfg.inducing
    if mode == "all":
        if n > min(cfg.exact_cap, MAX_INDUCING):
            raise ValueError(f"exact mode refuses n={n} > {min(cfg.exact_cap, MAX_INDUCING)}; use sparse")
        # bounded (n <= exact cap); ordered so Z does not depend on partitioning
        cols = [x] + ([id_col] if id_col and id_col in df.columns else [])
        rows = df.select(*cols).collect()
        rows.sort(key=(lambda r: r[1]) if len(cols) == 2 else (lambda r: tuple(r[0])))
        return np.array([r[0] for r in rows], dtype=float)
    if cfg.max_inducing > MAX_INDUCING:
        raise ValueError(f"at most {MAX_INDUCING} inducing points are supported, {cfg.max_inducing} asked for")
    m = min(cfg.max_inducing, n)
    if mode == "landmarks":
        from surrogata.operators.inducing import distinct_landmarks
        return distinct_landmarks(df, x, m, cfg.seed)
    if mode == "kmeans":
        from surrogata.operators.inducing import kmeans_centres, padding_points
        if n < cfg.max_inducing:
            # ML-9 / SET-3: all rows plus random points from the data mean/std (bounded: n < m)
            X = np.array(sorted(tuple(r[0]) for r in df.select(x).collect()), dtype=float)
            sd = X.std(0, ddof=1 if n > 1 else 0) + PADDING_SD
            pad = padding_points(X.mean(0), sd, df.sparkSession.range(cfg.max_inducing - n), seed=cfg.seed)
            return np.vstack([X, np.array([r["x"] for r in pad.orderBy("id").collect()])])
        return kmeans_centres(df, x, m, seed=cfg.seed)
    raise ValueError(f"unknown inducing mode {mode!r}")


# ----------------------------------------------------------------------------
# fit / predict


def fit(df: DataFrame, x: str = "x", y: str = "y", cfg: GPConfig | None = None,
        Z: np.ndarray | None = None) -> GPState:
    """GP-1 + GP-3 (+GP-4/5/6/8): search lengthscale multiplier, scale and noise."""
    cfg = cfg or GPConfig()
    single_thread_blas()
    if Z is None and cfg.inducing == "all":
        from surrogata.operators.exact import fit_exact
        return fit_exact(df, x, y, cfg)
    # several passes read the same rows: keep the projected input (recomputed
    # from lineage if an executor is lost)
    df = ensure_parallelism(df.select(*([c for c in ("id",) if c in df.columns] + [x, y])))
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fit(df, x, y, cfg, Z)
    finally:
        df.unpersist()


def _fit(df: DataFrame, x: str, y: str, cfg: GPConfig, Z: np.ndarray | None) -> GPState:
    n, lo, hi = _range_stats(df, x)
    if n == 0:
        raise ValueError("cannot fit a GP on an empty table")
    base = initial_lengthscale(n, lo, hi, cfg.lengthscale_init)
    jitter = JITTER if cfg.jitter is None else cfg.jitter
    mode = "given" if Z is not None else cfg.inducing
    if Z is None:
        Z = choose_inducing(df, x, n, cfg)
    if Z.ndim != 2 or Z.shape[1] != base.size:
        raise ValueError("inducing set must be (m, d) with d equal to the input width")
    kern = get_kernel(cfg.kernel)
    driver_blas_for(Z.shape[0])

    from concurrent.futures import ThreadPoolExecutor
    import os as _os
    workers = max(1, min(8, _os.cpu_count() or 1))

    def score(cands: list[np.ndarray], mults: list[float], tag: str) -> list[tuple[float, GPState]]:
        """A data pass for every so many candidates as PASS_DOUBLES allows."""
        step = max(1, PASS_DOUBLES // Z.shape[0] ** 2)
        return [r for k in range(0, len(cands), step)
                for r in score_pass(cands[k:k + step], mults[k:k + step], tag)]

    def score_pass(cands: list[np.ndarray], mults: list[float], tag: str) -> list[tuple[float, GPState]]:
        """One data pass for all candidates; every (scale, noise) pair scored on the driver.

        The per-candidate m x m algebra runs on a small thread pool (LAPACK releases
        the GIL; the executors are idle at this point)."""
        with ThreadPoolExecutor(workers) as pool:
            whiten = list(pool.map(lambda ls: _whitener(kern(Z, Z, ls), jitter), cands))
        st = _stats_pass(df, x, y, Z, cands, whiten, cfg.kernel)
        nn = int(round(st["n"][0]))
        p = st["ysum"].size
        ybar = st["ysum"] / nn
        yyc = st["yy"] - nn * ybar ** 2
        m = Z.shape[0]

        def one(c):
            ls = cands[c]
            A1 = st[f"phi{c}"].reshape(m, m)
            bw = st[f"b{c}"].reshape(m, p) - np.outer(st[f"k{c}"], ybar)
            a, G, beta, gamma = _decompose(whiten[c], A1, bw)
            # scale and noise are searched in units of each task's variance
            var = np.where(yyc > 0, yyc / nn, 1.0)
            s2, sg, bnd = _best_scale_noise(a, gamma / var, yyc / var, nn, cfg)
            s2, sg, bnd = s2 * var, sg * var, bnd - 0.5 * nn * np.log(var)
            sc = float(bnd.sum()) + log_prior(ls, nn, cfg)
            return sc, GPState(cfg.kernel, Z, ls, G, a, beta, s2, sg, ybar, nn, float(bnd.sum()),
                               float(mults[c]))

        with ThreadPoolExecutor(workers) as pool:
            out = list(pool.map(one, range(len(cands))))
        for (sc, stt), mu in zip(out, mults):
            search.append({"stage": tag, "multiplier": float(mu), "bound": stt.bound, "score": sc})
        return out

    search: list = []
    best = None
    mults = list(cfg.multipliers)
    for rnd in range(1 + cfg.refine_rounds):
        for sc, stt in score([base * mu for mu in mults], mults, f"multiplier{rnd}"):
            if best is None or sc > best[0]:
                best = (sc, stt)
        # refine around the best multiplier
        mu0 = best[1].multiplier
        ratio = 2.0 ** (0.5 ** (rnd + 1))
        mults = [mu0 / ratio, mu0 / math.sqrt(ratio), mu0 * math.sqrt(ratio), mu0 * ratio]

    # ARD refinement: per round, scale one group of inputs by 1/f or f (one pass for
    # all moves), keep the best, and try the combination of all improving moves next.
    d = base.size
    groups = np.array_split(np.arange(d), min(d, cfg.ard_groups or d)) if cfg.ard_rounds else []
    step = 2.0
    combined = None
    for rnd in range(cfg.ard_rounds):
        cur_score, cur = best
        cands, moves = [], []
        for g in groups:
            for f in (1.0 / step, step):
                ls = cur.lengthscale.copy()
                ls[g] *= f
                cands.append(ls)
                moves.append((g, f))
        if combined is not None:
            cands.append(combined)
            moves.append(None)
        scored = score(cands, [cur.multiplier] * len(cands), f"ard{rnd}")
        improving = [mv for (sc, _), mv in zip(scored, moves) if mv is not None and sc > cur_score]
        for sc, stt in scored:
            if sc > best[0]:
                best = (sc, stt)
        combined = None
        if len(improving) > 1:
            combined = cur.lengthscale.copy()
            done = set()
            for g, f in sorted(improving, key=lambda t: -[s for (s, _), mv in zip(scored, moves) if mv is t][0]):
                key = int(g[0])
                if key not in done:
                    combined[g] *= f
                    done.add(key)
        if not improving:
            step = math.sqrt(step)
    state = best[1]
    state.mode = mode
    state.search = search
    return state


def at_hyperparameters(df: DataFrame, Z: np.ndarray, lengthscale: np.ndarray, s2: float, sigma2: float,
                       x: str = "x", y: str = "y", kernel: str = "matern_5_2") -> GPState:
    """GP-1 without a search: the state at given inducing points, lengthscales, scale and noise, from
    one pass over the rows."""
    single_thread_blas()
    m = len(Z)
    white = _whitener(get_kernel(kernel)(Z, Z, lengthscale))
    st = _stats_pass(df, x, y, Z, [lengthscale], [white], kernel)
    n, p = int(round(st["n"][0])), st["ysum"].size
    ybar = st["ysum"] / n
    yyc = st["yy"] - n * ybar ** 2
    bw = st["b0"].reshape(m, p) - np.outer(st["k0"], ybar)
    a, G, beta, gamma = _decompose(white, st["phi0"].reshape(m, m), bw)
    bound = _grid_bound(a, gamma, yyc, n, np.array([s2]), np.array([sigma2]))[0, 0]
    return GPState(kernel, Z, lengthscale, G, a, beta, np.full(p, s2), np.full(p, sigma2), ybar, n,
                   float(bound.sum()), 1.0)


def predict(df: DataFrame, state: GPState, x: str = "x", keep: list[str] | None = None,
            z: float = 2.0, scalar: bool | None = None) -> DataFrame:
    """GP-2: mean, sd (noise included), lower = mean - z sd, upper = mean + z sd.

    A narrow ``mapInArrow``; the state rides in the task closure.  For one
    output the columns are DOUBLE, else ARRAY<DOUBLE> of length p.  Tasks of a state in blocks
    factor its matrix themselves, so there are no more of them than run at once.
    """
    keep = keep or [c for c in df.columns if c != x]
    if scalar is None:
        scalar = state.p == 1
    in_cols = keep + [x]
    sel = df.select(*in_cols)
    if not isinstance(state, GPState):
        sel = sel.coalesce(sel.sparkSession.sparkContext.defaultParallelism)
    fields = [f for f in sel.schema.fields if f.name in keep]
    vt = T.DoubleType() if scalar else T.ArrayType(T.DoubleType())
    out_schema = T.StructType(fields + [T.StructField(c, vt, True)
                                        for c in ("mean", "sd", "lower", "upper")])
    zz = float(z)

    def fn(batches):
        single_thread_blas()
        moments = state.moments()
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = list_to_matrix(rb.column(len(keep)))
            if X.shape[1] != state.Z.shape[1]:
                raise ValueError(f"input width {X.shape[1]} differs from the trained width {state.Z.shape[1]}")
            mean, var = moments(X)
            sd = np.sqrt(var)
            lo, hi = mean - zz * sd, mean + zz * sd
            cols = [rb.column(i) for i in range(len(keep))]
            for M in (mean, sd, lo, hi):
                cols.append(pa.array(M[:, 0]) if scalar else matrix_to_list(M))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in out_schema.fields])

    return sel.mapInArrow(fn, out_schema)


def dense_gp_reference(X: np.ndarray, y: np.ndarray, Xs: np.ndarray, ls: np.ndarray, s2: float,
                       sigma2: float, kernel: str = "matern_5_2"):
    """Closed-form exact GP with a constant mean equal to the training mean (test oracle)."""
    k = get_kernel(kernel)
    ybar = y.mean()
    K = s2 * k(X, X, ls) + sigma2 * np.eye(len(X))
    L = np.linalg.cholesky(K)
    alpha = np.linalg.solve(L.T, np.linalg.solve(L, y - ybar))
    Ks = s2 * k(Xs, X, ls)
    mean = ybar + Ks @ alpha
    v = np.linalg.solve(L, Ks.T)
    var = s2 - np.sum(v * v, axis=0) + sigma2
    lml = -0.5 * (y - ybar) @ alpha - np.log(np.diag(L)).sum() - 0.5 * len(X) * LOG2PI
    return mean, var, lml
