"""ML-10: one latent GP an output, each with its own kernel, scale and noise.

All outputs share the rows, the inducing points and the passes: a pass holds every lengthscale
vector that any output asks for, and each output looks only at its own.  So the result is that of
separate fits at the price of one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from surrogata.functions.kernels import get_kernel
from surrogata.operators import sgp
from surrogata.operators.arrowutil import list_to_matrix, matrix_to_list
from surrogata.operators.blas import single_thread_blas
from surrogata.operators.partials import ensure_parallelism


class _Passes:
    """Scores of lengthscales for chosen outputs, so many candidates a pass as memory allows."""

    def __init__(self, df: DataFrame, x: str, y: str, Z: np.ndarray, cfg: "sgp.GPConfig"):
        self.df, self.x, self.y, self.Z, self.cfg = df, x, y, Z, cfg
        self.kern = get_kernel(cfg.kernel)
        self.passes = 0

    def run(self, wanted: list[tuple[np.ndarray, float, list[int] | None]]):
        """(ls, multiplier, outputs or all) -> (which, output, score, state maker) one by one."""
        step = max(1, sgp.PASS_DOUBLES // len(self.Z) ** 2)
        for low in range(0, len(wanted), step):
            yield from self._pass(wanted[low:low + step], low)

    def _pass(self, wanted, low):
        cfg, m = self.cfg, len(self.Z)
        jitter = sgp.JITTER if cfg.jitter is None else cfg.jitter
        whiten = [sgp._whitener(self.kern(self.Z, self.Z, ls), jitter) for ls, _, _ in wanted]
        st = sgp._stats_pass(self.df, self.x, self.y, self.Z, [w[0] for w in wanted], whiten, cfg.kernel)
        self.passes += 1
        n = int(round(st["n"][0]))
        p = st["ysum"].size
        ybar = st["ysum"] / n
        yyc = st["yy"] - n * ybar ** 2
        var = np.where(yyc > 0, yyc / n, 1.0)
        for c, (ls, mu, outputs) in enumerate(wanted):
            own = list(range(p)) if outputs is None else outputs
            bw = st[f"b{c}"].reshape(m, p) - np.outer(st[f"k{c}"], ybar)
            a, G, beta, gamma = sgp._decompose(whiten[c], st[f"phi{c}"].reshape(m, m), bw)
            s2, sg, bound = sgp._best_scale_noise(a, (gamma / var)[:, own], (yyc / var)[own], n, cfg)
            for k, t in enumerate(own):
                b = float(bound[k] - 0.5 * n * math.log(var[t]))

                def state(a=a, G=G, beta=beta, t=t, s=s2[k] * var[t], g=sg[k] * var[t], b=b, ls=ls, mu=mu):
                    return sgp.GPState(cfg.kernel, self.Z, ls, G, a, beta[:, [t]], np.array([s]), np.array([g]),
                                       ybar[[t]], n, b, float(mu), mode=cfg.inducing)
                yield low + c, t, b + sgp.log_prior(ls, n, cfg), state


def fit_each(df: DataFrame, x: str = "x", y: str = "y", cfg: "sgp.GPConfig | None" = None,
             Z: np.ndarray | None = None) -> list["sgp.GPState"]:
    """A fitted state for every output of an array column."""
    cfg = cfg or sgp.GPConfig()
    single_thread_blas()
    keep = [c for c in ("id",) if c in df.columns]
    df = ensure_parallelism(df.select(*keep, x, y)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, lo, hi = sgp._range_stats(df, x)
        if n == 0:
            raise ValueError("cannot fit a GP on an empty table")
        base = sgp.initial_lengthscale(n, lo, hi, cfg.lengthscale_init)
        mode = "given" if Z is not None else cfg.inducing
        Z = sgp.choose_inducing(df, x, n, cfg) if Z is None else Z
        states = _search(_Passes(df, x, y, Z, cfg), base, cfg)
        for s in states:
            s.mode = mode
        return states
    finally:
        df.unpersist()


def _search(passes: _Passes, base: np.ndarray, cfg) -> list["sgp.GPState"]:
    best: dict[int, tuple] = {}

    def consider(wanted) -> dict[int, dict[int, float]]:
        scores: dict[int, dict[int, float]] = {}
        for which, t, score, state in passes.run(wanted):
            scores.setdefault(t, {})[which] = score
            if t not in best or score > best[t][0]:
                best[t] = (score, state())
        return scores

    def together(proposals: dict[int, list]) -> tuple[list, dict]:
        """One candidate a distinct vector, with the outputs that ask for it."""
        at, wanted = {}, []
        for t, own in proposals.items():
            for ls, mu in own:
                k = at.setdefault((ls.tobytes(), mu), len(wanted))
                if k == len(wanted):
                    wanted.append((ls, mu, []))
                wanted[k][2].append(t)
        return wanted, at

    consider([(base * mu, mu, None) for mu in cfg.multipliers])
    for rnd in range(cfg.refine_rounds):
        ratio = 2.0 ** (0.5 ** (rnd + 1))
        proposals = {}
        for t, (_, state) in best.items():
            mu = state.multiplier
            proposals[t] = [(base * v, v) for v in (mu / ratio, mu / math.sqrt(ratio), mu * math.sqrt(ratio), mu * ratio)]
        consider(together(proposals)[0])
    groups = np.array_split(np.arange(base.size), min(base.size, cfg.ard_groups or base.size))
    step = {t: 2.0 for t in best}
    combined: dict[int, np.ndarray] = {}
    for rnd in range(cfg.ard_rounds):
        before = {t: b for t, b in best.items()}
        proposals, moves = {}, {}
        for t, (_, state) in before.items():
            own = []
            for g in groups:
                for f in (1.0 / step[t], step[t]):
                    ls = state.lengthscale.copy()
                    ls[g] *= f
                    own.append((ls, state.multiplier))
                    moves[t, ls.tobytes()] = (g, f)
            if t in combined:
                own.append((combined.pop(t), state.multiplier))
            proposals[t] = own
        wanted, _ = together(proposals)
        scores = consider(wanted)
        for t, (score, state) in before.items():
            gains = sorted(((s, k) for k, s in scores[t].items()
                            if s > score and (t, wanted[k][0].tobytes()) in moves), reverse=True)
            if not gains:
                step[t] = math.sqrt(step[t])
            if len(gains) > 1:
                ls, done = state.lengthscale.copy(), set()
                for _, k in gains:
                    g, f = moves[t, wanted[k][0].tobytes()]
                    if int(g[0]) not in done:
                        ls[g] *= f
                        done.add(int(g[0]))
                combined[t] = ls
    return [best[t][1] for t in sorted(best)]


def predict_each(df: DataFrame, states: list["sgp.GPState"], x: str = "x", keep: list[str] | None = None,
                 z: float = 1.96) -> DataFrame:
    """Array columns mean, sd, lower, upper, an entry an output; a narrow map that evaluates each
    distinct kernel once a batch."""
    keep = keep or [c for c in df.columns if c != x]
    sel = df.select(*keep, x)
    kinds = T.ArrayType(T.DoubleType())
    schema = T.StructType([f for f in sel.schema.fields if f.name in keep]
                          + [T.StructField(c, kinds) for c in ("mean", "sd", "lower", "upper")])
    by_kernel: dict[bytes, list[int]] = {}
    for t, s in enumerate(states):
        by_kernel.setdefault(s.lengthscale.tobytes(), []).append(t)
    groups, zz, p = list(by_kernel.values()), float(z), len(states)

    def fn(batches):
        single_thread_blas()
        weights = [s.weights() for s in states]
        for rb in batches:
            if not rb.num_rows:
                continue
            X = list_to_matrix(rb.column(len(keep)))
            mean, sd = np.empty((len(X), p)), np.empty((len(X), p))
            for low in range(0, len(X), sgp.STATS_ROWS):
                rows = slice(low, low + sgp.STATS_ROWS)
                for own in groups:
                    first = states[own[0]]
                    Q = get_kernel(first.kernel)(X[rows], first.Z, first.lengthscale) @ first.G.T
                    for t in own:
                        (W, U), s = weights[t], states[t]
                        mean[rows, t] = s.ybar[0] + (Q @ W)[:, 0]
                        sd[rows, t] = np.sqrt(s.s2[0] * np.clip(1.0 - (Q * Q) @ U, 0.0, None)[:, 0] + s.sigma2[0])
            yield pa.RecordBatch.from_arrays(
                [rb.column(i) for i in range(len(keep))]
                + [matrix_to_list(M) for M in (mean, sd, mean - zz * sd, mean + zz * sd)], names=schema.names)

    return sel.mapInArrow(fn, schema)
