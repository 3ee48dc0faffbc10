"""ML-2/ML-3 for wide inputs: PCA without a d x d matrix.

Two ways, by the shape of the data; both give the count, components and scores of the Gram way:

* few rows (``n <= DUAL_LIMIT``): the n x n Gram matrix of the rows.  Rows are cut into slices of
  columns, a task sums the products of one slice, and the slices' matrices are added up.  The whole
  spectrum is known, so shares and 'mle' are exact.
* otherwise a block range finder: an orthonormal basis that grows by a block of directions at a
  time and is never started anew.  Each pass gives ``X^T X Q`` as sums and the R factor of the tall
  matrix ``X Q`` through a tree of small QR factors, whose singular values keep full precision.
  Passes go on until the variances of the wanted components settle.  Every pass reads the rows from
  their source: n x d numbers are neither kept nor shuffled, and a task holds a block of rows.

Counts by share come from the standardised data, components from the centred data, as for narrow
inputs; where both are the same, one basis serves for both.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surrogata.operators.arrowutil import list_to_matrix, matrix_blocks
from surrogata.operators.blas import single_thread_blas
from surrogata.operators.partials import PARTIAL_SCHEMA, emit, num_partitions, reduce_partials

DUAL_LIMIT = 2048          # rows up to which the n x n matrix is formed (32 MB)
SLICE = 2048               # columns of a slice
BLOCK = 32                 # directions added to the basis at once
SETTLED = 1e-9             # change of the shares, between two passes, that ends the passes


def column_moments(df: DataFrame, x: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n, mean and population standard deviation of every position, in one pass of partial sums of the
    differences to a row, which keep their digits where the mean is large."""
    sel = df.select(x)
    row = sel.first()
    if row is None:
        raise ValueError("PCA input is empty")
    origin = np.array(row[0], float)
    origin[~np.isfinite(origin)] = 0.0

    def fn(batches):
        n, s, ss = 0, np.zeros(origin.size), np.zeros(origin.size)
        for rb in batches:
            for X in matrix_blocks(rb.column(0)):
                X = X - origin
                s += X.sum(axis=0)
                X *= X
                ss += X.sum(axis=0)
                n += len(X)
        if n:
            yield emit({"n": np.array([n]), "s": s, "ss": ss})

    st = reduce_partials(sel.mapInArrow(fn, PARTIAL_SCHEMA), num_partitions(sel))
    n = int(round(st["n"][0]))
    shift = st["s"] / n
    return n, origin + shift, np.sqrt(np.maximum(st["ss"] / n - shift ** 2, 0.0))


def _columns_settled(mean: np.ndarray, sd: np.ndarray, tolerance: float = 0.01) -> bool:
    """AGG-5 on the moments."""
    return bool(np.all(np.abs(mean) <= tolerance) and np.all(np.abs(sd - 1.0) <= tolerance + 1e-5))


# ----------------------------------------------------------------------------
# few rows: the dual Gram matrix


def distinct_rows(df: DataFrame, x: str) -> DataFrame:
    """(h, x, w): the different vectors, each with its number of rows; h names a vector."""
    return df.groupBy(F.xxhash64(x).alias("h")).agg(F.first(x).alias("x"), F.count("*").alias("w"))


def dual_gram(rows: DataFrame, names: np.ndarray, mean: np.ndarray, scales: list[np.ndarray]) -> list[np.ndarray]:
    """Products of all pairs of centred rows, for each scaling, in the order of the names; a task holds
    one slice of columns of all rows."""
    d, count = mean.size, len(names)
    order = np.argsort(names)
    cuts = list(range(0, d, SLICE))
    pieces = F.array(*[F.struct(F.lit(k).alias("k"), F.slice("x", lo + 1, min(SLICE, d - lo)).alias("v"))
                       for k, lo in enumerate(cuts)])
    cut = rows.select("h", F.explode(pieces).alias("s")).select("h", "s.k", "s.v")
    dealt = cut.repartition(len(cuts), "k").sortWithinPartitions("k")

    def products(k, h, v):
        low = cuts[k]
        centred = np.empty((count, v.shape[1]))
        centred[order[np.searchsorted(names, h, sorter=order)]] = v
        centred -= mean[low:low + v.shape[1]]
        for scale in scales:
            S = centred / scale[low:low + v.shape[1]]
            yield S @ S.T

    def fn(batches):
        single_thread_blas()
        total, held, at = None, [], None

        def close():
            nonlocal total
            made = list(products(at, np.concatenate([a for a, _ in held]), np.vstack([b for _, b in held])))
            total = made if total is None else [a + b for a, b in zip(total, made)]

        for rb in batches:
            if not rb.num_rows:
                continue
            k, h = (rb.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(k))
            low = 0
            for to in ends.tolist():
                if at is not None and k[low] != at:
                    close()
                    held = []
                at = int(k[low])
                held.append((h[low:to], list_to_matrix(rb.column(2).slice(low, to - low))))
                low = to
        if held:
            close()
            yield emit({f"g{i}": g for i, g in enumerate(total)})

    st = reduce_partials(dealt.select("k", "h", "v").mapInArrow(fn, PARTIAL_SCHEMA), len(cuts))
    return [st[f"g{i}"].reshape(count, count) for i in range(len(scales))]


def _dual_spectrum(gram: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Variances in descending order and the matching combinations of weighted rows."""
    root = np.sqrt(weight)
    values, vectors = np.linalg.eigh(gram * root[:, None] * root[None, :] / max(n - 1, 1))
    order = np.argsort(values)[::-1]
    return np.clip(values[order], 0.0, None), vectors[:, order]


def _combined_rows(rows: DataFrame, names: np.ndarray, mean: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """combos^T times the centred rows (k x d), as sums of what each task's rows give."""
    order = np.argsort(names)
    k, d = combos.shape[1], mean.size

    def fn(batches):
        single_thread_blas()
        acc = None
        for rb in batches:
            if rb.num_rows:
                at = order[np.searchsorted(names, rb.column(0).to_numpy(zero_copy_only=False), sorter=order)]
                own = combos[at].T @ (list_to_matrix(rb.column(1)) - mean)
                acc = own if acc is None else acc + own
        if acc is not None:
            yield emit({"w": acc})

    sel = rows.select("h", "x")
    return reduce_partials(sel.mapInArrow(fn, PARTIAL_SCHEMA), num_partitions(sel))["w"].reshape(k, d)


def _signed(components: np.ndarray) -> np.ndarray:
    """The sign rule of all components: the loading of largest magnitude is positive."""
    top = components[np.arange(len(components)), np.argmax(np.abs(components), axis=1)]
    return components * np.where(top < 0, -1.0, 1.0)[:, None]


def fit_dual(df: DataFrame, x: str, n: int, mean: np.ndarray, sd: np.ndarray, choose):
    """(variances of all components, ratios on standardised data, k, components) by the n x n matrix;
    ``choose(variances, ratios)`` gives k."""
    rows = distinct_rows(df, x).persist()
    try:
        known = sorted((r["h"], r["w"]) for r in rows.select("h", "w").collect())      # at most DUAL_LIMIT
        names = np.array([h for h, _ in known], np.int64)
        weight = np.array([w for _, w in known], float)
        unit = np.ones_like(sd)
        scaled = np.where(sd > 0, sd, 1.0)
        if _columns_settled(mean, sd):
            [raw] = dual_gram(rows, names, mean, [unit])
            standard = raw
        else:
            raw, standard = dual_gram(rows, names, mean, [unit, scaled])
        variances, combos = _dual_spectrum(raw, weight, n)
        own = variances if standard is raw else _dual_spectrum(standard, weight, n)[0]
        ratios = own / own.sum() if own.sum() > 0 else own
        k = choose(variances, ratios)
        size = np.sqrt(np.maximum(variances[:k] * max(n - 1, 1), 1e-300))
        made = _combined_rows(rows, names, mean, combos[:, :k] * np.sqrt(weight)[:, None] / size)
        # components without variance are any unit vectors orthogonal to the others
        dead = variances[:k] <= 1e-12 * max(float(variances[0]), 1e-300)
        if dead.any():
            made[dead] = np.random.default_rng(0).standard_normal((int(dead.sum()), mean.size))
        q, r = np.linalg.qr(made.T)
        return variances, ratios, k, _signed((q * np.sign(np.diag(r))).T)
    finally:
        rows.unpersist()


# ----------------------------------------------------------------------------
# many rows: a basis that grows block by block


def _stacked_r(pdf: pd.DataFrame) -> pd.DataFrame:
    size = int(pdf["l"].iloc[0])
    r = np.linalg.qr(np.vstack([v.reshape(-1, size) for v in pdf["vals"]]), mode="r")
    return pd.DataFrame({"l": [size], "vals": [r.ravel()]})


def tall_r(factors: DataFrame, parts: int) -> np.ndarray:
    """R of a tall matrix from the R factors (l, vals) of its tasks: two levels, so that neither a
    group nor the driver stacks more than about the square root of their number."""
    salts = max(1, math.isqrt(max(parts, 1)))
    level = factors.withColumn("g", F.spark_partition_id() % salts).groupBy("g") \
        .applyInPandas(lambda p: _stacked_r(p.drop(columns=["g"])), "l int, vals array<double>")
    own = level.collect()                                         # salts rows of l x l
    size = own[0]["l"]
    return np.linalg.qr(np.vstack([np.array(r["vals"]).reshape(-1, size) for r in own]), mode="r")


class RowSpace:
    """Passes over the rows of one scaled, centred matrix X."""

    def __init__(self, df: DataFrame, x: str, mean: np.ndarray, scale: np.ndarray):
        self.sel, self.mean, self.scale = df.select(x), mean, scale
        self.parts = num_partitions(self.sel)

    def times(self, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(X^T X B, R of X B) in one pass."""
        mean, scale, d, l = self.mean, self.scale, *basis.shape
        spark = self.sel.sparkSession
        shared = spark.sparkContext.broadcast(basis)

        def fn(batches):
            single_thread_blas()
            acc, r = np.zeros((d, l)), np.zeros((0, l))
            for rb in batches:
                for X in matrix_blocks(rb.column(0)):
                    X = X - mean
                    X /= scale
                    Y = X @ shared.value
                    acc += X.T @ Y
                    r = np.linalg.qr(np.vstack([r, Y]), mode="r")
            if len(r):
                out = emit({"z": acc})
                yield out
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["r"]), pa.array([l], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))],
                    names=["key", "chunk", "vals"])

        made = self.sel.mapInArrow(fn, PARTIAL_SCHEMA).persist()
        try:
            z = reduce_partials(made.where("key = 'z'"), self.parts)["z"].reshape(d, l)
            r = tall_r(made.where("key = 'r'").select(F.col("chunk").alias("l"), "vals"), self.parts)
        finally:
            made.unpersist()
            shared.destroy()
        return z, r


def _orthonormal(new: np.ndarray, basis: np.ndarray | None) -> np.ndarray:
    """An orthonormal basis of the new directions outside the given basis (projected twice)."""
    for _ in range(2):
        if basis is not None:
            new = new - basis @ (basis.T @ new)
        new, _ = np.linalg.qr(new)
    return new


def grow_basis(space: RowSpace, n: int, total: float, enough, basis: np.ndarray | None = None,
               seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(basis, variances, rotation): the leading directions of X.

    ``enough(ratios)`` gives the number of components wanted if the known ones suffice, else None:
    then a block of directions that the basis lacks is added and the passes go on from there.
    """
    d = space.mean.size
    most = min(n, d)
    draw = np.random.default_rng(seed)
    if basis is None:
        basis = _orthonormal(draw.standard_normal((d, min(most, BLOCK))), None)
    before = None
    while True:
        z, r = space.times(basis)
        _, size, rotation = np.linalg.svd(r)
        variances = np.zeros(basis.shape[1])
        variances[:len(size)] = size ** 2 / max(n - 1, 1)
        ratios = variances / total if total > 0 else variances
        k = enough(ratios)
        full = basis.shape[1] >= most
        if k is not None and (k + BLOCK // 4 <= basis.shape[1] or full):
            now = np.cumsum(ratios)[:k]
            if full and before is not None or before is not None and len(before) == len(now) \
                    and np.abs(now - before).max() <= SETTLED:
                return basis, variances, rotation.T
            before = now
            basis = _orthonormal(z, None)
        elif full:
            return basis, variances, rotation.T
        else:
            before = None
            grown = _orthonormal(z, None)
            more = min(max(BLOCK, basis.shape[1] // 2), most - basis.shape[1])
            basis = np.hstack([grown, _orthonormal(draw.standard_normal((d, more)), grown)])


def fit_range(df: DataFrame, x: str, n: int, mean: np.ndarray, sd: np.ndarray, n_components):
    """(variances, ratios on standardised data, k, components) of the leading components by growing
    bases; ``n_components`` is a count or a share."""
    unit, scaled = np.ones_like(sd), np.where(sd > 0, sd, 1.0)
    total = float((sd ** 2).sum() * n / max(n - 1, 1))
    settled = _columns_settled(mean, sd)
    pop = float((sd > 0).sum() * n / max(n - 1, 1)) if not settled else total

    def enough(ratios):
        if isinstance(n_components, int):
            return n_components if len(ratios) >= n_components else None
        hit = np.flatnonzero(np.cumsum(ratios) > n_components)
        return int(hit[0]) + 1 if len(hit) else None

    standard = RowSpace(df, x, mean, unit if settled else scaled)
    basis, own, rotation = grow_basis(standard, n, pop, enough)
    ratios = own / pop if pop > 0 else own
    k = enough(ratios) or min(1, len(own))
    variances = own
    if not settled:
        raw = RowSpace(df, x, mean, unit)
        basis, variances, rotation = grow_basis(raw, n, total, lambda r: k if len(r) >= k else None,
                                                _orthonormal(basis / scaled[:, None], None))
    return variances, ratios, k, _signed((basis @ rotation[:, :k]).T), total
