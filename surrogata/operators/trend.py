"""GP-16: linear trend (basis [1, x]) as the GP mean, by distributed normal equations.

One pass sums ``H^T H`` and ``H^T y`` per partition (H = [1, x], (d+1) x (d+1));
the driver solves for the coefficients; the residual and the trend are
narrow batch maps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from surrogata.operators.arrowutil import list_to_matrix, matrix_to_list, vector_or_scalar
from surrogata.operators.blas import single_thread_blas
from surrogata.operators.partials import emit, num_partitions, reduce_partials


def fit_linear_trend(df: DataFrame, x: str = "x", y: str = "y", ridge: float = 1e-10) -> np.ndarray:
    """Coefficients (d+1, p) of the least-squares linear trend (d checked before the pass)."""
    from surrogata.operators.pca import GRAM_LIMIT, input_width
    if input_width(df, x) + 1 > GRAM_LIMIT:
        raise ValueError("linear trend on very wide inputs would need a (d+1)^2 matrix; reduce first")
    sel = df.select(x, y)

    def fn(batches):
        single_thread_blas()
        hh = hy = None
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = list_to_matrix(rb.column(0))
            Y = vector_or_scalar(rb.column(1))
            H = np.hstack([np.ones((X.shape[0], 1)), X])
            if hh is None:
                hh = np.zeros((H.shape[1], H.shape[1]))
                hy = np.zeros((H.shape[1], Y.shape[1]))
            hh += H.T @ H
            hy += H.T @ Y
        if hh is not None:
            yield emit({"hh": hh, "hy": hy, "q": np.array([hh.shape[0], hy.shape[1]], dtype=float)})

    st = reduce_partials(sel.mapInArrow(fn, "key string, chunk int, vals array<double>"), num_partitions(sel))
    if "hh" not in st:
        raise ValueError("cannot fit a trend on an empty table")
    q = int(round(np.sqrt(st["hh"].size)))
    p = st["hy"].size // q
    hh = st["hh"].reshape(q, q)
    return np.linalg.solve(hh + ridge * np.trace(hh) / q * np.eye(q), st["hy"].reshape(q, p))


def trend_values(X: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return beta[0][None, :] + X @ beta[1:]


def subtract_trend(df: DataFrame, beta: np.ndarray, x: str = "x", y: str = "y") -> DataFrame:
    """Replace y by y - trend(x) (scalar or vector y), other columns kept."""
    names = df.columns
    ix, iy = names.index(x), names.index(y)
    scalar = not isinstance(df.schema[y].dataType, T.ArrayType)

    def fn(batches):
        single_thread_blas()
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = list_to_matrix(rb.column(ix))
            Y = vector_or_scalar(rb.column(iy))
            R = Y - trend_values(X, beta)
            cols = list(rb.columns)
            cols[iy] = pa.array(R[:, 0]) if scalar else matrix_to_list(R)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = T.StructType([T.StructField(f.name, T.DoubleType() if (f.name == y and scalar) else
                                         (T.ArrayType(T.DoubleType()) if f.name == y else f.dataType), True)
                           for f in df.schema])
    return df.mapInArrow(fn, schema)
