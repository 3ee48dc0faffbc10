"""Standardisation: fit (AGG-1), apply (PRJ-4) and undo (PRJ-5)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surrogata.operators.projection import to_long
from surrogata.operators.stats import column_stats, standard_scaler

# Above this width the scaler is applied with numpy in Arrow batches instead of
# a JVM expression with per-position literals.
LITERAL_WIDTH_LIMIT = 1024


@dataclass
class Scaler:
    """Small model state: one mean and scale per position (target positions last)."""
    mean: np.ndarray
    scale: np.ndarray

    @property
    def width(self) -> int:
        return int(self.mean.size)

    def part(self, start: int, stop: int | None = None) -> "Scaler":
        return Scaler(self.mean[start:stop], self.scale[start:stop])

    def to_df(self, spark) -> DataFrame:
        rows = [(int(i), float(m), float(s)) for i, (m, s) in enumerate(zip(self.mean, self.scale))]
        return spark.createDataFrame(rows, "pos int, mean double, scale double")


def scaler_table(df: DataFrame, vec: str = "v", id_col: str = "id") -> DataFrame:
    """AGG-1 as a DataFrame ``(pos, mean, scale)``."""
    return standard_scaler(column_stats(to_long(df, id_col, vec)))


def fit_scaler(df: DataFrame, vec: str = "v", id_col: str = "id") -> Scaler:
    """Collect the (width-bounded) scaler to the driver."""
    rows = sorted(scaler_table(df, vec, id_col).collect(), key=lambda r: r["pos"])
    return Scaler(np.array([r["mean"] for r in rows]), np.array([r["scale"] for r in rows]))


def _lit_array(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def standardise_col(c: Column, scaler: Scaler) -> Column:
    """PRJ-4 on an array column: ``(v - mean) / scale`` element-wise (JVM side)."""
    if scaler.width > LITERAL_WIDTH_LIMIT:
        raise ValueError("use standardise_df for very wide vectors")
    mu, sc = _lit_array(scaler.mean), _lit_array(scaler.scale)
    z = F.zip_with(c, mu, lambda v, m: v - m)
    return F.zip_with(z, sc, lambda v, s: v / s)


def unstandardise_col(c: Column, scaler: Scaler) -> Column:
    mu, sc = _lit_array(scaler.mean), _lit_array(scaler.scale)
    z = F.zip_with(c, sc, lambda v, s: v * s)
    return F.zip_with(z, mu, lambda v, m: v + m)


def standardise_df(df: DataFrame, col: str, scaler: Scaler) -> DataFrame:
    """PRJ-4 for any width: numpy in Arrow batches when the vector is wide."""
    if scaler.width <= LITERAL_WIDTH_LIMIT:
        return df.withColumn(col, standardise_col(F.col(col), scaler))
    from surrogata.operators.arrowutil import list_to_matrix, matrix_to_list
    from surrogata.operators.blas import single_thread_blas
    import pyarrow as pa

    mean, scale = scaler.mean, scaler.scale
    names = df.columns
    idx = names.index(col)

    def fn(batches):
        single_thread_blas()
        for rb in batches:
            if rb.num_rows == 0:
                yield rb
                continue
            M = (list_to_matrix(rb.column(idx)) - mean) / scale
            cols = list(rb.columns)
            cols[idx] = matrix_to_list(M)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    from pyspark.sql import types as T
    out_schema = T.StructType([
        T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == col else f.dataType, f.nullable)
        for f in df.schema])
    return df.mapInArrow(fn, out_schema)


def standardise_long(long_df: DataFrame, scaler_df: DataFrame, pos: str = "pos",
                     value: str = "value") -> DataFrame:
    """PRJ-4, long form: broadcast hash join on position (scaler has d rows)."""
    return (long_df.join(F.broadcast(scaler_df), pos)
            .withColumn(value, (F.col(value) - F.col("mean")) / F.col("scale"))
            .drop("mean", "scale"))
