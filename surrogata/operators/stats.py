"""AGG-1..6, AGG-16, AGG-17: column statistics in the long layout.

``posexplode`` is a narrow generator inside whole-stage codegen and
``groupBy(pos)`` aggregates map-side first, so only (partitions x d) partial
rows are shuffled whatever the number of samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surrogata.operators.projection import to_long

STD_TOL = 0.01
# numpy allclose(a, b, atol) also adds rtol*|b| with rtol=1e-5: the bound for
# the standard deviation (b = 1) is 0.01 + 1e-5.
STD_TOL_ONE = 0.01 + 1e-5


def column_stats(long_df: DataFrame, pos: str = "pos", value: str = "value",
                 by: list[str] | None = None) -> DataFrame:
    """All moments the scalers need, in one aggregation per position."""
    keys = (by or []) + [pos]
    v = F.col(value)
    return long_df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std_pop"),
        F.stddev_samp(v).alias("std_samp"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def standard_scaler(stats: DataFrame, pos: str = "pos") -> DataFrame:
    """AGG-1: mean and population std, a zero std becomes 1 (sklearn rule)."""
    return stats.select(
        pos, "mean",
        F.when(F.col("std_pop") == 0, F.lit(1.0)).otherwise(F.col("std_pop")).alias("scale"))


def normaliser_stats(stats: DataFrame, pos: str = "pos") -> DataFrame:
    """AGG-2..4: sample std + 1e-6; min, max, range clamped at 1e-12; std clamped at 1e-12."""
    return stats.select(
        pos,
        F.col("mean"),
        (F.col("std_samp") + F.lit(1e-6)).alias("std_eps"),
        F.greatest(F.col("std_samp"), F.lit(1e-12)).alias("std_clamped"),
        F.col("min"), F.col("max"),
        F.greatest(F.col("max") - F.col("min"), F.lit(1e-12)).alias("range"),
    )


def is_standardised(stats: DataFrame) -> DataFrame:
    """AGG-5: every mean within 0.01 of 0 and every population std within 0.01(+rtol) of 1."""
    return stats.agg(
        F.bool_and((F.abs(F.col("mean")) <= STD_TOL)
                   & (F.abs(F.col("std_pop") - 1.0) <= STD_TOL_ONE)).alias("is_standardised"))


def vector_stats(df: DataFrame, vec: str = "x", id_col: str = "id") -> DataFrame:
    """Column statistics of an array column."""
    return column_stats(to_long(df, id_col, vec))


def argmax_position(vec: str) -> F.Column:
    """AGG-6 (row part): 0-based position of the first maximum, as numpy's argmax."""
    return F.array_position(F.col(vec), F.array_max(F.col(vec))) - 1


def representative_position(df: DataFrame, vec: str = "y") -> DataFrame:
    """AGG-6: median over rows of the per-row argmax, truncated to int."""
    return df.select(argmax_position(vec).alias("_am")).agg(
        F.median("_am").cast("int").alias("station"))


def mean_of(stats: DataFrame, col: str, alias: str) -> DataFrame:
    """AGG-16: mean over positions of a per-position statistic."""
    return stats.agg(F.avg(col).alias(alias))


def component_range(latent: DataFrame, z: str = "z", id_col: str = "id") -> DataFrame:
    """AGG-17: training range (min, max) of every latent component."""
    return (latent.select(F.posexplode(z).alias("component", "v")).groupBy("component")
            .agg(F.min("v").alias("min"), F.max("v").alias("max")))
