"""PRJ-7 / AGG-7 / PRJ-9: zero-truncation of raster stacks and grid scatter.

Long raster layout ``(sample_id, pos, value)``; a missing cell is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_threshold(threshold) -> None:
    """VAL-2."""
    if isinstance(threshold, bool) or not isinstance(threshold, (int, float)):
        raise TypeError("threshold must be a number")
    if threshold < 0:
        raise ValueError("threshold cannot be negative")


def grid_positions(spark, rows: int, cols: int) -> DataFrame:
    """All cell positions of a rows x cols grid, row-major."""
    return spark.range(rows * cols).select(
        F.col("id").cast("int").alias("pos"),
        (F.col("id") / cols).cast("int").alias("row"),
        (F.col("id") % cols).cast("int").alias("col"))


def valid_counts(cells: DataFrame, grid: DataFrame, threshold: float = 0.5,
                 value: str = "value") -> DataFrame:
    """AGG-7: per cell, number of samples with ``value >= threshold`` (0 for empty cells)."""
    check_threshold(threshold)
    hits = cells.groupBy("pos").agg(
        F.count_if(F.col(value) >= F.lit(float(threshold))).alias("n_valid"))
    return (grid.select("pos").join(hits, "pos", "left")
            .select("pos", F.coalesce("n_valid", F.lit(0)).cast("long").alias("n_valid")))


def truncate(cells: DataFrame, valid: DataFrame, samples: DataFrame) -> DataFrame:
    """PRJ-7: dense values of the kept cells (n_valid > 0) for every sample.

    ``samples`` lists every sample id (a sample may have no stored cell).  The
    grid positions are generated per sample, those of dropped cells leave by a
    semi join with the kept-cell table (at most rows*cols rows), and the values
    come in by a left join on (sample_id, pos).
    """
    kept = valid.filter(F.col("n_valid") > 0).select("pos")
    last = kept.agg(F.max("pos")).first()[0]
    every = F.sequence(F.lit(0), F.lit(last)) if last is not None else F.array().cast("array<int>")
    frame = samples.select("sample_id", F.explode(every).alias("pos")).join(kept, "pos", "left_semi")
    return (frame.join(cells, ["sample_id", "pos"], "left")
            .select("sample_id", "pos", F.coalesce(F.col("value"), F.lit(0.0)).alias("value")))


def scatter(values: DataFrame, samples: DataFrame, rows: int, cols: int) -> DataFrame:
    """PRJ-9: kept-cell values back onto the full rows*cols grid, 0 elsewhere."""
    frame = samples.select("sample_id", F.explode(F.sequence(F.lit(0), F.lit(rows * cols - 1))).alias("pos"))
    return (frame.join(values, ["sample_id", "pos"], "left")
            .select("sample_id", "pos",
                    (F.col("pos") / cols).cast("int").alias("row"),
                    (F.col("pos") % cols).cast("int").alias("col"),
                    F.coalesce(F.col("value"), F.lit(0.0)).alias("value")))
