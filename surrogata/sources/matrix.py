"""SRC-1, SRC-2, SRC-6, SRC-7: numeric matrices and raster stacks as DataFrames.

Rows of a text matrix get a stable 0-based ordinal id (their number among the
lines that are not blank, files ordered by path) without collecting or sorting the data: the
line count of every file split is aggregated (one row per split), turned into
offsets on that small table, and joined back by split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_matrix(spark: SparkSession, path: str | list[str], delimiter: str = ",") -> DataFrame:
    """SRC-1: delimited numeric text -> ``(id BIGINT, x ARRAY<DOUBLE>)``."""
    kept = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"), "value") \
        .filter(F.length(F.trim("value")) > 0)
    # counted after blank lines are gone, so the lines of a block are consecutive
    raw = kept.select("_f", "_b", F.monotonically_increasing_id().alias("_mid"), "value")
    blocks = raw.groupBy("_f", "_b").agg(F.min("_mid").alias("_m0"), F.count("*").alias("_n"))
    # offsets over the (small) table of splits: one row per file block
    w = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    j = raw.join(blocks.select("_f", "_b", "_m0", "_off"), ["_f", "_b"])
    parts = F.split(F.col("value"), delimiter if delimiter != "|" else "\\|")
    return j.select((F.col("_off") + F.col("_mid") - F.col("_m0")).alias("id"),
                    F.transform(parts, lambda c: F.trim(c).cast("double")).alias("x"))


def assemble(blocks: list[DataFrame], id_col: str = "id", vec: str = "x") -> DataFrame:
    """SRC-2 / JN-1: horizontal concatenation in the given order, joined on id.

    Row counts must agree (the original stacks positionally)."""
    if not blocks:
        raise ValueError("nothing to assemble")
    counts = [b.count() for b in blocks]
    if len(set(counts)) != 1:
        raise ValueError(f"matrices have different row counts: {counts}")
    for b in blocks[1:]:
        if not blocks[0].select(id_col).join(b.select(id_col), id_col, "left_anti").isEmpty() or \
                not b.select(id_col).join(blocks[0].select(id_col), id_col, "left_anti").isEmpty():
            raise ValueError("matrices have different row ids")
    out = blocks[0].select(id_col, F.col(vec).alias("_x0"))
    for i, b in enumerate(blocks[1:], start=1):
        out = out.join(b.select(id_col, F.col(vec).alias(f"_x{i}")), id_col)
    return out.select(id_col, F.concat(*[F.col(f"_x{i}") for i in range(len(blocks))]).alias(vec))


def raster_from_cells(cells: DataFrame, cols: int, sample: str = "sample_id", row: str = "row",
                      col: str = "col", value: str = "value") -> DataFrame:
    """SRC-6: long raster cells -> ``(sample_id, pos, value)``, pos = row*cols + col."""
    return cells.select(F.col(sample).alias("sample_id"),
                        (F.col(row) * cols + F.col(col)).cast("int").alias("pos"),
                        F.col(value).cast("double").alias("value"))


def raster_from_arrays(df: DataFrame, grid: str = "grid", sample: str = "sample_id") -> DataFrame:
    """SRC-7: ``ARRAY<ARRAY<DOUBLE>>`` (rows x cols) per sample -> long, row-major."""
    flat = df.select(F.col(sample).alias("sample_id"), F.flatten(grid).alias("_v"))
    return flat.select("sample_id", F.posexplode("_v").alias("pos", "value"))
