"""PRJ-1..3, PRJ-5, PRJ-13: projections over the block (array) layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_array(c: Column | str) -> Column:
    """A scalar target becomes a one-element array so one code path serves both."""
    return F.array(F.col(c) if isinstance(c, str) else c)


def append_target(x: str | Column, y: str | Column, y_is_array: bool = False) -> Column:
    """PRJ-1: ``hstack((X, y))`` — the target goes last."""
    xc = F.col(x) if isinstance(x, str) else x
    yc = F.col(y) if isinstance(y, str) else y
    return F.concat(xc, yc if y_is_array else F.array(yc))


def split_features(v: str | Column, d: int) -> tuple[Column, Column]:
    """PRJ-2: ``[:, :d]`` and ``[:, d:]`` of a concatenated vector."""
    vc = F.col(v) if isinstance(v, str) else v
    return F.slice(vc, 1, d), F.slice(vc, d + 1, F.size(vc) - d)


def last_element(v: str | Column) -> Column:
    """PRJ-2: ``[:, -1]``."""
    vc = F.col(v) if isinstance(v, str) else v
    return F.element_at(vc, -1)


def select_output(y: str | Column, loc: int | Column) -> Column:
    """PRJ-3: one output by 0-based position."""
    yc = F.col(y) if isinstance(y, str) else y
    idx = (loc + 1) if isinstance(loc, Column) else F.lit(int(loc) + 1)
    return F.element_at(yc, idx)


def to_long(df: DataFrame, id_col: str = "id", vec: str = "x",
            pos: str = "pos", value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """PRJ-13: block -> long ``(id, pos, value)``; pos is 0-based."""
    keep = keep or []
    return df.select(id_col, *keep, F.posexplode(vec).alias(pos, value)).withColumn(
        value, F.col(value).cast("double"))


def to_block(long_df: DataFrame, id_col: str = "id", pos: str = "pos",
             value: str = "value", out: str = "x") -> DataFrame:
    """Long -> block, ordered by position (a per-id group, bounded by d)."""
    return (long_df.groupBy(id_col)
            .agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("_pv"))
            .select(id_col, F.transform("_pv", lambda s: s[value]).alias(out)))


def descale(c: Column, mu: float, sigma: float) -> Column:
    """PRJ-5: back to original units, ``v*sigma + mu``."""
    return c * F.lit(float(sigma)) + F.lit(float(mu))


def descale_sd(c: Column, sigma: float) -> Column:
    """PRJ-5 for standard deviations: scaled only (see README, trap 4)."""
    return c * F.lit(float(sigma))
