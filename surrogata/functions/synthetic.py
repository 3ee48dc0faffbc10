"""FN-1 synthetic response and SRC-8 synthetic design.

Response for an input vector x of length d >= 55 (i counted from 1):

    y = mean_i[3 + i*x_i^3 + (i/3)*ln(x_i^2 + x_i^4) - 5*i*x_i]
        + x1*x2^2 - x5*x3 + x2*x4 + x51 + x50*x54^2

The constant 3 is inside the mean.  At x_i = 0 the logarithm is -inf (as in
numpy); Spark's ``ln(0)`` is NULL, so the zero case is mapped explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surrogata.functions.rand import hash_uniform

MIN_INPUTS = 55  # the response needs inputs 1..54 (VAL-8)

# Fixed values of the design: 100 inputs Uniform(1, 2), input index 19
# (0-based) Uniform(1, 3).
DESIGN_DIM = 100
DESIGN_LOW = 1.0
DESIGN_HIGH = 2.0
DESIGN_WIDE_INDEX = 19
DESIGN_WIDE_HIGH = 3.0


def _safe_ln(q: Column) -> Column:
    return F.when(q > 0, F.log(q)).otherwise(F.lit(float("-inf")))


def synthetic_response(x: Column | str) -> Column:
    """FN-1 as one JVM-side expression over an ``ARRAY<DOUBLE>`` column."""
    x = F.col(x) if isinstance(x, str) else x

    def term(v, i):
        w = (i + 1).cast("double")
        return (F.lit(3.0) + w * F.pow(v, 3) + (w / 3.0) * _safe_ln(v * v + F.pow(v, 4))
                - F.lit(5.0) * w * v)

    terms = F.transform(x, term)
    mean = F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t) / F.size(x)
    e = lambda k: F.element_at(x, k)  # noqa: E731  (1-based)
    extra = (e(1) * F.pow(e(2), 2) - e(5) * e(3) + e(2) * e(4) + e(51)
             + e(50) * F.pow(e(54), 2))
    return mean + extra


def check_response_input(df: DataFrame, x: str = "x") -> None:
    """VAL-8: at least 55 inputs (the message of the original says 'more than 55')."""
    row = df.select(F.min(F.size(x)).alias("lo")).first()
    if row is None or row.lo is None:
        raise ValueError("synthetic response needs a non-empty 2-D input")
    if row.lo < MIN_INPUTS:
        raise ValueError(f"synthetic response is defined for inputs with at least {MIN_INPUTS} components")


def to_unit_interval(v: Column) -> Column:
    """Map any real value into [1, 2): ``1 + |v|/(1+|v|)`` (used on embeddings)."""
    a = F.abs(v.cast("double"))
    return F.lit(1.0) + a / (F.lit(1.0) + a)


def design_columns(ids: DataFrame, id_col: str = "id", seed: int = 42,
                   dim: int = DESIGN_DIM) -> DataFrame:
    """SRC-8: synthetic design for each id of ``ids`` — x ~ U(1,2)^dim, x[19] ~ U(1,3).

    Values are hash uniforms of (id, j, seed), so the design is reproducible
    whatever the partitioning; y = FN-1(x).
    """
    idc = F.col(id_col)
    x = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: F.lit(DESIGN_LOW)
        + F.when(j == DESIGN_WIDE_INDEX, F.lit(DESIGN_WIDE_HIGH - DESIGN_LOW))
        .otherwise(F.lit(DESIGN_HIGH - DESIGN_LOW)) * hash_uniform(idc, j, F.lit(seed)),
    )
    out = ids.select(idc.cast("long").alias("id")).withColumn("x", x)
    return out.withColumn("y", synthetic_response("x"))


def generate(spark, n_samples: int = 500, seed: int = 42, dim: int = DESIGN_DIM) -> DataFrame:
    """SRC-8 over ``spark.range``: the reference's generator with a stable seed."""
    return design_columns(spark.range(n_samples), "id", seed, dim)
