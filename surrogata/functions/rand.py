"""FN-9: stateless hash randomness.

A value is a pure function of (key..., seed), so generated data and draws do
not depend on partitioning, task retries or executor loss (``rand(seed)``
does).  The same numbers are produced by DuckDB with
``('0x' || substr(md5(concat_ws('|', k1, k2, seed)), 1, 13))::UBIGINT / 2^52``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash_uniform(*parts) -> Column:
    """Uniform on [0, 1) from the md5 of ``concat_ws('|', parts)`` (52 bits)."""
    h = F.substring(F.md5(_key(*parts)), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO_52)


def hash_uniform_open(*parts) -> Column:
    """Uniform on (0, 1): mid-point of the 52-bit cell, never 0 (safe for ln)."""
    h = F.substring(F.md5(_key(*parts)), 1, 13)
    return (F.conv(h, 16, 10).cast("double") + F.lit(0.5)) / F.lit(TWO_52)


def hash_normal(*parts) -> Column:
    """Standard normal by Box-Muller on two independent hash uniforms."""
    u1 = hash_uniform_open(*parts, "n1")
    u2 = hash_uniform(*parts, "n2")
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def hash_order_key(*parts) -> Column:
    """Full md5 hex string used as a shuffle order (split, landmark choice)."""
    return F.md5(_key(*parts))


def duckdb_uniform_sql(*parts: str) -> str:
    """The DuckDB expression that equals :func:`hash_uniform` for SQL oracles."""
    key = "concat_ws('|', " + ", ".join(parts) + ")"
    return f"((('0x' || substr(md5({key}), 1, 13))::UBIGINT)::DOUBLE / {TWO_52!r})"
