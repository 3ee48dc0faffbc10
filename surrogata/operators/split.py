"""SRT-2: exact shuffled train/test split without a global sort.

Rows are ordered by ``md5(concat_ws('|', id, seed))``; the first
``ceil(test_size * n)`` rows are the test set (sklearn's count rule).  The
cut key is found by counting hash-prefix buckets (at most 65536 counts per
round reach the driver) and refining only inside the boundary bucket, so the
work is a few narrow passes plus small aggregations — no sort of n rows, no
single task holding a large group.  The flag is then a per-row comparison
``key <= cut`` (md5 ties between distinct ids do not occur in practice; ids
break them otherwise).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surrogata.functions.rand import hash_order_key

PREFIX_HEX = 4          # 65536 buckets per refinement round
FINAL_COLLECT_LIMIT = 65536


def test_count(n: int, test_size: float | int) -> int:
    if isinstance(test_size, int) and not isinstance(test_size, bool):
        if not 0 < test_size < n:
            raise ValueError("integer test_size must be in (0, n)")
        return test_size
    if not 0.0 < float(test_size) < 1.0:
        raise ValueError("test_size must be in (0, 1)")
    k = int(math.ceil(float(test_size) * n))
    if k >= n:
        raise ValueError("test set would take every row")
    return k


def split_key(id_col: str = "id", seed: int = 42):
    return hash_order_key(F.col(id_col), F.lit(seed))


def find_cut(keys: DataFrame, k: int) -> tuple[str, int]:
    """Return (cut_key, cut_id): the k-th smallest (key, id) pair, 1-based.

    ``keys`` has columns ``_k`` (hex string) and ``_id``.
    """
    prefix = ""
    remaining = k
    cand = keys
    depth = 0
    while True:
        start = len(prefix) + 1
        bucket = F.substring("_k", start, PREFIX_HEX)
        counts = sorted((r["_b"], r["c"]) for r in
                        cand.groupBy(bucket.alias("_b")).agg(F.count("*").alias("c")).collect())
        cum = 0
        chosen, chosen_count = None, 0
        for b, c in counts:
            if cum + c >= remaining:
                chosen, chosen_count = b, c
                break
            cum += c
        if chosen is None:
            raise ValueError("split rank beyond the number of rows")
        remaining -= cum
        prefix += chosen
        cand = cand.filter(F.substring("_k", 1, len(prefix)) == F.lit(prefix))
        depth += 1
        if chosen_count <= FINAL_COLLECT_LIMIT or len(prefix) >= 32:
            rows = sorted((r["_k"], r["_id"]) for r in cand.select("_k", "_id").collect())
            return rows[remaining - 1]


def add_split_flag(df: DataFrame, id_col: str = "id", test_size: float | int = 0.15,
                   seed: int = 42, flag: str = "is_test") -> DataFrame:
    """Add a boolean ``is_test``: exactly ``ceil(test_size*n)`` rows are True."""
    keyed = df.withColumn("_k", split_key(id_col, seed))
    # the refinement rounds re-read only (key, id): keep that narrow projection
    keys = keyed.select("_k", F.col(id_col).alias("_id")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = keys.count()
        k = test_count(n, test_size)
        cut_key, cut_id = find_cut(keys, k)
    finally:
        keys.unpersist()
    is_test = (F.col("_k") < F.lit(cut_key)) | (
        (F.col("_k") == F.lit(cut_key)) & (F.col(id_col) <= F.lit(cut_id)))
    return keyed.withColumn(flag, is_test).drop("_k")


def train_test_split(df: DataFrame, id_col: str = "id", test_size: float | int = 0.15,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    flagged = add_split_flag(df, id_col, test_size, seed)
    return (flagged.filter(~F.col("is_test")).drop("is_test"),
            flagged.filter(F.col("is_test")).drop("is_test"))
