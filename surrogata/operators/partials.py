"""Distributed sums of small dense statistics (the UDAF role).

A ``mapInArrow`` task folds all of its rows into fixed-size numpy partials and
emits them once per partition as ``(key, chunk, vals)`` rows.  The partials
are then summed by a grouped shuffle on ``(key, chunk)`` (numpy per group) —
two levels when the input has many partitions, like a tree reduction — so no
single task merges more than ~sqrt(P) partials and no array is larger than
``CHUNK`` doubles.
Only the final sums (model-sized, never row-sized) reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 32768
PARTIAL_SCHEMA = "key string, chunk int, vals array<double>"
_ARROW_SCHEMA = pa.schema([("key", pa.string()), ("chunk", pa.int32()),
                           ("vals", pa.list_(pa.float64()))])


def emit(stats: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Pack named arrays into one record batch of chunked partial rows."""
    keys, chunks, vals = [], [], []
    for k, v in stats.items():
        flat = np.asarray(v, dtype=np.float64).ravel()
        for c in range(max(1, math.ceil(flat.size / CHUNK))):
            keys.append(k)
            chunks.append(c)
            vals.append(flat[c * CHUNK:(c + 1) * CHUNK])
    offsets = np.zeros(len(vals) + 1, dtype=np.int32)
    offsets[1:] = np.cumsum([len(v) for v in vals])
    flat_all = np.concatenate(vals) if vals else np.zeros(0)
    arr = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_all))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(chunks, pa.int32()), arr], schema=_ARROW_SCHEMA)


def _sum_group(pdf: pd.DataFrame) -> pd.DataFrame:
    """Element-wise numpy sum of one (key, chunk) group of partials."""
    total = np.sum(np.stack(pdf["vals"].to_numpy()), axis=0)
    return pd.DataFrame({"key": [pdf["key"].iloc[0]], "chunk": [int(pdf["chunk"].iloc[0])],
                         "vals": [total]})


def reduce_partials(partials: DataFrame, n_input_partitions: int | None = None) -> dict[str, np.ndarray]:
    """Sum partial rows by key; returns flat numpy arrays on the driver.

    A group holds one partial per input partition (or per salt bucket), so its
    size is bounded by the partition count, never by the number of rows.  The
    (model-sized) sums come back through Arrow.
    """
    df = partials
    if n_input_partitions is not None and n_input_partitions > 64:
        salts = int(math.ceil(math.sqrt(n_input_partitions)))
        df = (df.withColumn("_salt", F.spark_partition_id() % salts)
              .groupBy("key", "chunk", "_salt")
              .applyInPandas(lambda p: _sum_group(p.drop(columns=["_salt"])), PARTIAL_SCHEMA))
    tab = df.groupBy("key", "chunk").applyInPandas(_sum_group, PARTIAL_SCHEMA).toArrow()
    keys = tab.column("key").to_pylist()
    chunks = tab.column("chunk").to_pylist()
    vals = tab.column("vals").combine_chunks()
    offs = vals.offsets.to_numpy()
    flat = vals.values.to_numpy(zero_copy_only=False)
    out: dict[str, list] = {}
    for i, (k, c) in enumerate(zip(keys, chunks)):
        out.setdefault(k, []).append((c, flat[offs[i]:offs[i + 1]]))
    return {k: np.concatenate([np.asarray(v, dtype=np.float64) for _, v in sorted(parts, key=lambda t: t[0])])
            for k, parts in out.items()}


def ensure_parallelism(df: DataFrame) -> DataFrame:
    """Spread a small input over all task slots before numpy-heavy passes.

    Only inputs with fewer partitions than ``defaultParallelism`` are
    repartitioned (round-robin); a large scan already has more partitions
    than cores and is left as it is.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df


def num_partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()
