"""Adapters from the benchmark tables to the emulator data model.

* ``embeddings`` -> design ``(id, x ARRAY<DOUBLE>, y DOUBLE)``: x maps every
  value into [1, 2) and y is the synthetic response (FN-1);
* ``lineitem``  -> raster stack ``(sample_id, pos, value)``: sample = supplier,
  row = line number - 1, col = ship month - 1, value = sum of discount;
* ``events``    -> loss history ``(run, epoch, loss)``;
* ``lineitem`` + ``part`` -> long predictions for the metric operators.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surrogata.functions.synthetic import synthetic_response, to_unit_interval
from surrogata.operators.arrowutil import BLOCK_NUMBERS
from surrogata.operators.partials import ensure_parallelism

RASTER_ROWS = 7
RASTER_COLS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embedding_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    x = F.transform(F.col("embedding"), to_unit_interval)
    return e.select(F.col("vec_id").cast("long").alias("id"), x.alias("x")).withColumn(
        "y", synthetic_response("x"))


WIDE = 21_600              # inputs of the wide design


def wide_design(spark: SparkSession, sf_dir: str, width: int = WIDE) -> DataFrame:
    """A wide design: position j holds the embedding's value j mod 64 times 1 + cos(j)/2.  The narrow
    rows are spread over the tasks, each of which widens a few at a time."""
    e = ensure_parallelism(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"),
                                                                     "embedding"))
    j = F.col("id").cast("double")
    weights = spark.range(width).select("id", (1.0 + F.cos(j) / 2.0).alias("w")).toArrow().sort_by("id")
    weights = weights.column("w").to_numpy()

    def widen(batches):
        rows = max(1, BLOCK_NUMBERS // width)
        places = np.arange(width)
        for rb in batches:
            for low in range(0, rb.num_rows, rows):
                ids, col = (rb.column(k).slice(low, rows) for k in (0, 1))
                size = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
                start = np.cumsum(size) - size
                if (size[col.is_valid().to_numpy(zero_copy_only=False)] == 0).any():
                    raise ZeroDivisionError("an empty embedding can't be widened")
                at = start[:, None] + places % np.maximum(size, 1)[:, None]
                gone = np.broadcast_to((size == 0)[:, None], at.shape).ravel()
                own = col.flatten().cast(pa.float64()).take(pa.array(at.ravel(), mask=gone))
                x = pc.multiply(own, pa.array(np.tile(weights, len(col))))
                bounds = pa.array(np.arange(0, width * len(col) + 1, width, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(bounds, x)], names=["id", "x"])

    return e.mapInArrow(widen, "id long, x array<double>")


def raster_cells(spark: SparkSession, sf_dir: str, measure: str = "discount") -> DataFrame:
    """Aggregated raster; ``measure='discount'`` is the truth, ``'expected'`` a simple prediction."""
    li = table(spark, sf_dir, "lineitem")
    pos = ((F.col("l_linenumber") - 1) * RASTER_COLS + (F.month("l_shipdate") - 1)).cast("int")
    val = F.sum("l_discount") if measure == "discount" else F.count("*") * F.lit(0.05)
    return (li.select(F.col("l_suppkey").alias("sample_id"), pos.alias("pos"), "l_discount")
            .groupBy("sample_id", "pos").agg(val.cast("double").alias("value")))


def raster_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raster sample (a supplier may have no line item)."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample_id"))


def loss_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss curves: run = user, epoch = position of the event in the user's order.

    The ordinal comes from bucket counts + offsets, so a user holding most
    events is not sorted in one task.
    """
    from surrogata.operators.windows import ordinal_in_run
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id",
                                               F.col("value").alias("loss"))
    return ordinal_in_run(ev, "run", "event_id").select("run", "epoch", "loss")


def lineitem_predictions(spark: SparkSession, sf_dir: str, z: float = 1.96) -> DataFrame:
    """Long predictions: model = return flag, task = line number, y = price/1000,
    mean = quantity * retail price / 1000, sd = 0.1 * mean + 1."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    j = li.join(part, "l_partkey")
    mean = F.col("l_quantity") * F.col("p_retailprice") / 1000.0
    sd = mean * 0.1 + 1.0
    return j.select(
        F.col("l_returnflag").alias("model"),
        F.col("l_linenumber").cast("int").alias("task"),
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"),
        (F.col("l_extendedprice") / 1000.0).alias("y"),
        mean.alias("mean"), sd.alias("sd"),
        (mean - F.lit(z) * sd).alias("lower"), (mean + F.lit(z) * sd).alias("upper"))


def lineitem_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x = (quantity, discount, tax), y = extended price; id = orderkey*8 + line number."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("id"),
        F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"),
                F.col("l_tax").cast("double")).alias("x"),
        F.col("l_extendedprice").cast("double").alias("y"))


def part_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array(F.col("p_size").cast("double")).alias("x"),
                    F.col("p_retailprice").cast("double").alias("y"))
