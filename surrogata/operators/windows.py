"""WIN-1..WIN-6: window operators.

WIN-1..3 run on tables with at most d rows (component spectra); WIN-4..6 are
partitioned by run, so each window task holds one run's epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cumulative_ratio(spec: DataFrame, k: str = "k", value: str = "variance",
                     by: list[str] | None = None) -> DataFrame:
    """WIN-1: explained-variance ratio and its running sum ordered by component index."""
    by = by or []
    tot = Window.partitionBy(*by) if by else Window.partitionBy()
    run = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(k).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (spec.withColumn("ratio", F.col(value) / F.sum(value).over(tot))
            .withColumn("cum_ratio", F.sum("ratio").over(run)))


def components_above(cum: DataFrame, threshold: float, k: str = "k",
                     by: list[str] | None = None) -> DataFrame:
    """WIN-2: first k with cumulative share strictly above threshold; 1 if none."""
    by = by or []
    return cum.groupBy(*by).agg(
        F.coalesce(F.min(F.when(F.col("cum_ratio") > threshold, F.col(k))), F.lit(1)).alias("n_components"))


def rank_at_least(cum: DataFrame, threshold: float = 0.90, k: str = "k",
                  by: list[str] | None = None) -> DataFrame:
    """WIN-3: searchsorted(cum, thr) + 1 = first k with cum >= thr, else K + 1."""
    by = by or []
    return cum.groupBy(*by).agg(
        F.coalesce(F.min(F.when(F.col("cum_ratio") >= threshold, F.col(k))),
                   F.max(k) + 1).alias("r90"))


def trailing_slope(df: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "loss",
                   width: int = 20) -> DataFrame:
    """WIN-4: slope of a degree-1 fit of the last ``width`` losses (NULL until full)."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(-(width - 1), 0)
    return df.withColumn(
        "slope", F.when(F.count(loss).over(w) == width, F.regr_slope(loss, epoch).over(w)))


def patience(df: DataFrame, run: str = "run", epoch: str = "epoch", slope: str = "slope",
             min_epoch: int = 50, tol: float = -1e-5, limit: int = 75) -> DataFrame:
    """WIN-5: consecutive epochs (after ``min_epoch``) whose slope > tol; stop flag at > limit.

    Gaps-and-islands: a reset starts a new island, the counter is the running
    count of stalled epochs inside the island.
    """
    w = Window.partitionBy(run).orderBy(epoch)
    stalled = (F.col(epoch) > min_epoch) & F.col(slope).isNotNull() & (F.col(slope) > tol)
    out = df.withColumn("_st", stalled.cast("int"))
    out = out.withColumn("_island", F.sum(1 - F.col("_st")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wi = Window.partitionBy(run, "_island").orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("counter", F.sum("_st").over(wi).cast("long"))
    return out.withColumn("stop", F.col("counter") > limit).drop("_st", "_island")


def running_best(df: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """WIN-6: running minimum of the loss."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("best_loss", F.min(loss).over(w))


def first_stop(df: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """First epoch with the stop flag per run (NULL when never)."""
    return df.groupBy(run).agg(F.min(F.when(F.col("stop"), F.col(epoch))).alias("stop_epoch"))


# ---------------------------------------------------------------------------
# Skew-proof variants: a run holding a large share of all rows is cut into
# chunks of its rows in epoch order, so no window partition holds more than one
# chunk.  Results are identical to the plain versions (tests compare them).
# ``ordinal`` names the row number within the run (as ``ordinal_in_run`` gives);
# by default the epochs themselves must be 1, 2, 3, ...


def ordinal_in_run(df: DataFrame, run: str, order: str, bucket_width: int = 1 << 20,
                   out: str = "epoch") -> DataFrame:
    """Row number within run by ``order`` without sorting a whole run in one task.

    Rows are bucketed by ``order div bucket_width``; bucket counts (a small
    table) give each bucket's offset by a prefix sum; the row number inside a
    (run, bucket) group is added to it.
    """
    b = F.floor(F.col(order) / F.lit(bucket_width)).cast("long")
    keyed = df.withColumn("_b", b)
    counts = keyed.groupBy(run, "_b").agg(F.count("*").alias("_cnt"))
    w = Window.partitionBy(run).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).drop("_cnt")
    inner = Window.partitionBy(run, "_b").orderBy(order)
    return (keyed.join(offs, [run, "_b"])
            .withColumn(out, (F.col("_off") + F.row_number().over(inner)).cast("long"))
            .drop("_b", "_off"))


def _chunk(epoch: str, size: int):
    return F.floor((F.col(epoch) - 1) / F.lit(size)).cast("long")


def trailing_slope_chunked(df: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "loss",
                           width: int = 20, chunk: int = 1 << 16, ordinal: str | None = None) -> DataFrame:
    """WIN-4 per (run, chunk) with a (width-1)-row halo copied from the previous chunk."""
    if chunk < width:
        raise ValueError("chunk must be at least the window width")
    base = df.withColumn("_c", _chunk(ordinal or epoch, chunk)).withColumn("_halo", F.lit(False))
    pos_in_chunk = (F.col(ordinal or epoch) - 1) - F.col("_c") * chunk
    halo = (base.filter(pos_in_chunk >= chunk - (width - 1))
            .withColumn("_c", F.col("_c") + 1).withColumn("_halo", F.lit(True)))
    w = Window.partitionBy(run, "_c").orderBy(epoch).rowsBetween(-(width - 1), 0)
    both = base.unionByName(halo)
    res = both.withColumn("slope", F.when(F.count(loss).over(w) == width, F.regr_slope(loss, epoch).over(w)))
    return res.filter(~F.col("_halo")).drop("_c", "_halo")


def running_best_chunked(df: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "loss",
                         chunk: int = 1 << 16, ordinal: str | None = None) -> DataFrame:
    """WIN-6: running minimum = min(local running min, min of all earlier chunks)."""
    c = df.withColumn("_c", _chunk(ordinal or epoch, chunk))
    per = c.groupBy(run, "_c").agg(F.min(loss).alias("_cm"))
    wprev = Window.partitionBy(run).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_prev", F.min("_cm").over(wprev)).drop("_cm")
    wl = Window.partitionBy(run, "_c").orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = c.join(per, [run, "_c"]).withColumn("_loc", F.min(loss).over(wl))
    return out.withColumn("best_loss", F.least(F.col("_loc"), F.coalesce(F.col("_prev"), F.col("_loc")))) \
        .drop("_c", "_prev", "_loc")


def patience_chunked(df: DataFrame, run: str = "run", epoch: str = "epoch", slope: str = "slope",
                     min_epoch: int = 50, tol: float = -1e-5, limit: int = 75, chunk: int = 1 << 16, ordinal: str | None = None) -> DataFrame:
    """WIN-5 with a carry of the stalled streak across chunks (two-phase scan).

    Inside a chunk the streak is counted as in :func:`patience`; a chunk's
    leading stalled rows add the streak carried in from earlier chunks, where
    the carry is the previous chunk's trailing streak, extended through chunks
    that are stalled from start to end.
    """
    stalled = (F.col(epoch) > min_epoch) & F.col(slope).isNotNull() & (F.col(slope) > tol)
    c = df.withColumn("_c", _chunk(ordinal or epoch, chunk)).withColumn("_st", stalled.cast("int"))
    w = Window.partitionBy(run, "_c").orderBy(epoch)
    c = c.withColumn("_island", F.sum(1 - F.col("_st")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wi = Window.partitionBy(run, "_c", "_island").orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_local", F.sum("_st").over(wi))
    # per chunk: row count, stalled count, trailing streak (streak at the chunk's last row)
    per = c.groupBy(run, "_c").agg(
        F.count("*").alias("_n"), F.sum("_st").alias("_ns"),
        F.max_by("_local", epoch).alias("_trail"))
    # carry into chunk k: walk back over the previous chunks (small table, one row per chunk)
    full = (F.col("_ns") == F.col("_n")).cast("int")
    wc = Window.partitionBy(run).orderBy("_c")
    per = per.withColumn("_full", full)
    # index of the last non-full chunk before k; carry = trail of that chunk + sizes of full chunks after it
    per = per.withColumn("_brk", F.when(F.col("_full") == 0, F.col("_c")))
    per = per.withColumn("_lastbrk", F.max("_brk").over(wc.rowsBetween(Window.unboundedPreceding, -1)))
    per = per.withColumn("_cumn", F.sum("_n").over(wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    brk = per.select(run, F.col("_c").alias("_lastbrk"), F.col("_trail").alias("_btrail"),
                     F.col("_cumn").alias("_bcum"))
    per = per.join(brk, [run, "_lastbrk"], "left")
    prevcum = F.col("_cumn") - F.col("_n")
    carry = (F.when(F.col("_lastbrk").isNull(), prevcum)            # every earlier chunk fully stalled
             .otherwise(F.col("_btrail") + (prevcum - F.col("_bcum"))))
    per = per.select(run, "_c", carry.alias("_carry"))
    out = c.join(per, [run, "_c"])
    counter = F.when(F.col("_island") == 0, F.col("_local") + F.col("_carry")).otherwise(F.col("_local"))
    out = out.withColumn("counter", counter.cast("long")).withColumn("stop", F.col("counter") > limit)
    return out.drop("_c", "_st", "_island", "_local", "_carry")


def largest_group(df: DataFrame, key: str) -> int:
    """Rows of the largest group (one partial aggregation; a scalar reaches the driver)."""
    r = df.groupBy(key).agg(F.count("*").alias("_n")).agg(F.max("_n").alias("m")).first()
    return int(r["m"] or 0)


def loss_curves(h: DataFrame, run: str = "run", epoch: str = "epoch", loss: str = "loss",
                chunk: int = 1 << 16) -> DataFrame:
    """WIN-4/5/6 together, by one plan for runs of any size and epochs of any spacing."""
    o = ordinal_in_run(h, run, epoch, out="_ord")
    s = trailing_slope_chunked(o, run, epoch, loss, chunk=chunk, ordinal="_ord")
    s = patience_chunked(s, run, epoch, chunk=chunk, ordinal="_ord")
    return running_best_chunked(s, run, epoch, loss, chunk=chunk, ordinal="_ord").drop("_ord")
