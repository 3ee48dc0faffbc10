"""Session helpers: a session as asked for, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

def get_spark(master: str | None = None, app: str | None = None,
              shuffle_partitions: int | None = None, driver_memory: str | None = None) -> SparkSession:
    """Return the active session or build one; only what is passed (or ``SURROGATA_MASTER``) is
    set, so master, memory and partitions of spark-submit hold on a cluster."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    asked = {
        "spark.master": master or os.environ.get("SURROGATA_MASTER"),
        "spark.app.name": app,
        "spark.sql.shuffle.partitions": shuffle_partitions,
        "spark.driver.memory": driver_memory,
    }
    b = SparkSession.builder
    for k, v in asked.items():
        if v is not None:
            b = b.config(k, str(v))
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    Where the setting is absent and all executors are this process (tests), a private temporary
    folder is created and registered; on a cluster its absence is an error, as executors would
    write to folders that the others can't read.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="surrogata-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(conf)
    return conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A table location below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
