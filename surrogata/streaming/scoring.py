"""Score a Structured Streaming DataFrame with a fitted emulator.

Every ``predict`` is a stateless narrow map (``mapInArrow``) with the model
state in the task closure, so it applies unchanged to a streaming source;
the sink is chosen by the caller (``foreachBatch`` for idempotent writes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(stream: DataFrame, emulator) -> DataFrame:
    """Streaming predictions ``(id, ..., mean, sd, lower, upper)``."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return emulator.predict(stream)


def start_scoring(stream: DataFrame, emulator, sink_path: str, checkpoint: str, trigger_once: bool = True):
    """Append predictions to a Parquet sink with a checkpointed query (exactly-once file sink)."""
    w = (score_stream(stream, emulator).writeStream.format("parquet")
         .option("path", sink_path).option("checkpointLocation", checkpoint).outputMode("append"))
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
