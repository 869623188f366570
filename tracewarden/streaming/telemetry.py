"""Resource samples as they arrive: the operation roll-up over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.operators.telemetry import operation_summary


def rolling_summary(samples: DataFrame, window: str = "1 minute", lateness: str = "2 minutes") -> DataFrame:
    """The roll-up of :func:`operation_summary` per operation and window, for a stream or a table.

    ``samples`` carries ``timestamp`` in epoch seconds.  Rows later than ``lateness`` are dropped, so
    the state kept is the open windows only.
    """
    timed = samples.withColumn("event_time", F.timestamp_seconds("timestamp")).withWatermark("event_time", lateness)
    rolled = operation_summary(timed.withColumn("w", F.window("event_time", window)), ["operation", "w"])
    return rolled.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")
