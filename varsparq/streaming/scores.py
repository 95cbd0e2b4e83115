"""An extension: windows of event scores on a stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_scores(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Count and mean of value by event_type and window; events: ts (timestamp), event_type, value; batch or stream."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")
