"""Stage telemetry as a stream: tumbling windows with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stage_windows(rows: DataFrame, time: str = "ts", stage: str = "stage", value: str = "latency_s", width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, stage, n, mean, max) for each window and stage; rows later than `late` are dropped by the stream."""
    seen = rows.withWatermark(time, late) if rows.isStreaming else rows
    out = seen.groupBy(F.window(time, width), stage).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return out.select(F.col("window.start").alias("start"), stage, "n", "mean", "max")
