"""The 14-day table over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.config import Config


def biweekly_counts(events: DataFrame, config: Config, time: str = "ts", value: str = "value", lateness: str = "2 days") -> DataFrame:
    """(date_start, date_end, n, mean) of each 14-day window from the anchor; works on streams and tables."""
    offset = (config.anchor - config.anchor.__class__(1970, 1, 1)).days % 14
    window = F.window(time, "14 days", "14 days", f"{offset} days")
    if events.isStreaming:
        events = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)
    rows = events.groupBy(window.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.select(F.col("w.start").cast("date").alias("date_start"), F.date_sub(F.col("w.end").cast("date"), 1).alias("date_end"), "n", "mean")
