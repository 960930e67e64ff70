"""The hourly rollup over a stream of readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_rollup(readings: DataFrame, ts: str, value: str, by: Sequence[str] = (), late: str = "2 hours") -> DataFrame:
    """Mean, sum (0 without a value) and count by hour; rows later than the watermark are dropped by the stream. Batch tables give the same rows."""
    d = readings.withWatermark(ts, late) if readings.isStreaming else readings
    out = d.groupBy(F.window(ts, "1 hour"), *by).agg(F.avg(value).alias("mean"), F.coalesce(F.sum(value), F.lit(0.0)).alias("sum"), F.count(value).alias("n"))
    return out.select(F.col("window.start").alias("datetime"), *by, "mean", "sum", "n")
