"""The mergeable confusion meter as a stream (an extension; the batch form is in operators.metrics)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_confusion(
    stream: DataFrame, time: str, by: list[str], pred: Column, target: Column, width: str = "1 day", late: str = "1 day"
) -> DataFrame:
    """Confusion counts by event-time window; in append and update mode rows later than ``late`` are left out by the watermark."""
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(F.window("_t", width).alias("w"), *by).agg(
        F.count_if(pred & target).alias("tp"), F.count_if(pred & ~target).alias("fp"), F.count_if(~pred & target).alias("fn")
    ).select(F.col("w.start").alias("start"), *by, "tp", "fp", "fn")
