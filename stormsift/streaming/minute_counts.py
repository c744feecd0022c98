"""Alarm counts per service and minute on a stream, with late and repeated alarms handled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_minute_counts(alarms: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(service, minute, cnt) from a stream of (alarm_id, ts, service): an id counts once within the watermark."""
    once = alarms.withWatermark("ts", late).dropDuplicatesWithinWatermark(["alarm_id"])
    return once.groupBy("service", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("cnt")).select("service", F.col("w.start").alias("minute"), "cnt")
