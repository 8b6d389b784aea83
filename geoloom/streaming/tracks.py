"""Streams of positions: windowed counts by tile and sessions by device, beyond what the batch engine needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions import mercator


def tile_activity(positions: DataFrame, zoom: int, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, z, x, y, n): positions (ts, lon, lat) by tile and event-time window; rows later than the watermark are
    dropped by the stream."""
    x, y = mercator.tile_of(F.col("lon"), F.col("lat"), F.lit(zoom))
    rows = positions.withWatermark("ts", late).withColumns({"z": F.lit(zoom), "x": x, "y": y})
    return rows.groupBy(F.window("ts", window).alias("w"), "z", "x", "y").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "z", "x", "y", "n")


def sessions(positions: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(trace, start, end, n): runs of a device's positions without a longer gap."""
    rows = positions.withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "trace").agg(F.count("*").alias("n")).select("trace", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
