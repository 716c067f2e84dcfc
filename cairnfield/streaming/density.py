"""Cell density over a stream of positions, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.functions.geometry import cell


def windowed_density(points: DataFrame, size: float, window: str = "1 hour", late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Points (ts, x, y) of a stream or a table counted by time window and cell; state goes once ``late`` is over."""
    at = F.window(time, window).alias("w")
    got = points.withWatermark(time, late).groupBy(at, cell(F.col("x"), size).alias("ix"), cell(F.col("y"), size).alias("iy")).agg(F.count("*").alias("count"))
    return got.select(F.col("w.start").alias("start"), "ix", "iy", "count")
