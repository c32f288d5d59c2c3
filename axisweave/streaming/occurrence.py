"""Occurrence matrices kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def occurrence_stream(events: DataFrame, r: str, c: str, values: str | None = None) -> DataFrame:
    """Running cells (r, c, v) of a stream; write with output mode update or complete."""
    v = F.sum(F.col(values).cast("double")) if values else F.count("*").cast("double")
    return events.groupBy(F.col(r).alias("r"), F.col(c).alias("c")).agg(v.alias("v"))


def windowed_occurrence(events: DataFrame, r: str, c: str, time: str, length: str, late: str, slide: str | None = None) -> DataFrame:
    """Cells per time window; rows later than the watermark are left out and closed windows leave the state."""
    span = F.window(F.col(time), length, slide) if slide else F.window(F.col(time), length)
    d = events.withWatermark(time, late).groupBy(span.alias("span"), F.col(r).alias("r"), F.col(c).alias("c")).agg(F.count("*").cast("double").alias("v"))
    return d.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), "r", "c", "v")
