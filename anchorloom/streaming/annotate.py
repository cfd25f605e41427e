"""Stream-static annotation: intervals that arrive are counted against a static table of peaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.genomic import KEYS
from anchorloom.operators.intervals import overlap_join


def overlaps(stream: DataFrame, peaks: DataFrame) -> DataFrame:
    """Overlapping pairs of a stream (keys, start, end, ...) with peaks; append mode, no state."""
    return overlap_join(stream, peaks.select(*KEYS, "start", "end"))


def counts(stream: DataFrame, peaks: DataFrame, time: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Overlaps by cell and event-time window, closed once the watermark has passed."""
    met = overlaps(stream.withWatermark(time, late), peaks)
    return met.groupBy(KEYS[0], F.window(f"a_{time}", window).alias("window")).agg(F.count("*").alias("overlaps"))
