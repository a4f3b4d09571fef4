"""Detection and recruiting on streams of reads.

Both are stateless: a read is searched on its own, and recruiting joins the stream with a fixed set of patterns, so
neither needs a watermark.  Counts of arrivals by window do, and have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, recruit
from ..params import Params


def repeat_bearing(reads: DataFrame, p: Params = Params()) -> DataFrame:
    """Streaming reads ``(..., seq)`` that hold repeats, oriented, with their variant."""
    return detect.oriented(detect.repeat_bearing(reads, p))


def recruited(reads: DataFrame, patterns: DataFrame) -> DataFrame:
    """Streaming reads ``(read_id, seq)`` that hold a known pattern; ``patterns(pattern)`` is a fixed table."""
    return recruit.matches(reads, patterns)


def arrivals(events: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by window and type of ``events(ts, event_type)``; rows later than ``delay`` are left out."""
    late = events.withWatermark("ts", delay)
    return late.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"))
