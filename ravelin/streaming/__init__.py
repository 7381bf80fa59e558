"""The log's operators over unbounded input, as Structured Streaming plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """The first row of each key that arrives within the watermark; state is dropped
    once it has passed."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed_rates(events: DataFrame, hit: Column, length: str = "30 days", slide: str | None = None, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows, hits and rate of each window of event time."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = events.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hits"))
    return g.select("w.start", "w.end", "n", "n_hits", (F.col("n_hits") / F.col("n")).alias("rate"))


def sessions(events: DataFrame, gap: str = "30 minutes", user: str = "user_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Rows of each user's sessions, ended by a gap without events."""
    g = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(user, "s.start", "s.end", "n")
