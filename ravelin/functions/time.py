"""Time functions; elapsed time is counted in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
#: Epoch numbers above it are milliseconds.
MILLIS = 1e11


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole elapsed days (not calendar days), towards zero."""
    return ((micros(later) - micros(earlier)) / F.lit(DAY_US)).cast("long")


def epoch_is_millis(df: DataFrame, col: str = "timestamp") -> bool:
    """Whether epoch numbers are milliseconds: their median exceeds 1e11. Two counts
    decide it, and where they are equal the two values next to 1e11. Runs a job."""
    at = F.col(col)
    high = at > MILLIS
    n, above, least, most = df.agg(F.count(at), F.count_if(high), F.min(F.when(high, at)), F.max(F.when(~high, at))).first()
    return 2 * above > n or (n > 0 and 2 * above == n and (least + most) / 2 > MILLIS)


def from_epoch(epoch: Column, millis: bool) -> Column:
    return F.timestamp_millis(epoch) if millis else F.timestamp_seconds(epoch)
