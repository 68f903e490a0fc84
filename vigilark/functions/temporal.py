from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")


def month_index(ts: Column) -> Column:
    """Months since year 0, so that a year ago is exactly 12 less."""
    return F.year(ts) * 12 + F.month(ts)


def interval(length: str) -> Column:
    """A day-time interval such as ``"6 hours"``."""
    return F.expr(f"INTERVAL {length}")


def event_time(df: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with zone; zone-less times are read in the session zone."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def micros(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970, for times with and without a zone."""
    if isinstance(df.schema[time].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{time}`)")
    return F.unix_micros(F.col(time).cast("timestamp"))


def micros_of(length: str) -> int:
    """The microseconds of a day-time interval such as ``"6 hours"``."""
    units = {"week": 7 * 86_400, "day": 86_400, "hour": 3_600, "minute": 60, "second": 1, "millisecond": 1e-3, "microsecond": 1e-6}
    words = length.lower().split()
    if not words or len(words) % 2 or any(u.rstrip("s") not in units for u in words[1::2]):
        raise ValueError(f"not numbers and units of weeks down to microseconds: {length!r}")
    return sum(int(n) * round(units[u.rstrip("s")] * 1e6) for n, u in zip(words[::2], words[1::2]))
