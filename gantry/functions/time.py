"""Minutes, chunks and event time of a report."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Simulated second 0 as a timestamp. Not the epoch: the first watermark is the epoch, and a row
# not later than the watermark counts as late.
BASE_EPOCH = 1704067200


def minute_of(t) -> Column:
    """Number of the minute a second lies in, counted from 1."""
    return (F.floor(F.col(t) / 60) if isinstance(t, str) else F.floor(t / 60)).cast("int") + 1


def minute_start(minute) -> Column:
    """First second of a minute."""
    return ((F.col(minute) if isinstance(minute, str) else minute) - 1) * 60


def chunk_of(t: str, seconds: int) -> Column:
    return F.floor(F.col(t) / seconds).cast("int")


def event_time(t: str) -> Column:
    return F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col(t))
