"""Session-aligned time: buckets counted from the open, session membership, epoch conversions. Built-in expressions only."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.config import CLOSE, OPEN, ZONE


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def midnight(ts: Column | str) -> Column:
    return _column(ts).cast("date").cast("timestamp_ntz")


def second_of_day(ts: Column | str) -> Column:
    ts = _column(ts)
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _plus(day: Column, secs: Column) -> Column:
    return day + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def bucket(ts: Column | str, tf: int | Column) -> Column:
    """Start of the bucket that holds ts: whole timeframes after the session's open; earlier times are in the first one."""
    since = F.greatest(second_of_day(ts) - OPEN, F.lit(0))
    width = F.lit(tf) if isinstance(tf, int) else tf
    return _plus(midnight(ts), OPEN + since - since % width)


def bucket_of(moment: dt.datetime, tf: int) -> dt.datetime:
    """bucket() of a plain value."""
    day = moment.replace(hour=0, minute=0, second=0, microsecond=0)
    since = max(int((moment - day).total_seconds()) - OPEN, 0)
    return day + dt.timedelta(seconds=OPEN + since - since % tf)


def in_hours(ts: Column | str, opens: int = OPEN, closes: int = CLOSE) -> Column:
    secs = second_of_day(ts)
    return (secs >= opens) & (secs < closes)


def on_weekday(ts: Column | str) -> Column:
    return F.weekday(_column(ts)) < 5


def in_session(ts: Column | str) -> Column:
    """Session hours of a Monday to Friday, whatever the calendar says."""
    return in_hours(ts) & on_weekday(ts)


def from_epoch_ms(ms: Column | str, zone: str = ZONE) -> Column:
    """Wall clock in zone. The session zone must be UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_millis(_column(ms)).cast("timestamp_ntz"))


def to_epoch_ms(ts: Column | str, zone: str = ZONE) -> Column:
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), _column(ts))
    return F.unix_millis(utc.cast("timestamp"))


def slots(tf: int) -> list[int]:
    """Seconds after the open at which a full session's buckets start."""
    return list(range(0, CLOSE - OPEN, tf))
